"""Capture of streams as snapshots."""
