"""Whole-table plans: numbering, chunks, batches, manifests."""
