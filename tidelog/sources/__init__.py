"""Table sources and the snapshot store."""
