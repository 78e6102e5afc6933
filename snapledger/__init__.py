"""Catalogue-and-diff engine on Spark: snapshots of keyed rows, what changed between them, and the history kept."""
