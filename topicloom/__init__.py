"""Spark jobs that turn fetched pages into a labelled, scored article corpus."""
