"""Curation of AI-evaluation data on Spark: ingest, search, curate, mine, guard, export."""

__version__ = "0.1.0"
