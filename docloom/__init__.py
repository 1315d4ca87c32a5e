"""Document-retrieval analytics on Spark: ingest, chunk, search, pack, cite, evaluate."""

__version__ = "0.1.0"
