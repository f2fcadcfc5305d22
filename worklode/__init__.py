"""worklode: work-context analytics on PySpark (claims, retrieval, incremental ingest)."""
