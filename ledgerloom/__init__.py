"""Property-operations analytics on PySpark: ingest, route, extract, fold and read facts."""
