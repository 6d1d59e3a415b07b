"""End-to-end plans and the registry of queries over the parquet tables."""
