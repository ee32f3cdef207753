"""Registered queries: each a Spark function and, where SQL can say it, the DuckDB text it must equal."""
