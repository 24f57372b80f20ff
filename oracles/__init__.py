"""Test inputs and independent DuckDB queries for the registered Spark queries."""
