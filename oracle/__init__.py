"""Independent SQL for every query, written for DuckDB over the general business tables."""
