"""Plans: the report build, the query registry and its DuckDB oracle."""
