"""Query registry (Spark) and oracle SQL (DuckDB) over the driver tables."""
