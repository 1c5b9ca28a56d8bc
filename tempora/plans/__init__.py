"""Plans in ANSI SQL over the index tables; each runs on Spark, and on DuckDB as its own check."""
