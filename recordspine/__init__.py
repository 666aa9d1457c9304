"""recordspine: evidence-first public-record data as Spark DataFrame, SQL and Structured Streaming jobs."""
