"""Training-data operators: dedup, filtering, tokenising, sharding and formatting as Spark jobs."""
