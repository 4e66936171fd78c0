"""A Spark engine that profiles quality-control observations."""
