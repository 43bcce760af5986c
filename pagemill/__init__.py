"""Document intelligence as set-oriented Spark jobs."""
