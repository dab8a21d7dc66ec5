"""Agent-memory analytics as Spark jobs: DataFrame in, DataFrame out."""
