"""Time-coded media search and corpus processing on Spark."""
