"""Point-in-time market-anomaly analytics as Spark jobs."""
