"""Network-flow threat analytics as Spark jobs."""
