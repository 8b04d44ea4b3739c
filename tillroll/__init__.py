"""Receipt analytics as Spark jobs."""
