"""wavelake: wireless-quality analytics as Spark jobs."""
