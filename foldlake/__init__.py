"""Structure and fragment analytics as Spark jobs."""
