"""Detection-evaluation analytics as Spark DataFrame plans."""
