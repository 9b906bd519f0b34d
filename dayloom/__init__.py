"""Time-use diary analytics as Spark DataFrame operators."""
