"""Column builders: everything here is an expression, so it stays inside Spark's own execution."""
