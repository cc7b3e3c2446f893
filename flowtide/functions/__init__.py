"""Column functions: every classifier is a plain Spark expression."""
