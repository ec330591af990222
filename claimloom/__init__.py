"""Claims analytics as plain Spark DataFrame functions (see README.md)."""
