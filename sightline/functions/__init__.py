"""Column-returning building blocks; nothing here needs a Python UDF."""
