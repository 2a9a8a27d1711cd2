"""Column helpers built only from Spark built-ins."""
