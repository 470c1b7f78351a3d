"""Column expressions over catalog text. All are built-in Spark expressions; there are no UDFs."""
