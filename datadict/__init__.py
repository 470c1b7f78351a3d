"""Data dictionary and data-contract audit on PySpark."""
