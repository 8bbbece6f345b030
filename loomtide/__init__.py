"""Incremental and iterative analytics on PySpark."""
