"""Incremental signed-multiset analytics on PySpark."""
