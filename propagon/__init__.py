"""Propagation analytics and text-corpus preparation on PySpark."""
