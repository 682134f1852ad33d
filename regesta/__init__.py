"""Regesta: record linkage, register analytics and corpus preparation on PySpark."""
