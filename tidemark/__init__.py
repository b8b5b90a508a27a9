"""Faceted article analytics on PySpark."""
