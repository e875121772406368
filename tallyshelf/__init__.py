"""Shelf analytics and corpus preparation as PySpark DataFrame transformations."""
