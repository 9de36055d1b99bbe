"""Graincast: opening-matching analytics and corpus preparation on PySpark."""
