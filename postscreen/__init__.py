"""Screening of short posts as PySpark DataFrame jobs."""
