"""Spatial scene analytics and corpus preparation as PySpark DataFrame jobs."""
