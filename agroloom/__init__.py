"""Grounded retrieval, verification and corpus preparation as PySpark jobs."""
