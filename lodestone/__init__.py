"""Spark-first analytic operators over indexed code, text and tree collections."""
