"""Spark-first graph, retrieval, audit and event analytics."""
