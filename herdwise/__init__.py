"""Mutual-scoring anomaly detection over tables of embedded items, as Spark jobs."""
