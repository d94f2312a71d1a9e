"""Sparse iterative reconstruction and corpus preparation as Spark jobs."""
