"""Vertexloom: graph analytics as declarative PySpark plans."""
