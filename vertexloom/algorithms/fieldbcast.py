"""Field broadcast: edges enriched with a value of one end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph


def field_broadcast(graph: Graph, value_col: str = "value") -> DataFrame:
    """(src, dst, value): the target's value on every edge, parallel edges each."""
    return graph.edges.select("src", "dst").join(graph.vertices.select(F.col("id").alias("dst"), F.col(value_col).alias("value")), "dst", "left").select("src", "dst", "value")
