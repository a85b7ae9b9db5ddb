"""Edge-valued communication: values that live on edges, written by one end and read by the other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.plans.runtime import Adjacency, Scratch, buckets, in_place


def edge_valued(graph: Graph, init: Mapping[str, Column], write: Mapping[str, Column], read: Mapping[str, Column], update: Mapping[str, Column], rounds: int) -> Graph:
    """The graph after ``rounds`` of writing and reading edges: vertices (id, state), edges with the values last written.

    In a round every vertex writes ``write`` (over its state ``v`` and the edge ``e``,
    with the values there) on its out-edges, then gathers ``read`` (aggregates over the
    new edge columns) from its in-edges, and ``update`` makes the new state (``read``
    columns are null without in-edges).  Edge columns named in ``write`` start null
    unless the graph has them.
    """
    scratch = Scratch(graph.spark, "edges")
    edges = graph.edges
    for k in write:
        if k not in edges.columns:
            edges = edges.withColumn(k, F.lit(None).cast("double"))
    sides = Adjacency(scratch, edges)
    others = [c for c in edges.columns if c not in write]
    state = scratch.put(graph.vertices.select("id", *(c.alias(k) for k, c in init.items())).repartition(buckets(graph.spark), "id"), by=["id"])
    for _ in range(rounds):
        with in_place(graph.spark):
            cells = ["_cell"] if sides.hubs else []
            written = sides.meet(state).select(*(F.col(f"e.{c}").alias(c) for c in [*others, *cells]), *(c.alias(k) for k, c in write.items()))
            after = scratch.put(written, by=sides.by)
            sums = after.groupBy(F.col("dst").alias("_to")).agg(*(c.alias(k) for k, c in read.items()))
            full = state.join(sums, F.col("id") == F.col("_to"), "left")
            new = scratch.put(full.select("id", *(update.get(k, F.col(k)).alias(k) for k in init)), by=["id"])
        scratch.drop(sides.edges, state)
        sides.edges, state = after, new
    return Graph(state, sides.edges.drop("_cell"))
