"""Neighbourhood function and diameter by Flajolet-Martin sketches."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.functions.hashing import geometric, lowest_zero
from vertexloom.graph import Graph
from vertexloom.plans.runtime import Adjacency, Scratch, buckets, in_place

#: Fixed value: the correction of the estimator.
PHI = 0.77351


def _pairs(k: int):
    mean = sum((lowest_zero(F.col(f"b{j}")) for j in range(1, k)), lowest_zero(F.col("b0"))) / F.lit(float(k))
    return F.floor(F.pow(F.lit(2.0), mean) / F.lit(PHI)).cast("long")


def neighbourhood_function(graph: Graph, max_hops: int = 13, k: int = 10, seed: int = 0, tol: float | None = None) -> DataFrame:
    """(hop, pairs): estimated pairs of vertices within so many hops, masks flowing along edges.

    With ``tol`` the run ends at the first hop whose relative growth is below it, and
    without vertices at once.
    """
    scratch = Scratch(graph.spark, "hops")
    masks = [f"b{j}" for j in range(k)]
    edges = Adjacency(scratch, graph.edges.select("src", "dst"))
    state = graph.vertices.select("id", *(F.pow(F.lit(2.0), geometric(F.col("id"), F.lit(j), F.lit(seed))).cast("long").alias(m) for j, m in enumerate(masks)))
    seen, sized = Observation(), F.sum(_pairs(k)).alias("pairs")
    state = scratch.put(state.repartition(buckets(graph.spark), "id").observe(seen, sized), by=["id"])
    counts = [(0, seen.get["pairs"] or 0)]
    for hop in range(1, max_hops + 1):
        mail = edges.meet(state).select(F.col("e.dst").alias("_to"), *masks).groupBy("_to").agg(*(F.bit_or(m).alias(f"n{m}") for m in masks))
        new = state.join(mail, F.col("id") == F.col("_to"), "left").select("id", *(F.col(m).bitwiseOR(F.coalesce(f"n{m}", F.lit(0))).alias(m) for m in masks))
        seen = Observation()
        with in_place(graph.spark):
            after = scratch.put(new.observe(seen, sized), by=["id"])
        scratch.drop(state)
        state = after
        counts.append((hop, seen.get["pairs"] or 0))
        if tol is not None and (_settled(counts[-2][1], counts[-1][1], tol) or not counts[-1][1]):
            break
    scratch.drop(state)
    edges.drop()
    return graph.spark.createDataFrame(counts, "hop int, pairs long")


def _settled(before: int, after: int, tol: float) -> bool:
    """Whether growth is below ``tol``, by the decimal number that it is written as."""
    return after < before * (1 + Decimal(str(tol)))


def approx_diameter(graph: Graph, tol: float = 1e-4, max_hops: int = 1000, k: int = 10, seed: int = 0) -> int | None:
    """The first hop whose growth is below ``tol``; None if there is none up to ``max_hops``, as in a graph without vertices."""
    counts = dict(neighbourhood_function(graph, max_hops, k, seed, tol).collect())
    last = max(counts)
    return last if last and _settled(counts[last - 1], counts[last], tol) else None
