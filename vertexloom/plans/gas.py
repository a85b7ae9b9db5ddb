"""Gather, apply, scatter: the pull model of vertex programs.

Active vertices gather over their edges from all neighbours, active or not,
apply the sum to their state, and signal the out-neighbours of those whose
change matters.  Edges are laid out once by source; sums and signals travel.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.plans.runtime import Adjacency, Scratch, buckets, in_place


def gather_apply_scatter(
    graph: Graph,
    init: Mapping[str, Column],
    gather: Mapping[str, Column],
    combine: Mapping[str, Column],
    apply: Mapping[str, Column],
    scatter: Column,
    *,
    start: Column | None = None,
    max_iter: int = 1000,
) -> DataFrame:
    """Final (id, state) after no vertex is signalled; fails where ``max_iter`` supersteps do not get there.

    ``gather`` is evaluated on every in-edge ``e`` of an active vertex over the
    source's state ``v``; ``combine`` aggregates it; ``apply`` makes the new state
    from the old columns and the combined ones (null without in-edges);
    ``scatter`` says, over new state and ``old_<name>``, whether to signal.
    """
    scratch = Scratch(graph.spark, "gas")
    edges = Adjacency(scratch, graph.edges)
    state = graph.vertices.select("id", *(c.alias(k) for k, c in init.items())).withColumn("_active", start if start is not None else F.lit(True))
    state = scratch.put(state.repartition(buckets(graph.spark), "id"), by=["id"])
    for _ in range(max_iter):
        # vertices that are not active let their sums lie, so the sources need not know who is
        sums = edges.meet(state).select(F.col("e.dst").alias("_to"), *(g.alias(k) for k, g in gather.items())).groupBy("_to").agg(*(c.alias(k) for k, c in combine.items()))
        full = state.join(sums, F.col("id") == F.col("_to"), "left")
        new = full.select("id", "_active", *(F.when(F.col("_active"), apply[k]).otherwise(F.col(k)).alias(k) if k in apply else F.col(k) for k in init), *(F.col(k).alias(f"old_{k}") for k in init))
        left = Observation()
        with in_place(graph.spark):
            moved = scratch.put(new.withColumn("_signal", F.col("_active") & F.coalesce(scatter, F.lit(False))).select("id", *init, "_signal"), by=["id"])
            signalled = edges.meet(moved.where("_signal").select("id")).select(F.col("e.dst").alias("_s")).distinct()
            after = moved.join(signalled, F.col("id") == F.col("_s"), "left").select("id", *init, F.col("_s").isNotNull().alias("_active"))
            after = scratch.put(after.observe(left, F.sum(F.col("_active").cast("long")).alias("n")), by=["id"])
        scratch.drop(state, moved)
        state = after
        if not left.get["n"]:
            break
    else:
        raise RuntimeError(f"vertices were still signalled after {max_iter} supersteps")
    edges.drop()
    return state.select("id", *init)


def transform_vertices(graph: Graph, **columns: Column) -> Graph:
    """The graph with vertex columns added or replaced."""
    return graph._with(graph.edges, graph.vertices.withColumns(columns))
