"""PageRank: a fixed number of updates, or until ranks settle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.plans.runtime import Adjacency, Scratch, buckets, in_place

#: Updates after which a run with ``tol`` that has not settled fails.
MOST_UPDATES = 10_000


def pagerank(graph: Graph, max_iter: int = 10, damping: float = 0.85, normalized: bool = True, dangling: str = "redistribute", tol: float | None = None) -> DataFrame:
    """(id, rank) after ``max_iter`` updates.

    ``normalized`` ranks start at 1/N and keep the form (1-d)/N + d*sum; otherwise
    they start at 1 with (1-d) + d*sum.  ``dangling='redistribute'`` spreads the
    rank of vertices without out-edges over all, ``'drop'`` loses it.  Parallel
    edges count each.  With ``tol`` only vertices next to a change above ``tol``
    are recomputed, from all their in-edges, until none is (``max_iter``
    then does not count; a run of ``MOST_UPDATES`` updates fails).
    """
    if dangling not in ("redistribute", "drop"):
        raise ValueError("dangling is 'redistribute' or 'drop'")
    scratch = Scratch(graph.spark, "pagerank")
    out = graph.edges.groupBy("src").agg(F.count("*").alias("deg"))
    n = graph.vertices.count()
    if n == 0:
        return graph.vertices.select("id", F.lit(0.0).alias("rank"))
    base, first = ((1 - damping) / n, 1.0 / n) if normalized else (1 - damping, 1.0)
    spread = dangling == "redistribute"
    edges = Adjacency(scratch, graph.edges.select("src", "dst"))
    state = graph.vertices.select("id").join(out, F.col("id") == F.col("src"), "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"), F.lit(first).alias("rank"), F.lit(True).alias("act"))
    dangling_rank = F.sum(F.when(F.col("deg") == 0, F.col("rank"))).alias("lost")
    seen = Observation()
    state = scratch.put(state.repartition(buckets(graph.spark), "id").observe(seen, dangling_rank), by=["id"])
    for _ in range(max_iter if tol is None else MOST_UPDATES):
        lost = seen.get["lost"] or 0.0 if spread else 0.0
        mail = edges.meet(state.where("deg > 0")).select(F.col("e.dst").alias("_to"), (F.col("rank") / F.col("deg")).alias("x")).groupBy("_to").agg(F.sum("x").alias("m"))
        share = damping * lost / n if normalized else damping * lost
        value = F.lit(base) + damping * F.coalesce("m", F.lit(0.0)) + F.lit(share)
        new = state.join(mail, F.col("id") == F.col("_to"), "left")
        seen = Observation()
        with in_place(graph.spark):
            if tol is None:
                after = scratch.put(new.select("id", "deg", value.alias("rank"), "act").observe(seen, dangling_rank), by=["id"])
            else:
                moved = scratch.put(new.select("id", "deg", F.when(F.col("act"), value).otherwise(F.col("rank")).alias("rank"), (F.col("act") & (F.abs(value - F.col("rank")) > tol)).alias("moved")), by=["id"])
                woken = edges.meet(moved.where("moved").select("id")).select(F.col("e.dst").alias("w")).distinct()
                next_ = moved.join(woken, F.col("id") == F.col("w"), "left").select("id", "deg", "rank", F.col("w").isNotNull().alias("act"))
                after = scratch.put(next_.observe(seen, dangling_rank, F.sum(F.col("act").cast("long")).alias("acts")), by=["id"])
                scratch.drop(moved)
        scratch.drop(state)
        state = after
        if tol is not None and not seen.get["acts"]:
            break
    else:
        if tol is not None:
            raise RuntimeError(f"ranks did not settle in {MOST_UPDATES} updates")
    edges.drop()
    return state.select("id", "rank")
