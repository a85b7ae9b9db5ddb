"""Bipartite matching: deterministic and maximal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.plans.runtime import Scratch


def bipartite_matching(graph: Graph, left_col: str = "is_left", finish: str = "parallel", local_threshold: int = 5_000_000, max_rounds: int = 10_000) -> DataFrame:
    """(id, match_to): partner of each vertex, null where unmatched.

    In a round every unmatched left vertex asks its unmatched neighbours, each of
    these grants the smallest asker, and each left vertex accepts the smallest
    granter.  Ends when a round adds nothing.  ``finish='local'`` runs the same
    rounds on the driver once at most ``local_threshold`` edges remain.
    """
    scratch = Scratch(graph.spark, "matching")
    side = graph.vertices.select("id", F.col(left_col).alias("_left"))
    left = side.where("_left").select(F.col("id").alias("l"))
    right = side.where("not coalesce(_left, false)").select(F.col("id").alias("r"))
    rest = scratch.put(graph.edges.select(F.col("src").alias("l"), F.col("dst").alias("r")).distinct().join(left, "l", "left_semi").join(right, "r", "left_semi"))
    pairs = None
    for _ in range(max_rounds):
        if finish == "local" and (n := rest.count()) <= local_threshold:
            done = local_rounds([(x["l"], x["r"]) for x in rest.collect()]) if n else []
            more = graph.spark.createDataFrame(done, "l long, r long")
            pairs = more if pairs is None else pairs.unionByName(more)
            break
        grants = rest.groupBy("r").agg(F.min("l").alias("l"))
        taken = scratch.put(grants.groupBy("l").agg(F.min("r").alias("r")))
        if taken.isEmpty():
            break
        pairs = taken if pairs is None else pairs.unionByName(taken)
        after = scratch.put(rest.join(taken.select("l"), "l", "left_anti").join(taken.select("r"), "r", "left_anti"))
        scratch.drop(rest)
        rest = after
    else:
        if not rest.isEmpty():
            raise RuntimeError(f"the matching did not settle in {max_rounds} rounds")
    if pairs is None:
        return graph.vertices.select("id", F.lit(None).cast("long").alias("match_to"))
    both = pairs.select(F.col("l").alias("id"), F.col("r").alias("match_to")).union(pairs.select("r", "l"))
    return graph.vertices.select("id").join(both, "id", "left")


def local_rounds(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same rounds in memory, for a residue of bounded size."""
    matched: list[tuple[int, int]] = []
    while edges:
        grant: dict[int, int] = {}
        for x, y in edges:
            grant[y] = min(x, grant.get(y, x))
        take: dict[int, int] = {}
        for y, x in grant.items():
            take[x] = min(y, take.get(x, y))
        matched += take.items()
        used = set(take.values())
        edges = [(x, y) for x, y in edges if x not in take and y not in used]
    return matched


def count_augmentable(graph: Graph, matching: DataFrame) -> DataFrame:
    """(violations): edges whose two ends are both unmatched, or partners that disagree; 0 for a maximal matching."""
    m = matching.select("id", "match_to")
    free = m.where("match_to is null").select("id")
    open_ = graph.edges.where("src <> dst").join(free.withColumnRenamed("id", "src"), "src", "left_semi").join(free.withColumnRenamed("id", "dst"), "dst", "left_semi").agg(F.count("*").alias("c"))
    back = m.where("match_to is not null").select(F.col("id").alias("b"), F.col("match_to").alias("a"))
    odd = m.where("match_to is not null").join(back, (F.col("id") == F.col("a")) & (F.col("match_to") == F.col("b")), "left_anti").agg(F.count("*").alias("c"))
    return open_.union(odd).agg(F.sum("c").cast("long").alias("violations"))
