"""Connected components of a large set of links by alternating stars.

Two steps alternate until nothing changes.  The large-star step ties every
neighbour above a node to the node's smallest neighbour; the small-star step
ties a node and its smaller neighbours to the smallest.  The number of rounds
grows with the logarithm of the longest chain, not with its length, and no
component is ever gathered in one place: each step is a grouped minimum and a
join that adaptive execution splits where a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.runtime import Scratch

#: Far above what log-many rounds need; reaching it is an error, never a silent stop.
MAX_ROUNDS = 60


def _tie(pairs: DataFrame) -> DataFrame:
    """Add to (u, v) the smallest v of its u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def star_components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(id, component) for every end of a link; component is the smallest id reachable.

    Self-links only make their end appear; links with a null end are dropped;
    repeated links count once; no links give an empty result.
    """
    scratch = scratch or Scratch(links.sparkSession, "stars")
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    first = scratch.put(ends)
    edges = first
    for _ in range(MAX_ROUNDS):
        live = edges.where("u <> v")
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _tie(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        tied = _tie(large)
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.put(small)
        if edges is not first:
            scratch.drop(edges)
        edges = after
        # settled once every node has one root and no root has another
        forked = edges.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").select("u")
        chained = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
        if forked.union(chained).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = first.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return roots.join(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
