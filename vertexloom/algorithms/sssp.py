"""Single-source shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.plans.superstep import pregel


def sssp(graph: Graph, source: int, weight: str | None = None, with_parent: bool = False, max_iter: int = 10_000) -> DataFrame:
    """(id, dist[, parent]) from ``source`` along edges; null where unreachable.

    Without ``weight`` every edge counts 1.  Weights must not be negative.  Of
    equally short ways the parent with the smallest id is kept; the source has none.
    """
    cost = F.col(f"e.{weight}").cast("double") if weight else F.lit(1.0)
    closer = F.col("dist").isNull() | (F.col("d") < F.col("dist"))
    tied = (F.col("d") == F.col("dist")) & (F.col("p") < F.col("parent"))
    run = pregel(
        graph,
        init={"dist": F.when(F.col("id") == source, F.lit(0.0)), "parent": F.lit(None).cast("long")},
        message={"d": F.col("v.dist") + cost, "p": F.col("v.id")},
        combine={"p": F.min_by("p", F.struct("d", "p")), "d": F.min("d")},
        update={"dist": F.when(closer, F.col("d")).otherwise(F.col("dist")), "parent": F.when(closer | tied, F.col("p")).otherwise(F.col("parent"))},
        active=F.col("old_dist").isNull() & F.col("dist").isNotNull() | (F.col("dist") < F.col("old_dist")),
        start=F.col("id") == source,
        max_iter=max_iter,
    )
    if run.reason == "max_iter":
        raise RuntimeError(f"distances did not settle in {max_iter} supersteps")
    return run.vertices if with_parent else run.vertices.select("id", "dist")
