"""Connected components and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.stars import star_components
from vertexloom.plans.runtime import Adjacency, Scratch, buckets, in_place
from vertexloom.plans.superstep import pregel


def connected_components(graph: Graph, algorithm: str = "hashmin", directed: bool = False, max_iter: int = 1000, pivot: int | None = None, pivot_label: int | None = None, truncate: bool = False) -> DataFrame:
    """(id, label): the smallest id of each vertex's component.

    ``hashmin`` propagates minima; ``sv`` hooks trees and shortcuts them, in
    logarithmically many rounds; ``pivot`` first takes the component of one vertex
    by breadth-first search (the vertex of highest degree, smallest id on ties, or
    ``pivot``) and propagates minima over the rest; ``stars`` alternates large and
    small stars, for large graphs with long chains.  With ``directed`` (hashmin only) labels follow edges: the smallest id
    that reaches the vertex.  ``pivot_label`` marks the pivot's component instead
    of its smallest id.  With ``truncate`` (hashmin only) the labels after
    ``max_iter`` supersteps are the result, settled or not; otherwise that fails.
    """
    if directed:
        if algorithm != "hashmin":
            raise ValueError("only hashmin follows edge direction")
        return _hashmin(graph, max_iter, truncate)
    if algorithm == "hashmin":
        return _hashmin(graph.symmetrize(), max_iter, truncate)
    if algorithm == "sv":
        return _hook_and_shortcut(graph.symmetrize(), max_iter)
    if algorithm == "pivot":
        return _pivot(graph.symmetrize(), max_iter, pivot, pivot_label)
    if algorithm == "stars":
        found = star_components(graph.edges, "src", "dst")
        return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    raise ValueError(f"unknown algorithm {algorithm}")


def _hashmin(graph: Graph, max_iter: int, truncate: bool = False) -> DataFrame:
    run = pregel(
        graph,
        init={"label": F.col("id")},
        message={"m": F.col("v.label")},
        combine={"m": F.min("m")},
        update={"label": F.least("label", "m")},
        active=F.col("label") < F.col("old_label"),
        max_iter=max_iter,
    )
    if run.reason == "max_iter" and not truncate:
        raise RuntimeError(f"labels did not settle in {max_iter} supersteps")
    return run.vertices


def _hook_and_shortcut(graph: Graph, max_iter: int) -> DataFrame:
    """Each root hooks onto the smallest label next to its tree, then every vertex takes its grandparent's label.

    Stops when neither step changes a label, which is sound on any input.
    """
    scratch = Scratch(graph.spark, "sv")
    edges = Adjacency(scratch, graph.edges.select("src", "dst").where("src <> dst"))
    tree = scratch.put(graph.vertices.select("id", F.col("id").alias("d")).repartition(buckets(graph.spark), "id"), by=["id"])
    for _ in range(max_iter):
        near = edges.meet(tree).select(F.col("e.dst").alias("_to"), F.col("d").alias("nd")).groupBy("_to").agg(F.min("nd").alias("nd"))
        hooks = tree.join(near, F.col("id") == F.col("_to")).where("nd < d").groupBy(F.col("d").alias("root")).agg(F.min("nd").alias("to"))
        kept = tree.join(hooks, F.col("id") == F.col("root"), "left").select("id", F.least("d", F.coalesce("to", "d")).alias("h"), "d")
        seen = Observation()
        with in_place(graph.spark):
            hooked = scratch.put(kept, by=["id"])
            up = hooked.select(F.col("id").alias("p"), F.col("h").alias("g"))
            new = hooked.join(up, F.col("h") == F.col("p")).select("id", F.col("g"), "d").observe(seen, F.sum((F.col("g") != F.col("d")).cast("long")).alias("moved"))
            new = scratch.put(new.select("id", F.col("g").alias("d")).repartition(buckets(graph.spark), "id"), by=["id"])
        scratch.drop(tree, hooked)
        tree = new
        if not seen.get["moved"]:
            break
    else:
        raise RuntimeError(f"trees did not settle in {max_iter} rounds")
    edges.drop()
    return tree.withColumnRenamed("d", "label")


def bfs_reachable(graph: Graph, source: int, max_iter: int = 10_000) -> DataFrame:
    """(id, hops) of the vertices that edges from ``source`` reach; the source has 0."""
    run = pregel(
        graph,
        init={"hops": F.when(F.col("id") == source, F.lit(0).cast("long"))},
        message={"m": F.col("v.hops") + 1},
        combine={"m": F.min("m")},
        update={"hops": F.coalesce("hops", "m")},
        active=F.col("old_hops").isNull() & F.col("hops").isNotNull(),
        start=F.col("id") == source,
        max_iter=max_iter,
    )
    if run.reason == "max_iter":
        raise RuntimeError(f"the search did not end in {max_iter} supersteps")
    return run.vertices.where("hops is not null")


def _pivot(graph: Graph, max_iter: int, pivot: int | None, pivot_label: int | None) -> DataFrame:
    if pivot is None:
        top = graph.degrees().orderBy(F.desc("out_degree"), "id").first()
        if top is None:
            return graph.vertices.select("id", F.col("id").alias("label"))
        pivot = top["id"]
    scratch = Scratch(graph.spark, "pivot")
    reached = scratch.put(bfs_reachable(graph, pivot, max_iter).select("id"))
    least = reached.agg(F.min("id").alias("m")).first()["m"] if pivot_label is None else pivot_label
    rest = graph.vertices.select("id").join(reached, "id", "left_anti")
    gone = reached.select(F.col("id").alias("src"))
    labels = _hashmin(Graph(rest, graph.edges.join(gone, "src", "left_anti").select("src", "dst")), max_iter)
    return labels.unionByName(reached.select("id", F.lit(least).cast("long").alias("label")))


def component_sizes(labels: DataFrame) -> DataFrame:
    """(label, size), the histogram of a labelling."""
    return labels.groupBy("label").agg(F.count("*").alias("size"))
