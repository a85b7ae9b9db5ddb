"""Graph colouring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.functions.hashing import hash32, uniform
from vertexloom.graph import Graph
from vertexloom.plans.runtime import Adjacency, Scratch, buckets, in_place

#: Share of uncoloured vertices below which lazy pruning removes edges.
LAZY_SHARE = 0.01


def color(graph: Graph, algorithm: str = "luby", finish: str = "parallel", prune: str = "eager", seed: int = 0, local_threshold: int = 5_000_000, max_rounds: int = 10_000) -> DataFrame:
    """(id, color): a proper colouring of the undirected graph; self-loops are ignored.

    ``luby``: in round k vertices draw with chance 1/(2*degree), a drawn vertex
    without a drawn neighbour of smaller id gets colour k.  ``prune='eager'``
    removes coloured vertices' edges each round, ``'lazy'`` only once few vertices
    are left.  ``finish='local'`` colours the rest on the driver, in id order with
    the smallest colour free from the current round on, once at most
    ``local_threshold`` edges remain.  ``greedy``: by falling priority, every vertex
    takes the smallest colour that no neighbour has.
    """
    simple = graph.drop_self_loops().symmetrize()
    if algorithm == "greedy":
        return _greedy(simple, seed, max_rounds)
    if algorithm != "luby":
        raise ValueError(f"unknown algorithm {algorithm}")
    scratch = Scratch(graph.spark, "color")
    edges = Adjacency(scratch, simple.edges.select("src", "dst"))
    seen, counted = Observation(), F.count(F.lit(1)).alias("n")
    rest = scratch.put(simple.vertices.select("id").repartition(buckets(graph.spark), "id").observe(seen, counted), by=["id"])
    total = left = seen.get["n"] or 0
    done, lazy, degree = None, prune == "lazy", None

    def add(found: DataFrame) -> None:
        nonlocal done
        done = found if done is None else done.unionByName(found)

    for k in range(max_rounds):
        if not left:
            break
        # every uncoloured vertex tells its neighbours that it is there
        near = edges.meet(rest).select(F.col("e.dst").alias("id"), F.col("e.src").alias("near"))
        if finish == "local":
            live = near.join(rest, "id", "left_semi").select(F.col("id").alias("src"), F.col("near").alias("dst"))
            if live.count() <= local_threshold:
                linked = live.select(F.col("src").alias("id")).distinct()
                add(scratch.put(rest.join(linked, "id", "left_anti").withColumn("color", F.lit(k))))
                add(_local(graph.spark, live, k))
                break
        # pruning late leaves the degrees of the first round as they were
        if degree is None or not lazy:
            held = near.groupBy("id").agg(F.count("*").alias("deg"))
            degree = scratch.put(held.repartition(buckets(graph.spark), "id"), by=["id"]) if lazy else held
        seen = Observation()
        with in_place(graph.spark):
            drawn = rest.join(degree, "id", "left").where(F.col("deg").isNull() | (uniform(F.col("id"), F.lit(k), F.lit(seed)) < 1 / (2 * F.col("deg"))))
            drawn = scratch.put(drawn.select("id"), by=["id"])
            beaten = edges.meet(drawn).where("e.src < e.dst").select(F.col("e.dst").alias("id")).distinct()
            won = scratch.put(drawn.join(beaten, "id", "left_anti").withColumn("color", F.lit(k)), by=["id"])
            add(won)
            after = scratch.put(rest.join(won.select("id"), "id", "left_anti").observe(seen, counted), by=["id"])
        scratch.drop(rest, drawn)
        rest, left = after, seen.get["n"] or 0
        if lazy and left < LAZY_SHARE * total:
            lazy = False
    else:
        if left:
            raise RuntimeError(f"colours did not settle in {max_rounds} rounds")
    edges.drop()
    return done if done is not None else rest.withColumn("color", F.lit(0))


def _local(spark, edges: DataFrame, start: int) -> DataFrame:
    """Colours of the ends of a bounded number of edges, each listed both ways; vertices without edges never come here."""
    near: dict[int, list[int]] = {}
    for e in edges.collect():
        near.setdefault(e["src"], []).append(e["dst"])
    found: dict[int, int] = {}
    for v in sorted(near):
        used = {found[u] for u in near[v] if u in found}
        c = start
        while c in used:
            c += 1
        found[v] = c
    return spark.createDataFrame(list(found.items()), "id long, color int")


def _greedy(graph: Graph, seed: int, max_rounds: int) -> DataFrame:
    """A vertex is coloured once all neighbours of higher priority are."""
    scratch = Scratch(graph.spark, "greedy")
    rank = F.struct(hash32(F.col("id"), F.lit(seed)), F.col("id"))
    v = graph.vertices.select("id", rank.alias("rank"))
    edges = graph.edges.join(v.select(F.col("id").alias("src"), F.col("rank").alias("sr")), "src").join(v.select(F.col("id").alias("dst"), F.col("rank").alias("dr")), "dst")
    before = scratch.put(edges.where("sr < dr").select("src", "dst"))
    state = scratch.put(graph.vertices.select("id", F.lit(None).cast("int").alias("color")))
    for _ in range(max_rounds):
        known = before.join(state.select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.collect_set("color").alias("used"), F.bool_and(F.col("color").isNotNull()).alias("ready"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used"))).cast("int")
        new = state.join(known, "id", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
        after = scratch.put(new.select("id", F.coalesce("color", F.when(F.coalesce("ready", F.lit(True)), free)).alias("color")))
        scratch.drop(state)
        state = after
        if state.where("color is null").isEmpty():
            return state
    raise RuntimeError(f"colours did not settle in {max_rounds} rounds")


def count_color_conflicts(graph: Graph, colors: DataFrame) -> DataFrame:
    """(conflicts): edges whose ends share a colour or miss one; 0 for a proper colouring."""
    e = graph.edges.where("src <> dst").join(colors.select(F.col("id").alias("src"), F.col("color").alias("a")), "src", "left").join(colors.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst", "left")
    return e.agg(F.sum(F.when(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b")), 1).otherwise(0)).cast("long").alias("conflicts")).select(F.coalesce("conflicts", F.lit(0).cast("long")).alias("conflicts"))
