"""A graph as two DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Graph:
    """Vertices ``(id, ...)`` and edges ``(src, dst, ...)``.

    Edges are directed; an undirected graph lists each edge both ways
    (``symmetrize``).  Parallel edges and self-loops stay unless dropped by the
    methods below.  Rows with a null id or end are dropped; a repeated vertex id
    keeps one of its rows.  Edge ends without a vertex row become vertices, unless
    ``missing='drop'`` asks to drop edges to unknown targets.
    """

    def __init__(self, vertices: DataFrame | None, edges: DataFrame, missing: str = "create"):
        for c in ("src", "dst"):
            if c not in edges.columns:
                raise ValueError(f"edges need a column {c}")
        if missing not in ("create", "drop"):
            raise ValueError("missing is 'create' or 'drop'")
        edges = edges.where("src is not null and dst is not null")
        ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        if vertices is None:
            vertices = ends
        else:
            if "id" not in vertices.columns:
                raise ValueError("vertices need a column id")
            vertices = vertices.where("id is not null").dropDuplicates(["id"])
            if missing == "create":
                vertices = ends.join(vertices, "id", "full") if len(vertices.columns) > 1 else ends.union(vertices).distinct()
            else:
                known = vertices.select(F.col("id").alias("_k"))
                edges = edges.join(known, edges["dst"] == known["_k"], "left_semi").join(known, edges["src"] == known["_k"], "left_semi")
        self.vertices, self.edges = vertices, edges

    @property
    def spark(self):
        return self.edges.sparkSession

    def symmetrize(self) -> Graph:
        """Each edge both ways, without repetitions; other edge columns take their smallest value."""
        others = [c for c in self.edges.columns if c not in ("src", "dst")]
        both = self.edges.unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others))
        edges = both.groupBy("src", "dst").agg(*(F.min(c).alias(c) for c in others)) if others else both.distinct()
        return self._with(edges)

    def reverse(self) -> Graph:
        others = [c for c in self.edges.columns if c not in ("src", "dst")]
        return self._with(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others))

    def drop_self_loops(self) -> Graph:
        return self._with(self.edges.where("src <> dst"))

    def dedup_edges(self) -> Graph:
        """One edge for each pair of ends; other columns take their smallest value."""
        others = [c for c in self.edges.columns if c not in ("src", "dst")]
        return self._with(self.edges.groupBy("src", "dst").agg(*(F.min(c).alias(c) for c in others)) if others else self.edges.distinct())

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree); isolated vertices have zeros."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select("dst", F.lit(0), F.lit(1)))
        ends = ends.union(self.vertices.select("id", F.lit(0), F.lit(0)))
        return ends.groupBy("id").agg(F.sum("o").cast("long").alias("out_degree"), F.sum("i").cast("long").alias("in_degree"))

    def num_vertices(self) -> int:
        return self.vertices.count()

    def add_vertices(self, extra: DataFrame) -> Graph:
        """The graph with more vertices; ids already present keep their row."""
        fresh = extra.join(self.vertices.select("id"), "id", "left_anti").dropDuplicates(["id"])
        return self._with(self.edges, self.vertices.unionByName(fresh, allowMissingColumns=True))

    def prune_edges(self, removed: DataFrame) -> Graph:
        """The graph without edges from or to the ids in ``removed``."""
        gone = removed.select(F.col("id").alias("_g"))
        edges = self.edges.join(gone, self.edges["dst"] == gone["_g"], "left_anti")
        return self._with(edges.join(gone, edges["src"] == gone["_g"], "left_anti"))

    def replace_edges(self, edges: DataFrame) -> Graph:
        """The graph with the out-edges of every source in ``edges`` replaced by these."""
        sources = edges.select(F.col("src").alias("_s")).distinct()
        kept = self.edges.join(sources, self.edges["src"] == sources["_s"], "left_anti")
        return self._with(kept.unionByName(edges))

    def _with(self, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        out = object.__new__(Graph)
        out.vertices, out.edges = self.vertices if vertices is None else vertices, edges
        return out
