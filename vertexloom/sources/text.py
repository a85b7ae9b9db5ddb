"""Text graphs, one vertex to a line, and text sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.graph import Graph

FORMATS = ("adj", "wadj", "wadj_nocount", "adj_unit", "bip", "field", "generic", "generic_value")


def parse(lines: DataFrame, fmt: str = "adj", drop_self_loops: bool = False, line_col: str = "value") -> Graph:
    """Read lines (one string column) as a graph.

    ``adj``: id, count, neighbours.  ``wadj``: id, count, neighbour and length in
    turn; ``wadj_nocount`` without the count.  ``adj_unit``: as adj, every weight 1.
    ``bip``: id, flag (0: left), neighbours.  ``field``: id, value, count,
    neighbours.  ``generic``: id, neighbours, ``generic_value``: id, value,
    neighbours; a line with a bad id is dropped and a bad neighbour skipped, in
    every format.  Tokens are parted by blanks and tabs; counts are not relied on.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    skip = {"adj": 2, "adj_unit": 2, "wadj": 2, "wadj_nocount": 1, "bip": 2, "field": 3, "generic": 1, "generic_value": 2}[fmt]
    tokens = F.filter(F.split(F.trim(F.regexp_replace(F.col(line_col), "\t", " ")), " +"), lambda t: t != "")
    rows = lines.select(tokens.alias("t")).select(F.expr("try_cast(get(t, 0) as bigint)").alias("id"), "t").where("id is not null")
    body = F.when(F.size("t") > skip, F.slice("t", skip + 1, F.greatest(F.size("t") - skip, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    vertices = rows.select("id")
    if fmt == "bip":
        vertices = rows.select("id", (F.expr("try_cast(get(t, 1) as bigint)") == 0).alias("is_left"))
    if fmt in ("field", "generic_value"):
        vertices = rows.select("id", F.expr("try_cast(get(t, 1) as bigint)").alias("value"))
    if fmt.startswith("wadj"):
        pairs = F.transform(F.sequence(F.lit(0), F.greatest((F.size("n") / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get("n", 2 * i).alias("d"), F.get("n", 2 * i + 1).alias("w")))
        flat = rows.select("id", body.alias("n")).where("size(n) > 1").select("id", F.explode(pairs).alias("p"))
        edges = flat.select(F.col("id").alias("src"), F.expr("try_cast(p.d as bigint)").alias("dst"), F.expr("try_cast(p.w as double)").alias("weight"))
    else:
        flat = rows.select("id", F.explode(body).alias("n"))
        edges = flat.select(F.col("id").alias("src"), F.expr("try_cast(n as bigint)").alias("dst"))
        if fmt == "adj_unit":
            edges = edges.withColumn("weight", F.lit(1.0))
    edges = edges.where("dst is not null")
    return Graph(vertices, edges.where("src <> dst") if drop_self_loops else edges)


def read_graph(spark: SparkSession, paths: str | Sequence[str], fmt: str = "adj", drop_self_loops: bool = False) -> Graph:
    """A graph from one or several text files or folders."""
    return parse(spark.read.text(list(paths) if not isinstance(paths, str) else paths), fmt, drop_self_loops)


def read_edge_list(spark: SparkSession, paths: str | Sequence[str], weighted: bool = False) -> Graph:
    """A graph from lines ``src dst [weight]``; lines that do not parse, such as comments, are dropped."""
    t = F.split(F.trim(F.regexp_replace("value", "\t", " ")), " +")
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths).select(t.alias("t"))
    cols = [F.expr("try_cast(get(t, 0) as bigint)").alias("src"), F.expr("try_cast(get(t, 1) as bigint)").alias("dst")]
    if weighted:
        cols.append(F.expr("coalesce(try_cast(get(t, 2) as double), 1.0)").alias("weight"))
    return Graph(None, lines.select(*cols).where("src is not null and dst is not null"))


def read_tables(spark: SparkSession, edges: str, vertices: str | None = None, fmt: str = "parquet", **options) -> Graph:
    """A graph from tables with columns (src, dst, ...) and (id, ...)."""
    load = lambda path: spark.read.format(fmt).options(**options).load(path)
    return Graph(load(vertices) if vertices else None, load(edges))


def lines_of(df: DataFrame, *values: str, id_col: str = "id", decimals: int | None = None, missing: str = "-1") -> DataFrame:
    """One column of lines ``id<TAB>value ...``; nulls are written as ``missing``."""

    def shown(c: str):
        text = F.format_string(f"%.{decimals}f", c) if decimals is not None and dict(df.dtypes)[c] in ("double", "float") else F.col(c).cast("string")
        return F.when(F.col(c).isNull(), F.lit(missing)).otherwise(text)

    return df.select(F.concat(F.col(id_col).cast("string"), F.lit("\t"), F.concat_ws(" ", *(shown(c) for c in values))).alias("value"))


def sssp_lines(df: DataFrame) -> DataFrame:
    """``id<TAB>dist parent``, or ``id<TAB>unreachable``; the source's parent is -1."""
    reached = F.concat_ws(" ", F.col("dist").cast("string"), F.coalesce(F.col("parent"), F.lit(-1)).cast("string"))
    return df.select(F.concat(F.col("id").cast("string"), F.lit("\t"), F.when(F.col("dist").isNull(), "unreachable").otherwise(reached)).alias("value"))


def field_lines(graph: Graph, edges: DataFrame, value_col: str = "value") -> DataFrame:
    """Lines ``id value<TAB>nb v nb v ...``: a vertex, its value, and each neighbour with the value that ``edges`` (src, dst, value) carry, in order."""
    listed = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", F.col("value").alias("_v")))).alias("n"))
    full = graph.vertices.select("id", F.col(value_col).alias("_own")).join(listed, "id", "left")
    body = F.array_join(F.transform(F.coalesce("n", F.array().cast(full.schema["n"].dataType)), lambda x: F.concat_ws(" ", x["dst"].cast("string"), x["_v"].cast("string"))), " ")
    return full.select(F.concat(F.concat_ws(" ", F.col("id").cast("string"), F.col("_own").cast("string")), F.lit("\t"), body).alias("value"))


def adjacency_lines(graph: Graph, weight: str | None = None) -> DataFrame:
    """Lines of the ``adj`` format, or ``wadj`` with a weight column; neighbours in order."""
    cells = F.array_sort(F.collect_list(F.struct("dst", weight) if weight else F.struct("dst")))
    listed = graph.edges.groupBy(F.col("src").alias("id")).agg(cells.alias("n"))
    token = (lambda x: F.concat_ws(" ", x["dst"].cast("string"), x[weight].cast("string"))) if weight else (lambda x: x["dst"].cast("string"))
    full = graph.vertices.select("id").join(listed, "id", "left")
    count = F.coalesce(F.size("n"), F.lit(0))
    body = F.when(F.col("n").isNull(), "").otherwise(F.concat(F.lit(" "), F.array_join(F.transform("n", token), " ")))
    return full.select(F.concat(F.col("id").cast("string"), F.lit("\t"), F.when(F.col("n").isNull(), F.lit("0")).otherwise(count.cast("string")), body).alias("value"))


def write_lines(df: DataFrame, path: str, force: bool = True, max_records: int | None = None) -> None:
    """Write one column of lines; without ``force`` an existing folder is an error."""
    w = df.write.mode("overwrite" if force else "errorifexists")
    (w.option("maxRecordsPerFile", max_records) if max_records else w).text(path)
