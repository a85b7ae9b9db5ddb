"""Lineage cuts and settings for iterative plans.

Iterative plans write their state between supersteps.  State goes to the folder
named by ``spark.checkpoint.dir``, which a cluster shares between its executors,
so a lost executor costs a re-run of one superstep and never the whole job.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate state: ``spark.checkpoint.dir``, or a temporary one where that is unset.

    A folder of one machine is no place for a cluster's state, so it stands in only
    where the session runs on one machine.
    """
    global _LOCAL_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None or not os.path.isdir(_LOCAL_DIR):
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _LOCAL_DIR = tempfile.mkdtemp(prefix="vertexloom-", dir="/tmp/checkpoints")
    return f"file://{_LOCAL_DIR}"


class Scratch:
    """Parquet tables in the shared folder that replace lineage between steps.

    ``put`` writes a frame and returns a reader of the written table; ``drop``
    deletes tables whose content no later step reads, ``close`` all of them.  With
    ``by`` the table keeps a layout: its rows are dealt by a hash of these columns
    into as many buckets as the session has shuffle partitions, and later joins and
    groupings on them find the rows in place.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, partition_by: str | None = None, by: list[str] | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        # later steps read the table, so what was shuffled to make it goes at once, not when the driver next collects
        with settings(self.spark, classic__shuffleDependency__fileCleanup__enabled="true"):
            if by:
                name = f"vertexloom_{self.root.rsplit('-', 1)[1]}_{self.count:04d}"
                writer.format("parquet").option("path", path).bucketBy(buckets(self.spark), *by).saveAsTable(name)
            else:
                writer.parquet(path)
        if by:
            out = self.spark.table(name)
            out._vertexloom_table = name
        else:
            out = self.spark.read.schema(df.schema).parquet(path)
        out._vertexloom_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if name := getattr(df, "_vertexloom_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if path := getattr(df, "_vertexloom_path", None):
                self._delete(path)

    def close(self) -> None:
        """Delete everything that was put; for the end of jobs whose result is no reader of a table."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A vertex is a hub if it has more than this part of all edges, so hubs are never more; so many tasks share a hub's edges.
HUB_PART, SALT = 2_000, 64


class Adjacency:
    """Edges laid out once by one end, so that no step moves them again; the edges of hubs are dealt over ``SALT`` cells.

    Rows of vertices meet their edges through ``meet``; only they travel.
    """

    def __init__(self, scratch: Scratch, edges: DataFrame, end: str = "src"):
        self.end, self.scratch = end, scratch
        # written once as they come, so that counting and laying out need not make them again
        plain = scratch.put(edges)
        self.total, self.hubs = plain.count(), []
        if self.total > HUB_PART * SALT:
            counts = plain.groupBy(end).agg(F.count("*").alias("c"))
            self.hubs = [r[0] for r in counts.where(F.col("c") * HUB_PART > F.lit(self.total)).select(end).collect()]
        laid = plain
        if self.hubs:
            other = "dst" if end == "src" else "src"
            laid = plain.withColumn("_cell", F.when(F.col(end).isin(self.hubs), F.pmod(F.xxhash64(other), F.lit(SALT))).otherwise(F.lit(0)).cast("int"))
        self.by = [end, "_cell"] if self.hubs else [end]
        self.edges = scratch.put(laid.repartition(buckets(scratch.spark), *self.by), by=self.by)
        scratch.drop(plain)

    def meet(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """``rows`` (alias ``v``) with the edges (alias ``e``) of the vertices that ``key`` names."""
        e = self.edges.alias("e")
        if not self.hubs:
            return rows.alias("v").join(e, F.col(f"v.{key}") == F.col(f"e.{self.end}"))
        cells = F.when(F.col(key).isin(self.hubs), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
        dealt = rows.withColumn("_cell", F.explode(cells)).alias("v")
        return dealt.join(e, (F.col(f"v.{key}") == F.col(f"e.{self.end}")) & (F.col("v._cell") == F.col("e._cell")))

    def drop(self) -> None:
        self.scratch.drop(self.edges)


def in_place(spark: SparkSession):
    """Settings for steps over laid-out tables: re-planning would merge shuffle partitions that buckets are to meet."""
    return settings(spark, adaptive__enabled="false", sources__bucketing__autoBucketedScan__enabled="false")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Set SQL settings (``a__b`` means ``spark.sql.a.b``) for a block and restore the caller's afterwards."""
    keys = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
