"""Global sort with order numbers, and the reservoir pick of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.hashing import hash32
from vertexloom.plans.runtime import Scratch


def sample_sort(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """``df`` in key order: range partitions from a sample, then a sort within each."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def order_numbers(df: DataFrame, *keys: str, name: str = "order_no", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place, from 0, in key order.

    Only the partitions' row counts reach the driver; keys should be unique for a
    repeatable order among equal ones.
    """
    scratch = Scratch(df.sparkSession, "sort")
    # rows are numbered where the sort leaves them: partition and place are the parts of one number
    ranged = scratch.put(sample_sort(df, *keys, partitions=partitions).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["c"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect()}
    start, at = {}, 0
    for p in sorted(counts):
        start[p], at = at, at + counts[p]
    # one row for each range partition
    before = F.broadcast(df.sparkSession.createDataFrame(list(start.items()) or [(0, 0)], "_part int, _before long"))
    return ranged.join(before, part == F.col("_part")).withColumn(name, F.col("_before") + place).drop("_part", "_at", "_before")


def pick_one(df: DataFrame, id_col: str = "id", seed: int = 0) -> DataFrame:
    """One row, drawn by a hash of its id."""
    return df.orderBy(hash32(F.col(id_col), F.lit(seed)), id_col).limit(1)
