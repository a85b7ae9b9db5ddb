"""Totals of message counts in worker logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def machine_messages(lines: DataFrame, marker: str = "Message Transmission", machine_col: str = "machine", line_col: str = "value", order_col: str | None = None) -> DataFrame:
    """(machine, messages): the last number of each machine's last line that holds ``marker``."""
    number = F.regexp_extract(line_col, r"([0-9]+)[^0-9]*$", 1).cast("long")
    rows = lines.where(F.col(line_col).contains(marker)).select(machine_col, number.alias("n"), (F.col(order_col) if order_col else F.monotonically_increasing_id()).alias("o")).where("n is not null")
    return rows.groupBy(machine_col).agg(F.max_by("n", "o").alias("messages"))


def total_messages(machines: DataFrame) -> DataFrame:
    return machines.agg(F.coalesce(F.sum("messages"), F.lit(0)).cast("long").alias("messages"))
