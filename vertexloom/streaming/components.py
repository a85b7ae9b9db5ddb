"""Component labels kept up to date over a stream of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertexloom.operators.stars import star_components
from vertexloom.plans.runtime import Scratch


class StreamingComponents:
    """Labels (id, component) of all links seen so far.

    Each micro-batch is contracted by the present labels, so its work follows the
    batch and the components it joins, and relabels only these.  A batch that is
    delivered again changes nothing.
    """

    def __init__(self, spark: SparkSession):
        self.scratch = Scratch(spark, "stream")
        self.labels = self.scratch.put(spark.createDataFrame([], "id long, component long"))

    def update(self, links: DataFrame, epoch: int = 0) -> None:
        """Take in one batch of links (a, b)."""
        of = self.labels.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
        ends = links.join(of, F.col("a") == F.col("_i"), "left").select(F.coalesce("_c", "a").alias("a"), "b")
        ends = ends.join(of, F.col("b") == F.col("_i"), "left").select("a", F.coalesce("_c", "b").alias("b"))
        moved = self.scratch.put(star_components(ends, scratch=self.scratch))
        to = moved.select(F.col("id").alias("_f"), F.col("component").alias("_t"))
        named = self.labels.join(to, F.col("component") == F.col("_f"), "left").select("id", F.coalesce("_t", "component").alias("component"))
        fresh = moved.join(self.labels.select("id"), "id", "left_anti")
        before, self.labels = self.labels, self.scratch.put(named.union(fresh))
        self.scratch.drop(before, moved)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over a streaming frame of links until stopped."""
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).start()
