from pyspark.sql import functions as F

from vertexloom.algorithms import pagerank
from vertexloom.plans import gas, superstep
from vertexloom.streaming.components import StreamingComponents


def test_gather_apply_scatter_equals_dynamic_ranks(graph):
    g = graph([(0, 1), (1, 2), (2, 0), (2, 1), (3, 2)])
    want = {r["id"]: round(r["rank"], 9) for r in pagerank.pagerank(g, normalized=False, dangling="drop", tol=0.01).collect()}
    ranked = gas.transform_vertices(g).vertices.join(g.degrees().select("id", "out_degree"), "id")
    got = gas.gather_apply_scatter(
        g._with(g.edges, ranked), init={"rank": F.lit(1.0), "out_degree": F.col("out_degree")}, gather={"m": F.col("v.rank") / F.col("v.out_degree")}, combine={"m": F.sum("m")},
        apply={"rank": 0.15 + 0.85 * F.coalesce("m", F.lit(0.0))}, scatter=F.abs(F.col("rank") - F.col("old_rank")) > 0.01,
    )
    assert {r["id"]: round(r["rank"], 9) for r in got.collect()} == want


def test_partition_counts(graph):
    g = graph([(0, 1), (1, 2), (2, 0)])
    sent = superstep.messages_to(g.vertices, g.edges, {"m": F.col("v.id")})
    assert superstep.partition_counts(sent).agg(F.sum("messages")).first()[0] == 3


def test_components_over_a_stream(spark, tmp_path):
    source, live = f"{tmp_path}/links", StreamingComponents(spark)
    query = None
    for batch in ([(1, 2), (5, 6)], [(2, 5), (8, 9)], [(2, 5), (9, 9)]):
        spark.createDataFrame(batch, "a long, b long").coalesce(1).write.mode("append").parquet(source)
        if query is None:
            query = live.start(spark.readStream.schema("a long, b long").parquet(source), f"{tmp_path}/at")
        query.processAllAvailable()
    query.stop()
    assert {(r["id"], r["component"]) for r in live.labels.collect()} == {(1, 1), (2, 1), (5, 1), (6, 1), (8, 8), (9, 8)}
