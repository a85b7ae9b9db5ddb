from pyspark.sql import functions as F

from vertexloom.algorithms import fieldbcast
from vertexloom.operators import ordering
from vertexloom.plans import superstep
from vertexloom.sources import logs, text


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_graph_creates_or_drops_unknown_ends(graph):
    assert rows(graph([(0, 1), (0, 9)], [0, 1]).vertices) == [(0,), (1,), (9,)]
    g = graph([(0, 1), (0, 9)], [0, 1], missing="drop")
    assert rows(g.vertices) == [(0,), (1,)] and rows(g.edges) == [(0, 1)]


def test_null_ends_and_repeated_ids_are_dropped(graph):
    g = graph([(0, 1), (None, 2), (1, None)], [0, 0, None])
    assert rows(g.edges) == [(0, 1)] and rows(g.vertices) == [(0,), (1,)]


def test_edge_operations(graph, spark):
    g = graph([(0, 1), (0, 1), (1, 1), (2, 0)])
    assert rows(g.dedup_edges().edges) == [(0, 1), (1, 1), (2, 0)]
    assert rows(g.drop_self_loops().reverse().edges) == [(0, 2), (1, 0), (1, 0)]
    assert rows(g.symmetrize().edges) == [(0, 1), (0, 2), (1, 0), (1, 1), (2, 0)]
    assert rows(g.degrees()) == [(0, 2, 1), (1, 1, 3), (2, 1, 0)]
    assert rows(g.prune_edges(spark.createDataFrame([(2,)], "id long")).edges) == [(0, 1), (0, 1), (1, 1)]
    assert rows(g.replace_edges(spark.createDataFrame([(0, 5)], "src long, dst long")).edges) == [(0, 5), (1, 1), (2, 0)]
    assert rows(g.add_vertices(spark.createDataFrame([(0,), (8,), (8,)], "id long")).vertices) == [(0,), (1,), (2,), (8,)]


def test_request_is_safe_or_drops(spark):
    state = spark.createDataFrame([(1, 2), (2, 9), (3, None)], "id long, ptr long")
    assert rows(superstep.request(state, "ptr", {"got": F.col("ptr")}).select("id", "got")) == [(1, 9), (2, None), (3, None)]
    assert rows(superstep.request(state, "ptr", {"got": F.col("ptr")}, safe=False).select("id", "got")) == [(1, 9)]


def test_messages_combine_and_unknown_targets_get_none(graph, spark):
    g = graph([(0, 2), (1, 2), (1, 0)])
    got = superstep.aggregate_messages(g.vertices, g.edges, {"m": F.col("v.id")}, {"s": F.sum("m")}, direction="both")
    assert rows(got) == [(0, 3), (1, 2), (2, 1)]
    sent = superstep.point_messages(spark.createDataFrame([(1, 7), (2, 1)], "id long, to long"), F.col("to"), {"m": F.col("id")}, known=spark.createDataFrame([(1,)], "id long"))
    assert rows(sent) == [(1, 2)]


def test_pregel_stops_hooks_and_reports(graph, spark):
    seen = []
    run = superstep.pregel(
        graph([(0, 1), (1, 2), (2, 3)]), init={"x": F.when(F.col("id") == 0, 1).otherwise(0)}, message={"m": F.col("v.x")}, combine={"m": F.max("m")},
        update={"x": F.greatest("x", "m")}, active=F.col("x") > F.col("old_x"), aggregates={"total": F.sum("x")}, hook=seen.append, stop=lambda s: s.aggregates["total"] >= 3,
    )
    assert run.reason == "stopped" and [s.aggregates["total"] for s in seen] == [2, 3]
    assert run.report(spark).count() == 2
    run = superstep.pregel(graph([(0, 1)]), init={"x": F.lit(0)}, message={"m": F.col("v.x")}, combine={"m": F.max("m")}, update={"x": F.lit(0)}, active=F.lit(False))
    assert run.reason == "quiescent" and len(run.steps) == 1


def test_phases_end_when_one_says_so():
    assert superstep.phases(lambda: True, lambda: False, lambda: True) == 2


def test_relay_and_field_broadcast(graph):
    g = graph([(0, 1, 2.0), (2, 1, 0.5)], weighted=True)
    assert rows(superstep.relay(g.vertices, g.edges, F.col("v.id"), lambda m: m + F.col("e.weight"), F.min)) == [(1, 2.0)]
    g = g._with(g.edges, g.vertices.withColumn("value", F.col("id") * 10))
    assert rows(fieldbcast.field_broadcast(g)) == [(0, 1, 10), (2, 1, 10)]


def test_order_numbers(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "k long")
    assert rows(ordering.order_numbers(df, "k").select("k", "order_no")) == sorted([(k, k) for k in range(101)], key=str)
    assert ordering.order_numbers(df.where("k < 0"), "k").count() == 0
    assert ordering.pick_one(df, "k").count() == 1


def lines(spark, *x):
    return spark.createDataFrame([(v,) for v in x], "value string")


def test_text_formats(spark):
    g = text.parse(lines(spark, "1\t2 0 3", "0\t0", "bad\t1 2", "5\t2 5 x"), "adj", drop_self_loops=True)
    assert rows(g.edges) == [(1, 0), (1, 3)] and rows(g.vertices) == [(0,), (1,), (3,), (5,)]
    assert rows(text.parse(lines(spark, "0\t1 4 2.5"), "wadj").edges) == [(0, 4, 2.5)]
    assert rows(text.parse(lines(spark, "0\t4 2.5 6 1"), "wadj_nocount").edges) == [(0, 4, 2.5), (0, 6, 1.0)]
    assert rows(text.parse(lines(spark, "0\t2 4 6"), "adj_unit").edges) == [(0, 4, 1.0), (0, 6, 1.0)]
    assert (7, True) in rows(text.parse(lines(spark, "7\t0 10 11", "10\t1 7"), "bip").vertices)
    g = text.parse(lines(spark, "3 42 2 5 6"), "field")
    assert (3, 42) in rows(g.vertices) and rows(g.edges) == [(3, 5), (3, 6)]
    assert rows(text.parse(lines(spark, "3 2 5 x 6", "y 1"), "generic").edges) == [(3, 2), (3, 5), (3, 6)]
    assert rows(text.parse(lines(spark, "3 2 5"), "generic_value").edges) == [(3, 5)]


def test_sinks(spark, graph, tmp_path):
    dist = spark.createDataFrame([(0, 0.0, None), (1, 2.5, 0), (2, None, None)], "id long, dist double, parent long")
    assert rows(text.sssp_lines(dist)) == [("0\t0.0 -1",), ("1\t2.5 0",), ("2\tunreachable",)]
    g = graph([(0, 1), (0, 2)], [0, 1, 2])
    path = f"file://{tmp_path}/out"
    text.write_lines(text.adjacency_lines(g), path)
    assert rows(text.read_graph(spark, path).edges) == [(0, 1), (0, 2)]
    assert rows(text.read_graph(spark, [path, path]).edges) == [(0, 1), (0, 1), (0, 2), (0, 2)]
    assert rows(text.lines_of(spark.createDataFrame([(1, 0.5)], "id long, r double"), "r", decimals=6)) == [("1\t0.500000",)]


def test_log_totals(spark):
    df = spark.createDataFrame([(0, "Message Transmission: 5", 1), (0, "Message Transmission: 7", 2), (1, "x 9", 1), (1, "Message Transmission statistics 3 of 4.", 2)], "machine int, value string, o int")
    got = logs.machine_messages(df, order_col="o")
    assert rows(got) == [(0, 7), (1, 4)] and logs.total_messages(got).first()[0] == 11
