import pytest
from pyspark.sql import functions as F

from vertexloom.algorithms import components, pagerank, sssp
from vertexloom.plans import runtime
from vertexloom.plans.runtime import Adjacency, Scratch, buckets, in_place, settings


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def superstep(spark, g):
    scratch = Scratch(spark, "plan")
    edges = Adjacency(scratch, g.edges)
    state = scratch.put(g.vertices.select("id").repartition(buckets(spark), "id"), by=["id"])
    with in_place(spark), settings(spark, autoBroadcastJoinThreshold="-1"):
        mail = edges.meet(state).select(F.col("e.dst").alias("to"), F.col("v.id").alias("m")).groupBy("to").agg(F.min("m").alias("m"))
        after = state.join(mail, F.col("id") == F.col("to"), "left").select("id", "m")
        return edges, after, after._jdf.queryExecution().executedPlan().toString()


def test_only_messages_travel_in_a_superstep(spark, graph):
    edges, after, plan = superstep(spark, graph([(k, (k * 7) % 50) for k in range(200)]))
    assert not edges.hubs and plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 1
    assert after.count() == 200


def test_hub_edges_are_dealt_over_cells(spark, graph, monkeypatch):
    monkeypatch.setattr(runtime, "HUB_PART", 4)
    monkeypatch.setattr(runtime, "SALT", 3)
    star = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(40, 45)]
    g = graph([*star, *((b, a) for a, b in star)])
    edges, after, plan = superstep(spark, g)
    assert edges.hubs == [0] and edges.edges.select("_cell").distinct().count() == 3
    assert plan.count("Exchange hashpartitioning") == 2  # vertices go to their cells, messages to their targets
    labels = dict(rows(components.connected_components(g)))
    assert all(labels[k] == (0 if k < 40 else 40) for k in range(46))
    assert dict(rows(components.connected_components(g, "sv"))) == labels
    assert rows(sssp.sssp(g, 1))[:3] == [(0, 1.0), (1, 0.0), (10, 2.0)]
    assert pagerank.pagerank(g).agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_scratch_deletes_what_it_wrote(spark):
    scratch = Scratch(spark, "gone")
    a, b = scratch.put(spark.range(5)), scratch.put(spark.range(5), by=["id"])
    assert a.count() == b.count() == 5
    scratch.drop(b)
    scratch.close()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.root)
    assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
