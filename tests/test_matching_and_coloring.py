import random

import pytest
from pyspark.sql import functions as F

from vertexloom.algorithms import coloring, matching


def sided(g):
    return g._with(g.edges, g.vertices.withColumn("is_left", F.col("id") % 2 == 0))


@pytest.mark.parametrize("finish", ["parallel", "local"])
def test_crossing_edges_match_greedily(graph, finish):
    g = sided(graph([(0, 1), (0, 3), (2, 1)]))
    assert {r["id"]: r["match_to"] for r in matching.bipartite_matching(g, finish=finish).collect()} == {0: 1, 1: 0, 2: None, 3: None}


@pytest.mark.parametrize("finish", ["parallel", "local"])
def test_random_matching_is_maximal_and_the_same_either_way(graph, finish):
    rng = random.Random(3)
    g = sided(graph([(2 * rng.randrange(20), 2 * rng.randrange(20) + 1) for _ in range(60)]))
    got = matching.bipartite_matching(g, finish=finish)
    assert matching.count_augmentable(g, got).first()["violations"] == 0
    other = matching.bipartite_matching(g, finish="parallel" if finish == "local" else "local")
    assert set(map(tuple, got.collect())) == set(map(tuple, other.collect()))


@pytest.mark.parametrize("how", [{}, {"finish": "local"}, {"prune": "lazy"}, {"algorithm": "greedy"}])
def test_colourings_are_proper(graph, how):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)] + [(7, 7)]
    g = graph(edges, range(32))
    got = coloring.color(g, **how)
    assert got.count() == 32 and got.select("id").distinct().count() == 32
    assert coloring.count_color_conflicts(g, got).first()["conflicts"] == 0


def test_conflicts_are_counted(graph, spark):
    colors = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "id long, color int")
    assert coloring.count_color_conflicts(graph([(0, 1), (1, 2)]), colors).first()["conflicts"] == 1
