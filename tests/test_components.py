import random

import pytest
from pyspark.sql import functions as F

from vertexloom.algorithms import coloring, components, matching, pagerank, sssp
from vertexloom.operators.stars import star_components
from vertexloom.plans import gas

ALGORITHMS = ["hashmin", "sv", "pivot", "stars"]


def labels(df):
    return {r["id"]: r["label"] for r in df.collect()}


def truth(edges, ids):
    parent = {i: i for i in [*ids, *(x for e in edges for x in e)]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_path_whose_trees_are_stars_too_early(graph, algorithm):
    edges = [(0, 4), (4, 3), (3, 2), (2, 1)]
    assert labels(components.connected_components(graph(edges), algorithm)) == dict.fromkeys(range(5), 0)


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_triangles_and_an_isolated_vertex(graph, algorithm):
    edges = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (7, 7)]
    assert labels(components.connected_components(graph(edges, range(8)), algorithm)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_random_graph_agrees_with_union_find(graph, algorithm):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    assert labels(components.connected_components(graph(edges, range(60)), algorithm)) == truth(edges, range(60))


def test_directed_labels_follow_edges(graph):
    assert labels(components.connected_components(graph([(0, 1), (2, 1), (1, 3)]), directed=True)) == {0: 0, 1: 0, 2: 2, 3: 0}


def test_pivot_label_marks_the_pivots_component(graph):
    got = labels(components.connected_components(graph([(1, 2), (5, 6)]), "pivot", pivot=6, pivot_label=-1))
    assert got == {1: 1, 2: 1, 5: -1, 6: -1}


def test_sizes_and_reach(graph):
    g = graph([(0, 1), (1, 2), (4, 5)])
    sizes = components.component_sizes(components.connected_components(g))
    assert {(r["label"], r["size"]) for r in sizes.collect()} == {(0, 3), (4, 2)}
    assert {(r["id"], r["hops"]) for r in components.bfs_reachable(g, 0).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(None, 3), (500, 500)], "a long, b long")
    got = {r["id"]: r["component"] for r in star_components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500}


def test_no_links(spark):
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unknown_algorithm(graph):
    with pytest.raises(ValueError):
        components.connected_components(graph([(0, 1)]), "nope")


def test_searches_that_run_out_of_rounds_fail(graph, monkeypatch):
    g = graph([(k, k + 1) for k in range(8)])
    with pytest.raises(RuntimeError, match="did not end in 6"):
        components.connected_components(g, "pivot", max_iter=6, pivot=0)
    assert set(labels(components.connected_components(g, "pivot", max_iter=9, pivot=0)).values()) == {0}
    with pytest.raises(RuntimeError, match="did not settle in 3"):
        sssp.sssp(g, 0, max_iter=3)
    crossed = graph([(0, 1), (0, 3), (2, 1), (2, 3)])
    with pytest.raises(RuntimeError, match="did not settle in 1"):
        matching.bipartite_matching(crossed._with(crossed.edges, crossed.vertices.withColumn("is_left", F.col("id") % 2 == 0)), max_rounds=1)
    with pytest.raises(RuntimeError, match="did not settle in 1"):
        coloring.color(g, max_rounds=1)
    monkeypatch.setattr(pagerank, "MOST_UPDATES", 2)
    with pytest.raises(RuntimeError, match="did not settle in 2"):
        pagerank.pagerank(g, normalized=False, dangling="drop", tol=1e-6)
    with pytest.raises(RuntimeError, match="still signalled after 2"):
        gas.gather_apply_scatter(g, init={"x": F.col("id")}, gather={"m": F.col("v.x")}, combine={"m": F.min("m")}, apply={"x": F.least("x", "m")}, scatter=F.col("x") < F.col("old_x"), max_iter=2)
