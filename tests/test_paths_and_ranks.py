import pytest

from vertexloom.algorithms import diameter, pagerank, sssp


def dist(df):
    return {r["id"]: r["dist"] for r in df.collect()}


def test_detour_is_shorter_and_ties_take_the_smallest_parent(graph):
    g = graph([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0)], weighted=True)
    got = {r["id"]: (r["dist"], r["parent"]) for r in sssp.sssp(g, 0, "weight", with_parent=True).collect()}
    assert got == {0: (0.0, None), 1: (2.0, 2), 2: (1.0, 0)}
    g = graph([(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)], weighted=True)
    assert {r["id"]: r["parent"] for r in sssp.sssp(g, 0, "weight", with_parent=True).collect()}[3] == 1


def test_star_and_unreachable(graph):
    edges = [(0, i) for i in range(1, 5)] + [(i, 0) for i in range(1, 5)]
    assert dist(sssp.sssp(graph(edges, [*range(5), 9]), 1)) == {0: 1.0, 1: 0.0, 2: 2.0, 3: 2.0, 4: 2.0, 9: None}


def test_unit_weights_equal_hops(graph):
    edges = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4)]
    weighted = graph([(*e, 1.0) for e in edges], weighted=True)
    assert dist(sssp.sssp(weighted, 0, "weight")) == dist(sssp.sssp(graph(edges), 0))


def ranks_by_hand(edges, n, rounds, redistribute, normalized=True):
    out = [[b for a, b in edges if a == v] for v in range(n)]
    pr = [1 / n if normalized else 1.0] * n
    for _ in range(rounds):
        new = [0.15 / n if normalized else 0.15] * n
        for v in range(n):
            for b in out[v]:
                new[b] += 0.85 * pr[v] / len(out[v])
            if not out[v] and redistribute:
                new = [x + 0.85 * pr[v] / n for x in new]
        pr = new
    return pr


@pytest.mark.parametrize("redistribute", [True, False])
def test_ranks_with_dangling_and_parallel_edges(graph, redistribute):
    edges = [(0, 1), (0, 2), (0, 2), (1, 0), (3, 0)]
    got = {r["id"]: r["rank"] for r in pagerank.pagerank(graph(edges), dangling="redistribute" if redistribute else "drop").collect()}
    want = ranks_by_hand(edges, 4, 10, redistribute)
    assert [got[i] for i in range(4)] == pytest.approx(want)
    if redistribute:
        assert sum(got.values()) == pytest.approx(1.0)


def test_dynamic_ranks_settle_near_the_fixpoint(graph):
    edges = [(0, 1), (1, 2), (2, 0), (2, 1), (3, 2)]
    got = {r["id"]: r["rank"] for r in pagerank.pagerank(graph(edges), normalized=False, dangling="drop", tol=1e-4).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(ranks_by_hand(edges, 4, 60, False, normalized=False), abs=2e-3)


def test_neighbourhood_function_grows_and_settles(graph):
    edges = [(i, i + 1) for i in range(6)] + [(i + 1, i) for i in range(6)]
    pairs = [r["pairs"] for r in diameter.neighbourhood_function(graph(edges), 10).orderBy("hop").collect()]
    assert pairs == sorted(pairs) and pairs[6] == pairs[10]
    assert 1 <= diameter.approx_diameter(graph(edges)) <= 7


def test_growth_that_does_not_end_gives_no_diameter(spark, graph):
    assert diameter.approx_diameter(graph([], [])) is None
    path = [(k, k + 1) for k in range(6)]
    both = graph(path + [(b, a) for a, b in path])
    assert diameter.approx_diameter(both, max_hops=2) is None
    assert 1 <= diameter.approx_diameter(both) <= 7


def test_growth_of_exactly_the_tolerance_goes_on_as_in_sql():
    import duckdb

    for before, after in ((10_000, 10_001), (10_000, 10_000), (30_010_000, 30_013_001), (2_260_000, 2_260_226), (123_450_000, 123_462_345)):
        assert diameter._settled(before, after, 1e-4) == duckdb.sql(f"SELECT {after}::BIGINT < {before}::BIGINT * 1.0001").fetchall()[0][0]
