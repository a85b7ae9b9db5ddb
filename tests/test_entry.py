import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "label"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["cc_weak_directed", "pagerank_norm", "sssp_parents", "nf_fm", "bmm", "color_luby", "sample_sort_rank", "adj_roundtrip", "combiners", "msg_report", "gas_sssp", "edge_values", "color_greedy", "cc_truncated", "field_text"])
def test_graph_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, map(tuple, want)))
