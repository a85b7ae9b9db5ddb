"""Registered graph queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom import fixtures
from vertexloom.algorithms import coloring, components, diameter, fieldbcast, matching, pagerank, sssp
from vertexloom.fixtures import ORDER_CHAIN, PART_SUPPLIER, SPARSE, order_chain, part_supplier, sparse
from vertexloom.graph import Graph
from vertexloom.operators import ordering
from vertexloom.plans import gas, superstep
from vertexloom.plans.edge_values import edge_valued
from vertexloom.plans.runtime import Scratch
from vertexloom.sources import logs, text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- components -----------------------------------------------------------------------------------------------------

REACH = "r(id, label) AS (SELECT id, id FROM v UNION SELECT e.dst, r.label FROM r JOIN e ON e.src = r.id),\nlabels AS MATERIALIZED (SELECT id, min(label) AS label FROM r GROUP BY 1)"
CC = f"WITH RECURSIVE {SPARSE}, {REACH} SELECT id, label FROM labels"
#: Smallest id of the largest component, the smaller one on ties.
SOURCE = "s AS MATERIALIZED (SELECT label AS id FROM labels GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)"


@query(CC)
def cc_hashmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(sparse(spark, sf_dir), "hashmin")


@query(CC)
def cc_sv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(sparse(spark, sf_dir), "sv")


@query(CC)
def cc_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(sparse(spark, sf_dir), "pivot")


@query(CC)
def cc_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(sparse(spark, sf_dir), "stars")


USING_KEY = """r(id, label) USING KEY (id) AS (
  SELECT id, id FROM v UNION
  SELECT e.dst, min(r.label) FROM r JOIN e ON e.src = r.id JOIN recurring.r AS c ON c.id = e.dst WHERE r.label < c.label GROUP BY e.dst)"""


@query(f"WITH RECURSIVE {ORDER_CHAIN}, {USING_KEY} SELECT id, label FROM r")
def cc_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(order_chain(spark, sf_dir), directed=True)


WEAK = """d AS (SELECT DISTINCT 2*l_partkey AS a, 2*l_suppkey+1 AS b FROM lineitem),
e AS MATERIALIZED (SELECT a AS src, b AS dst FROM d UNION ALL SELECT b, a FROM d),
v AS MATERIALIZED (SELECT DISTINCT src AS id FROM e)"""


@query(f"WITH RECURSIVE {WEAK}, {USING_KEY} SELECT id, label FROM r")
def cc_weak_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(part_supplier(spark, sf_dir))


@query(f"WITH RECURSIVE {SPARSE}, {REACH} SELECT label, count(*) AS size FROM labels GROUP BY 1")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.component_sizes(cc_sv(spark, sf_dir))


def _source(spark: SparkSession, sf_dir: str) -> int:
    top = component_sizes(spark, sf_dir).orderBy(F.desc("size"), "label").first()
    return top["label"] if top else 0


BFS = f"WITH RECURSIVE {SPARSE}, {REACH}, {SOURCE}, b(id, hops) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM s UNION SELECT e.dst, min(b.hops + 1) FROM b JOIN e ON e.src = b.id LEFT JOIN recurring.b AS c ON c.id = e.dst WHERE c.id IS NULL GROUP BY e.dst)"


@query(f"{BFS} SELECT id, hops FROM b")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.bfs_reachable(sparse(spark, sf_dir), _source(spark, sf_dir))


# --- shortest paths -------------------------------------------------------------------------------------------------

DIST = f"WITH RECURSIVE {SPARSE}, {REACH}, {SOURCE}, d(id, dist) USING KEY (id) AS (SELECT id, CAST(0 AS DOUBLE) FROM s UNION SELECT e.dst, min(d.dist + e.weight) FROM d JOIN e ON e.src = d.id LEFT JOIN recurring.d AS c ON c.id = e.dst WHERE c.id IS NULL OR d.dist + e.weight < c.dist GROUP BY e.dst)"


@query(f"{DIST} SELECT v.id, d.dist FROM v LEFT JOIN d USING (id)")
def sssp_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sssp.sssp(sparse(spark, sf_dir), _source(spark, sf_dir), "weight")


@query(f"{DIST} SELECT v.id, d.dist, (SELECT min(e.src) FROM e JOIN d AS u ON u.id = e.src WHERE e.dst = v.id AND v.id <> (SELECT id FROM s) AND u.dist + e.weight = d.dist) AS parent FROM v LEFT JOIN d USING (id)")
def sssp_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sssp.sssp(sparse(spark, sf_dir), _source(spark, sf_dir), "weight", with_parent=True)


@query(f"{BFS} SELECT v.id, CAST(b.hops AS DOUBLE) AS dist FROM v LEFT JOIN b USING (id)")
def sssp_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sssp.sssp(sparse(spark, sf_dir), _source(spark, sf_dir))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def sssp_parent_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that could still shorten a way, and parents that do not explain a distance."""
    g = sparse(spark, sf_dir)
    found = sssp.sssp(g, _source(spark, sf_dir), "weight", with_parent=True)
    ends = g.edges.join(found.select(F.col("id").alias("src"), F.col("dist").alias("a")), "src").join(found.select(F.col("id").alias("dst"), F.col("dist").alias("b"), "parent"), "dst")
    wrong = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("b") > F.col("a") + F.col("weight"))) | (F.col("parent") == F.col("src")) & (F.col("b") != F.col("a") + F.col("weight"))
    return ends.agg(F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).cast("long").alias("violations"))


# --- PageRank -------------------------------------------------------------------------------------------------------


def pagerank_sql(graph: str, rounds: int, normalized: bool, redistribute: bool) -> str:
    n = "(SELECT count(*) FROM v)"
    first, base = (f"1.0 / {n}", f"0.15 / {n}") if normalized else ("CAST(1 AS DOUBLE)", "0.15")
    parts = [graph, "g AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY 1)", f"r0 AS MATERIALIZED (SELECT id, CAST({first} AS DOUBLE) AS pr FROM v)"]
    for k in range(rounds):
        lost = f"(SELECT coalesce(sum(pr), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM g)) / {n}" if redistribute else "0.0"
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT v.id, {base} + 0.85 * (coalesce(m.s, 0) + {lost}) AS pr FROM v LEFT JOIN (SELECT e.dst AS id, sum(r.pr / g.deg) AS s FROM r{k} r JOIN g ON g.src = r.id JOIN e ON e.src = r.id GROUP BY 1) m USING (id))")
    return "WITH " + ",\n".join(parts) + f"\nSELECT id, round(pr, 9) AS rank FROM r{rounds}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("rank", 9).alias("rank"))


@query(pagerank_sql(PART_SUPPLIER, 10, True, True))
def pagerank_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pagerank.pagerank(part_supplier(spark, sf_dir)))


@query(pagerank_sql(ORDER_CHAIN, 10, False, False).replace("round(pr, 9)", "round(pr, 6)"))
def pagerank_unnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pagerank.pagerank(order_chain(spark, sf_dir), normalized=False, dangling="drop")
    return found.select("id", F.round("rank", 6).alias("rank"))


@query(pagerank_sql(PART_SUPPLIER, 9, True, False))
def pagerank_dangling_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pagerank.pagerank(part_supplier(spark, sf_dir), max_iter=9, dangling="drop"))


def dynamic_sql(graph: str, rounds: int) -> str:
    parts = [graph, "g AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY 1)", "r0 AS MATERIALIZED (SELECT id, CAST(1 AS DOUBLE) AS pr, true AS act FROM v)"]
    for k in range(rounds):
        parts.append(f"m{k} AS MATERIALIZED (SELECT r.id, CASE WHEN r.act THEN 0.15 + 0.85 * coalesce(m.s, 0) ELSE r.pr END AS pr, r.act AND abs(0.15 + 0.85 * coalesce(m.s, 0) - r.pr) > 0.01 AS moved FROM r{k} r LEFT JOIN (SELECT e.dst AS id, sum(r.pr / g.deg) AS s FROM r{k} r JOIN g ON g.src = r.id JOIN e ON e.src = r.id GROUP BY 1) m USING (id))")
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT id, pr, id IN (SELECT e.dst FROM e JOIN m{k} w ON w.id = e.src WHERE w.moved) AS act FROM m{k})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT id, round(pr, 6) AS rank FROM r{rounds}"


@query(dynamic_sql(ORDER_CHAIN, 16))
def pagerank_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pagerank.pagerank(order_chain(spark, sf_dir), normalized=False, dangling="drop", tol=0.01)
    return found.select("id", F.round("rank", 6).alias("rank"))


@query("SELECT CAST(1 AS DOUBLE) AS total")
def pagerank_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank.pagerank(part_supplier(spark, sf_dir)).agg(F.round(F.sum("rank"), 6).alias("total"))


# --- neighbourhood function -----------------------------------------------------------------------------------------

HASH = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
_H = HASH.format("v.id || ':' || j.j || ':0'")
LOWEST = " + ".join(f"bit_count((~b{j} & (b{j} + 1)) - 1)" for j in range(10))
PAIRS = f"CAST(sum(CAST(floor(pow(2.0, ({LOWEST}) / 10.0) / 0.77351) AS BIGINT)) AS BIGINT)"


def hops_sql(hops: int) -> str:
    masks = ", ".join(f"max(CASE WHEN j = {j} THEN CAST(pow(2, CASE WHEN h = 0 THEN 31 ELSE bit_count((h & -h) - 1) END) AS BIGINT) END) AS b{j}" for j in range(10))
    parts = [SPARSE, f"h AS (SELECT v.id, j.j, {_H} AS h FROM v, (SELECT unnest(range(10)) AS j) j)", f"n0 AS MATERIALIZED (SELECT id, {masks} FROM h GROUP BY id)"]
    for k in range(hops):
        got = ", ".join(f"bit_or(n.b{j}) AS b{j}" for j in range(10))
        new = ", ".join(f"n.b{j} | coalesce(m.b{j}, 0) AS b{j}" for j in range(10))
        parts.append(f"n{k + 1} AS MATERIALIZED (SELECT n.id, {new} FROM n{k} n LEFT JOIN (SELECT e.dst AS id, {got} FROM n{k} n JOIN e ON e.src = n.id GROUP BY 1) m USING (id))")
    parts.append("f AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS hop, {PAIRS} AS pairs FROM n{k}" for k in range(hops + 1)) + ")")
    return "WITH " + ",\n".join(parts)


@query(hops_sql(6) + "\nSELECT hop, pairs FROM f")
def nf_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diameter.neighbourhood_function(sparse(spark, sf_dir), 6)


@query(hops_sql(24) + "\nSELECT min(a.hop) AS diameter FROM f a JOIN f b ON b.hop = a.hop - 1 WHERE a.pairs < b.pairs * 1.0001")
def approx_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diameter.approx_diameter(sparse(spark, sf_dir))
    return spark.createDataFrame([(found,)], "diameter int")


# --- matching -------------------------------------------------------------------------------------------------------


def matching_sql(rounds: int) -> str:
    parts = [SPARSE, "x0 AS MATERIALIZED (SELECT a AS l, b AS r FROM p)"]
    for k in range(rounds):
        parts.append(f"t{k} AS MATERIALIZED (SELECT l, min(r) AS r FROM (SELECT r, min(l) AS l FROM x{k} GROUP BY r) GROUP BY l)")
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT l, r FROM x{k} WHERE l NOT IN (SELECT l FROM t{k}) AND r NOT IN (SELECT r FROM t{k}))")
    parts.append("t AS (" + " UNION ALL ".join(f"SELECT l, r FROM t{k}" for k in range(rounds)) + ")")
    return "WITH " + ",\n".join(parts) + "\nSELECT v.id, coalesce(a.r, b.l) AS match_to FROM v LEFT JOIN t a ON a.l = v.id LEFT JOIN t b ON b.r = v.id"


def _sided(g: Graph) -> Graph:
    return g._with(g.edges, g.vertices.withColumn("is_left", F.col("id") % 2 == 0))


@query(matching_sql(12))
def bmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.bipartite_matching(_sided(sparse(spark, sf_dir)))


@query(matching_sql(12))
def bmm_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.bipartite_matching(_sided(sparse(spark, sf_dir)), finish="local")


@query("SELECT CAST(0 AS BIGINT) AS violations")
def bmm_is_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sided(part_supplier(spark, sf_dir))
    return matching.count_augmentable(g, matching.bipartite_matching(g))


# --- colouring ------------------------------------------------------------------------------------------------------


def luby_sql(rounds: int) -> str:
    parts = [SPARSE, "e0 AS MATERIALIZED (SELECT src, dst FROM e)", "v0 AS MATERIALIZED (SELECT id FROM v)"]
    for k in range(rounds):
        u = HASH.format(f"v.id || ':{k}:0'") + " / 4294967296.0"
        parts.append(f"s{k} AS MATERIALIZED (SELECT v.id FROM v{k} v LEFT JOIN (SELECT src AS id, count(*) AS deg FROM e{k} GROUP BY 1) d USING (id) WHERE d.deg IS NULL OR {u} < 1.0 / (2 * d.deg))")
        parts.append(f"w{k} AS MATERIALIZED (SELECT id FROM s{k} WHERE id NOT IN (SELECT dst FROM e{k} WHERE src < dst AND src IN (SELECT id FROM s{k}) AND dst IN (SELECT id FROM s{k})))")
        parts.append(f"v{k + 1} AS MATERIALIZED (SELECT id FROM v{k} WHERE id NOT IN (SELECT id FROM w{k}))")
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT src, dst FROM e{k} WHERE src NOT IN (SELECT id FROM w{k}) AND dst NOT IN (SELECT id FROM w{k}))")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT id, CAST({k} AS INTEGER) AS color FROM w{k}" for k in range(rounds))


@query(luby_sql(20))
def color_luby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coloring.color(sparse(spark, sf_dir))


def _conflicts(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    g = sparse(spark, sf_dir)
    return coloring.count_color_conflicts(g, coloring.color(g, **how))


NO_CONFLICTS = "SELECT CAST(0 AS BIGINT) AS conflicts"


@query(NO_CONFLICTS)
def color_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir, finish="local", local_threshold=200)


@query(NO_CONFLICTS)
def color_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir, prune="lazy")


@query(NO_CONFLICTS)
def color_greedy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir, algorithm="greedy")


def greedy_sql(rounds: int) -> str:
    """By falling priority every vertex takes the smallest colour that no earlier neighbour has, in so many rounds."""
    rank = HASH.format("{0}.id || ':0'")
    parts = [SPARSE, f"q AS MATERIALIZED (SELECT v.id, {rank.format('v')} AS h FROM v)", "f AS MATERIALIZED (SELECT e.src, e.dst FROM e JOIN q a ON a.id = e.src JOIN q b ON b.id = e.dst WHERE (a.h, a.id) < (b.h, b.id))", "c0 AS MATERIALIZED (SELECT id, CAST(NULL AS INTEGER) AS color FROM v)"]
    for k in range(1, rounds + 1):
        parts.append(f"u{k} AS MATERIALIZED (SELECT f.dst AS id, list(c.color) AS used, bool_and(c.color IS NOT NULL) AS ready FROM f JOIN c{k - 1} c ON c.id = f.src GROUP BY 1)")
        free = "list_min(list_filter(range(0, len(coalesce(u.used, [])) + 1), lambda x: NOT list_contains(coalesce(u.used, []), x)))"
        parts.append(f"c{k} AS MATERIALIZED (SELECT c.id, coalesce(c.color, CASE WHEN coalesce(u.ready, true) THEN CAST({free} AS INTEGER) END) AS color FROM c{k - 1} c LEFT JOIN u{k} u USING (id))")
    return "WITH " + ",\n".join(parts) + f"\nSELECT id, color FROM c{rounds}"


@query(greedy_sql(40))
def color_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coloring.color(sparse(spark, sf_dir), algorithm="greedy")


def lazy_sql(rounds: int) -> str:
    """As luby_sql(), with the degrees of the first round until less than a hundredth of the vertices is left."""
    sql = luby_sql(rounds)
    for k in range(1, rounds):
        live = f"LEFT JOIN (SELECT src AS id, count(*) AS deg FROM e{k} GROUP BY 1) d USING (id)"
        chosen = f"LEFT JOIN (SELECT a.id, CASE WHEN (SELECT count(*) FROM v{k}) * 100 >= (SELECT count(*) FROM v0) THEN z.deg ELSE y.deg END AS deg FROM v{k} a LEFT JOIN (SELECT src AS id, count(*) AS deg FROM e0 GROUP BY 1) z USING (id) LEFT JOIN (SELECT src AS id, count(*) AS deg FROM e{k} GROUP BY 1) y USING (id)) d USING (id)"
        sql = sql.replace(live, chosen)
    return sql


@query(lazy_sql(60))
def color_lazy_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coloring.color(sparse(spark, sf_dir), prune="lazy")


# --- primitives -----------------------------------------------------------------------------------------------------


@query(f"WITH {PART_SUPPLIER} SELECT src, dst, dst * 7 AS value FROM e")
def fieldbcast_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = part_supplier(spark, sf_dir)
    return fieldbcast.field_broadcast(g._with(g.edges, g.vertices.withColumn("value", F.col("id") * 7)))


@query(f"WITH {ORDER_CHAIN} SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree FROM v")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_chain(spark, sf_dir).degrees()


@query(f"WITH {SPARSE}, t AS (SELECT id, (SELECT min(dst) FROM e WHERE src = id) AS ptr FROM v) SELECT a.id, a.ptr, b.ptr AS grand FROM t a LEFT JOIN t b ON b.id = a.ptr")
def request_respond(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sparse(spark, sf_dir)
    state = g.vertices.select("id").join(g.edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("ptr")), "id", "left")
    return superstep.request(state, "ptr", {"grand": F.col("ptr")})


@query(f"WITH {SPARSE} SELECT dst AS id, min(src + weight) AS value FROM e GROUP BY 1")
def relay_edge_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sparse(spark, sf_dir)
    return superstep.relay(g.vertices, g.edges, F.col("v.id").cast("double"), lambda m: m + F.col("e.weight"), F.min)


@query(f"WITH {ORDER_CHAIN} SELECT dst AS id, CAST(sum(src) AS BIGINT) AS total, min(src) AS least, bit_or(src) AS bits, count(DISTINCT src) AS senders FROM e GROUP BY 1")
def combiners(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_chain(spark, sf_dir)
    how = {"total": F.sum("m"), "least": F.min("m"), "bits": F.bit_or("m"), "senders": F.size(F.collect_set("m")).cast("long")}
    return superstep.aggregate_messages(g.vertices, g.edges, {"m": F.col("v.id")}, how)


@query(f"WITH {PART_SUPPLIER} SELECT CAST(sum(id) AS BIGINT) AS total, count(*) AS n, bool_and(id >= 0) AS every, bool_or(id = 1) AS any FROM v")
def global_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superstep.global_aggregates(part_supplier(spark, sf_dir).vertices, {"total": F.sum("id"), "n": F.count("*"), "every": F.bool_and(F.col("id") >= 0), "any": F.bool_or(F.col("id") == 1)})
    return spark.createDataFrame([tuple(found.values())], "total long, n long, every boolean, any boolean")


@query(f"WITH {SPARSE} SELECT id FROM v UNION SELECT -c_custkey - 1 FROM customer")
def vertex_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.read.parquet(f"{sf_dir}/customer.parquet").select((-F.col("c_custkey") - 1).alias("id"))
    return sparse(spark, sf_dir).add_vertices(extra).vertices.select("id")


@query(f"WITH {SPARSE}, g AS (SELECT src AS id FROM e GROUP BY 1 HAVING count(*) >= 4) SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)")
def edge_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sparse(spark, sf_dir)
    return g.prune_edges(g.degrees().where("out_degree >= 4").select("id")).edges.select("src", "dst")


@query(f"WITH {ORDER_CHAIN}, t AS (SELECT e.dst AS id, max(e.src) AS m FROM e GROUP BY 1) SELECT id, m AS top FROM t")
def point_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_chain(spark, sf_dir)
    mail = superstep.point_messages(g.edges, F.col("dst"), {"m": F.col("src")}, known=g.vertices)
    return mail.groupBy("id").agg(F.max("m").alias("top"))


# --- sorting, text and logs -----------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS order_no FROM lineitem")
def sample_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return ordering.order_numbers(fixtures.lineitem(spark, sf_dir).select("l_extendedprice", *cols), "l_extendedprice", *cols).select(*cols, "order_no")


@query(f"WITH {SPARSE} SELECT src, dst FROM e")
def adj_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parse(text.adjacency_lines(sparse(spark, sf_dir)), "adj").edges


@query(f"WITH {SPARSE} SELECT src, dst, weight FROM e")
def wadj_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'wadj').root}/lines"
    text.write_lines(text.adjacency_lines(sparse(spark, sf_dir), "weight"), path)
    return text.read_graph(spark, path, "wadj").edges


@query(f"WITH {SPARSE} SELECT id, id % 2 = 0 AS is_left FROM v")
def bip_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sparse(spark, sf_dir)
    lines = g.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("n")).select(F.concat_ws("\t", "src", F.concat_ws(" ", (F.col("src") % 2).cast("string"), F.array_join("n", " "))).alias("value"))
    return text.parse(lines, "bip").vertices.select("id", "is_left")


@query(f"WITH {SPARSE} SELECT id, id || chr(9) || CASE WHEN id % 3 = 0 THEN '-1' ELSE printf('%.6f', id / 8.0) END AS line FROM v")
def rank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sparse(spark, sf_dir).vertices.select("id", F.when(F.col("id") % 3 != 0, F.col("id") / 8.0).alias("x"))
    return text.lines_of(rows, "x", decimals=6).select(F.split("value", "\t")[0].cast("long").alias("id"), F.col("value").alias("line"))


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS messages FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = orders.select(F.col("o_orderstatus").alias("machine"), "o_orderkey", F.concat(F.lit("Message Transmission statistics: "), F.col("o_custkey").cast("string")).alias("value"))
    return logs.total_messages(logs.machine_messages(lines, order_col="o_orderkey"))


def hashmin_sql(rounds: int) -> str:
    """Labels l<k>, and received messages m<k>, of so many supersteps."""
    parts = [SPARSE, "l0 AS MATERIALIZED (SELECT id, id AS label, true AS act FROM v)"]
    for k in range(1, rounds + 1):
        parts.append(f"m{k} AS MATERIALIZED (SELECT e.dst AS id, min(l.label) AS m, count(*) AS c FROM l{k - 1} l JOIN e ON e.src = l.id WHERE l.act GROUP BY 1)")
        parts.append(f"l{k} AS MATERIALIZED (SELECT l.id, least(l.label, coalesce(m.m, l.label)) AS label, coalesce(m.m < l.label, false) AS act FROM l{k - 1} l LEFT JOIN m{k} m USING (id))")
    return "WITH " + ",\n".join(parts)


def _steps_sql(columns: str, rounds: int = 60) -> str:
    """One row for each superstep up to the one that changes nothing."""
    per = [f"SELECT CAST({k} AS INTEGER) AS superstep, {columns.format(k=k)} WHERE {k} = 1 OR EXISTS (SELECT 1 FROM l{k - 1} WHERE act)" for k in range(1, rounds + 1)]
    return hashmin_sql(rounds) + "\n" + " UNION ALL ".join(per)


def _hashmin_run(spark: SparkSession, sf_dir: str, **more) -> superstep.Run:
    return superstep.pregel(
        sparse(spark, sf_dir), init={"label": F.col("id")}, message={"m": F.col("v.label")}, combine={"m": F.min("m")}, update={"label": F.least("label", "m")}, active=F.col("label") < F.col("old_label"), **more
    )


@query(_steps_sql("CAST((SELECT coalesce(sum(c), 0) FROM m{k}) AS BIGINT) AS messages, (SELECT count(*) FROM l{k} WHERE act) AS changed"))
def msg_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and changed vertices of every superstep of a component search."""
    return _hashmin_run(spark, sf_dir).report(spark).select("superstep", "messages", "changed")


def _worker_sql(workers: int, rounds: int = 60) -> str:
    per = [f"SELECT CAST({k} AS INTEGER) AS superstep, CAST({w} AS INTEGER) AS worker, CAST((SELECT coalesce(sum(c), 0) FROM m{k} WHERE id % {workers} = {w}) AS BIGINT) AS messages WHERE {k} = 1 OR EXISTS (SELECT 1 FROM l{k - 1} WHERE act)" for k in range(1, rounds + 1) for w in range(workers)]
    return hashmin_sql(rounds) + "\n" + " UNION ALL ".join(per)


@query(_worker_sql(3))
def worker_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by worker and superstep."""
    return _hashmin_run(spark, sf_dir, workers=3).worker_report(spark)


@query(f"SELECT CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(changed) AS BIGINT) AS changed FROM ({_SQL['msg_report']})")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running aggregates over all supersteps, and a global object that a hook keeps."""
    shared = superstep.Globals()
    run = _hashmin_run(spark, sf_dir, running={"messages": lambda old, step: (old or 0) + step.messages}, hook=lambda step: shared.put_or_update("changed", step.changed, lambda a, b: a + b))
    return spark.createDataFrame([(run.steps[-1].running["messages"], shared.get("changed"))], "messages long, changed long")


@query(hashmin_sql(3) + "\nSELECT id, label FROM l3")
def cc_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after three supersteps, settled or not."""
    return components.connected_components(sparse(spark, sf_dir), max_iter=3, truncate=True)


# --- gather, apply, scatter -------------------------------------------------------------------------------------------


@query(_SQL["pagerank_dynamic"])
def gas_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks recomputed while a neighbour's changes, by gathering."""
    g = order_chain(spark, sf_dir)
    g = g._with(g.edges, g.degrees().select("id", F.col("out_degree").alias("deg")))
    found = gas.gather_apply_scatter(
        g, init={"deg": F.col("deg"), "rank": F.lit(1.0)}, gather={"g": F.col("v.rank") / F.col("v.deg")}, combine={"g": F.sum("g")}, apply={"rank": 0.15 + 0.85 * F.coalesce("g", F.lit(0.0))}, scatter=F.abs(F.col("rank") - F.col("old_rank")) > 0.01,
    )
    return found.select("id", F.round("rank", 6).alias("rank"))


@query(_SQL["sssp_weighted"])
def gas_sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest distances by gathering; the source alone is active at first and signals."""
    source = _source(spark, sf_dir)
    is_source = F.col("id") == source
    closer = F.coalesce(F.least("dist", "d"), F.col("dist"), F.col("d"))
    # the source's neighbours wake when the source is applied, so its distance counts as new in the first step
    return gas.gather_apply_scatter(
        sparse(spark, sf_dir), init={"dist": F.when(is_source, F.lit(0.0)), "told": F.lit(False)}, gather={"d": F.col("v.dist") + F.col("e.weight")}, combine={"d": F.min("d")},
        apply={"dist": closer, "told": F.lit(True)}, scatter=F.col("dist").isNotNull() & (F.col("old_dist").isNull() | (F.col("dist") < F.col("old_dist")) | (is_source & ~F.col("old_told"))), start=is_source,
    ).select("id", "dist")


@query(f"WITH {SPARSE}, a AS (SELECT src, dst, CAST(src AS DOUBLE) AS x FROM e), b AS (SELECT dst AS id, sum(x) AS s FROM a GROUP BY 1) SELECT e.src, e.dst, b.s + e.weight AS x FROM e JOIN b ON b.id = e.src")
def edge_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that live on edges: first the writer's id, then the sum that its in-edges told it, with the edge's weight."""
    first = F.col("v.sum").isNull()
    found = edge_valued(
        sparse(spark, sf_dir), init={"sum": F.lit(None).cast("double")}, write={"x": F.when(first, F.col("v.id").cast("double")).otherwise(F.col("v.sum") + F.col("e.weight"))}, read={"s": F.sum("x")}, update={"sum": F.col("s")}, rounds=2,
    )
    return found.edges.select("src", "dst", "x")


@query(f"WITH {SPARSE} SELECT src % 100 AS id, src AS sender, min(dst) AS value FROM e GROUP BY 1, 2")
def respond_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values pushed without a request: of each sender the first."""
    return superstep.explicit_respond(sparse(spark, sf_dir).edges, F.col("src") % 100, F.col("dst"), sender=F.col("src"))


@query(f"WITH {SPARSE} SELECT id FROM v ORDER BY {HASH.format("id || ':0'")}, id LIMIT 1")
def pick_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.pick_one(sparse(spark, sf_dir).vertices.select("id"))


@query(f"WITH {SPARSE}, d AS (SELECT src AS id, count(*) AS deg FROM e GROUP BY 1) SELECT CAST(2 AS INTEGER) AS phases, (SELECT count(*) FROM d WHERE deg >= 2) AS left_over")
def phase_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases in order; the second says that the run ends, so the third does not begin."""
    state = {"rows": sparse(spark, sf_dir).degrees()}

    def prune() -> bool:
        state["rows"] = state["rows"].where("out_degree >= 2")
        return True

    def forbidden() -> bool:
        raise AssertionError("a phase ran after the end")

    n = superstep.phases(prune, lambda: False, forbidden)
    return spark.createDataFrame([(n, state["rows"].count())], "phases int, left_over long")


# --- more text formats --------------------------------------------------------------------------------------------------


def _listed(g: Graph, *cells) -> DataFrame:
    """(id, n): out-edges of each vertex as text cells in order of the target."""
    cell = F.struct("dst", F.concat_ws(" ", *cells).alias("c"))
    return g.edges.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["c"]).alias("n"))


def _dst(*more: str):
    return [F.col(c).cast("string") for c in ("dst", *more)]


@query(f"WITH {SPARSE} SELECT src, dst, weight FROM e")
def wadj_nocount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _listed(sparse(spark, sf_dir), *_dst("weight")).select(F.concat_ws("\t", F.col("id").cast("string"), F.array_join("n", " ")).alias("value"))
    return text.parse(lines, "wadj_nocount").edges


@query(f"WITH {SPARSE} SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM e")
def adj_unit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _listed(sparse(spark, sf_dir), *_dst()).select(F.concat_ws("\t", F.col("id").cast("string"), F.concat_ws(" ", F.size("n").cast("string"), F.array_join("n", " "))).alias("value"))
    return text.parse(lines, "adj_unit").edges


@query(f"WITH {SPARSE} SELECT src, dst, src * 3 AS value FROM e")
def field_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _listed(sparse(spark, sf_dir), *_dst()).select(F.concat_ws(" ", F.col("id").cast("string"), (F.col("id") * 3).cast("string"), F.size("n").cast("string"), F.array_join("n", " ")).alias("value"))
    g = text.parse(lines, "field")
    return g.edges.join(g.vertices.withColumnRenamed("id", "src"), "src").select("src", "dst", "value")


@query(f"WITH {SPARSE} SELECT src, dst FROM e WHERE dst % 5 <> 0")
def generic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that are no numbers are skipped, and so are lines whose id is none."""
    cell = F.when(F.col("dst") % 5 == 0, F.lit("x")).otherwise(F.col("dst").cast("string"))
    lines = _listed(sparse(spark, sf_dir), cell).select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join("n", " ")).alias("value"))
    return text.parse(lines.union(lines.select(F.concat(F.lit("n"), "value"))), "generic").edges


@query(f"{BFS} SELECT v.id, v.id || chr(9) || coalesce(printf('%d.0', b.hops) || ' ' || coalesce(CAST((SELECT min(e.src) FROM e JOIN b AS u ON u.id = e.src WHERE e.dst = v.id AND u.hops = b.hops - 1) AS VARCHAR), '-1'), 'unreachable') AS line FROM v LEFT JOIN b USING (id)")
def sssp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sssp.sssp(sparse(spark, sf_dir), _source(spark, sf_dir), with_parent=True)
    return text.sssp_lines(found).select(F.split("value", "\t")[0].cast("long").alias("id"), F.col("value").alias("line"))


@query(f"WITH {SPARSE} SELECT v.id, v.id || ' ' || v.id * 7 || chr(9) || (SELECT string_agg(e.dst || ' ' || e.dst * 7, ' ' ORDER BY e.dst) FROM e WHERE e.src = v.id) AS line FROM v")
def field_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sparse(spark, sf_dir)
    g = g._with(g.edges, g.vertices.withColumn("value", F.col("id") * 7))
    return text.field_lines(g, fieldbcast.field_broadcast(g)).select(F.split("value", " ")[0].cast("long").alias("id"), F.col("value").alias("line"))


@query(f"WITH {SPARSE} SELECT src, dst, weight FROM e")
def edge_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines in two folders, read as one graph."""
    e, root = sparse(spark, sf_dir).edges, Scratch(spark, "lists").root
    line = F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")).alias("value")
    for k in range(2):
        text.write_lines(e.where(F.col("src") % 2 == k).select(line), f"{root}/{k}")
    return text.read_edge_list(spark, [f"{root}/0", f"{root}/1"], weighted=True).edges


@query(f"WITH {SPARSE} SELECT src, dst, weight FROM e")
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, g = Scratch(spark, "tables"), sparse(spark, sf_dir)
    return text.read_tables(spark, scratch.put(g.edges)._vertexloom_path, scratch.put(g.vertices)._vertexloom_path).edges


# --- formats and primitives over all lines ------------------------------------------------------------------------------


@query(f"WITH {PART_SUPPLIER} SELECT src, dst FROM e")
def adj_roundtrip_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parse(text.adjacency_lines(part_supplier(spark, sf_dir)), "adj").edges


@query(f"WITH {PART_SUPPLIER} SELECT dst AS id, min(src + CAST(0.5 AS DOUBLE)) AS value FROM e GROUP BY 1")
def relay_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = part_supplier(spark, sf_dir)
    return superstep.relay(g.vertices, g.edges, F.col("v.id").cast("double"), lambda m: m + F.lit(0.5), F.min)


@query(f"WITH {PART_SUPPLIER}, t AS (SELECT v.id, min(e.dst) AS ptr FROM v LEFT JOIN e ON e.src = v.id GROUP BY 1), d AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1) SELECT t.id, t.ptr, d.n AS customers FROM t LEFT JOIN d ON d.id = t.ptr")
def request_respond_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part asks its first supplier how many parts it has."""
    g = part_supplier(spark, sf_dir)
    state = g.vertices.select("id").join(g.edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("ptr")), "id", "left")
    known = g.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return superstep.request(state, "ptr", {"customers": F.col("n")}, from_state=known)
