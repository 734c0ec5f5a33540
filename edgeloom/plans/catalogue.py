"""Registered graph queries and equivalent SQL over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import bitvec
from ..functions.rounds import keep_size, running_sum, scratch
from ..operators import build, linalg, lists, partition, triangles, truss
from ..sources import edge_files, fixtures, generators
from ..streaming import edges as stream

QUERIES = {}
SQL = {}

P = "SELECT DISTINCT a.l_partkey AS u, b.l_partkey AS v FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey"
S = "SELECT DISTINCT a.l_suppkey AS u, b.l_suppkey AS v FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey"
U = "SELECT DISTINCT least(user_id, w) AS u, greatest(user_id, w) AS v FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS w FROM events) WHERE w IS NOT NULL AND user_id <> w"
W = "SELECT a.l_partkey AS u, b.l_partkey AS v, count(*) AS val FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2"
GRAPHS = {"p": (fixtures.part_graph, P), "s": (fixtures.supplier_graph, S), "u": (fixtures.user_graph, U), "w": (fixtures.weighted_part_graph, W)}
TRI = "t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v)"
SYM = "d AS (SELECT u AS src, v AS dst FROM e UNION ALL SELECT v, u FROM e)"


def query(name: str, sql: str | None, graph: str | None = None):
    """Registers fn(graph) or, without a graph, fn(spark, sf_dir). In the SQL, e is the graph's edges."""

    def put(fn):
        if graph is None:
            QUERIES[name], text = fn, sql
        else:
            make, edges = GRAPHS[graph]
            QUERIES[name] = lambda spark, sf_dir: fn(make(spark, sf_dir))
            text = sql and f"WITH {'RECURSIVE ' if 'RECURSE' in sql else ''}e AS MATERIALIZED ({edges})" + (", " if sql.lstrip()[:6] != "SELECT" else " ") + sql.replace("RECURSE ", "")
        if text:
            SQL[name] = text
        return fn

    return put


def directed(g):
    return keep_size(g, lambda g: g.select(F.col("u").alias("src"), F.col("v").alias("dst"), *[c for c in g.columns if c == "val"]))


query("graph_edges", "SELECT u, v FROM e", "p")(lambda g: g)
query("edges_upper", "SELECT u AS src, v AS dst FROM e", "p")(lambda g: build.orient_upper(build.build(build.symmetric(g))))
query("edges_lower", "SELECT v AS src, u AS dst FROM e", "p")(lambda g: build.orient_lower(build.build(build.symmetric(g))))
query("edges_symmetric", f"{SYM} SELECT src, dst FROM d", "p")(build.symmetric)
for _name, _g in (("graph_stats", "p"), ("graph_stats_users", "u")):
    query(_name, f"{SYM} SELECT count(*) AS nnz, max(src) + 1 AS num_rows, count(DISTINCT src) AS num_nodes, (SELECT max(c) FROM (SELECT count(*) AS c FROM d GROUP BY src)) AS max_degree FROM d", _g)(lambda g: build.stats(build.symmetric(g)))
query("degrees", f"{SYM} SELECT src AS node, count(*) AS degree FROM d GROUP BY 1", "p")(build.degrees)
query("row_ptr", f"{SYM}, g AS (SELECT src, count(*) AS degree FROM d GROUP BY 1) SELECT src, degree, CAST(sum(degree) OVER (ORDER BY src) - degree AS BIGINT) AS start FROM g", "p")(lambda g: build.row_ptr(build.symmetric(g)))
query("adjacency", "SELECT u AS src, count(*) AS nnz, min(v) AS min_dst, max(v) AS max_dst FROM e GROUP BY 1", "p")(lambda g: build.adjacency(directed(g)).select("src", F.size("nbrs").cast("long").alias("nnz"), F.get("nbrs", F.lit(0)).alias("min_dst"), F.element_at("nbrs", -1).alias("max_dst")))
query("empty_rows", "SELECT i AS src, coalesce(c, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(v) + 1 FROM e))) AS i) LEFT JOIN (SELECT u, count(*) AS c FROM e GROUP BY 1) ON i = u", "p")(lambda g: build.vertices(directed(g)))
BIN = "m AS (SELECT CAST(ceil((max(v) + 1) / 8.0) AS BIGINT) AS w FROM e), b AS (SELECT u AS src, v AS dst, least(v // w, 7) AS part FROM e, m)"
query("binned_nnz", f"{BIN} SELECT src, part, count(*) AS nnz FROM b GROUP BY 1, 2", "p")(lambda g: build.binned(directed(g)).groupBy("src", "part").agg(F.count(F.lit(1)).alias("nnz")))
query("part_span", f"{BIN} SELECT src, dst, part FROM b WHERE part >= 2 AND part < 5", "p")(lambda g: build.part_view(build.binned(directed(g)), 2, 5))
query("edge_predicate", "SELECT u AS src, v AS dst FROM e WHERE (u + v) % 3 = 0", "p")(lambda g: build.build(directed(g), keep=(F.col("src") + F.col("dst")) % 3 == 0))
query("row_range", "SELECT u AS src, v AS dst FROM e WHERE u BETWEEN 10 AND 90", "p")(lambda g: directed(g).where(F.col("src").between(10, 90)))
IDS = "i AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM d)"
query("reverse_edge", f"{SYM}, {IDS} SELECT a.edge_id, b.edge_id AS reverse_id FROM i a JOIN i b ON a.src = b.dst AND a.dst = b.src", "p")(lambda g: build.reverse_ids(build.symmetric(g)))
query("membership", "SELECT u, v FROM e WHERE EXISTS (SELECT 1 FROM e x WHERE x.u = e.v AND x.v = e.u + 7)", "p")(lambda g: lists.members(g.select("u", "v", F.col("v").alias("a"), (F.col("u") + 7).alias("b")), g.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"]).select("u", "v"))
query("edge_intersection_count", f"{TRI} SELECT e.u, e.v, count(t.a) AS common FROM e LEFT JOIN t ON t.a = e.u AND t.b = e.v GROUP BY 1, 2", "u")(
    lambda g: g.join(triangles.common_counts(g), ["u", "v"], "left").select("u", "v", F.coalesce("n", F.lit(0)).alias("common"))
)


def _search(upper):
    def run(spark, sf_dir):
        orders = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 10).cast("long").alias("v"))
        hay = fixtures.table(spark, sf_dir, "customer").select(F.round("c_acctbal").cast("long").alias("v"))
        return lists.bounds(orders, hay, upper).select(F.col("id").alias("o_orderkey"), "bound")

    return run


for _name, _op in (("lower_bound", "<"), ("upper_bound", "<=")):
    query(_name, f"WITH h AS (SELECT CAST(round(c_acctbal) AS BIGINT) AS v FROM customer) SELECT o_orderkey, (SELECT count(*) FROM h WHERE h.v {_op} o.v) AS bound FROM (SELECT o_orderkey, CAST(round(o_totalprice / 10) AS BIGINT) AS v FROM orders) o")(_search(_op == "<="))


def _found(spark, sf_dir):
    orders = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 10).cast("long").alias("v"))
    hay = fixtures.table(spark, sf_dir, "customer").select(F.round("c_acctbal").cast("long").alias("v"))
    return lists.search(orders, hay).select(F.col("id").alias("o_orderkey"), "bound", "found")


query("search_found", "WITH h AS (SELECT CAST(round(c_acctbal) AS BIGINT) AS v FROM customer) SELECT o_orderkey, (SELECT count(*) FROM h WHERE h.v < o.v) AS bound, v IN (SELECT v FROM h) AS found FROM (SELECT o_orderkey, CAST(round(o_totalprice / 10) AS BIGINT) AS v FROM orders) o")(_found)
DIAGONALS = [0, 1, 7, 50, 100, 10**6]


def _path(upper):
    def run(spark, sf_dir):
        a = fixtures.table(spark, sf_dir, "customer").select(F.round(F.col("c_acctbal") / 100).cast("long").alias("v"), F.col("c_custkey").alias("k"))
        b = fixtures.table(spark, sf_dir, "supplier").select(F.round(F.col("s_acctbal") / 100).cast("long").alias("v"), F.col("s_suppkey").alias("k"))
        return lists.merge_path(a, b, DIAGONALS, upper)

    return run


for _name, _sides in (("merge_path_lower", (0, 1)), ("merge_path_upper", (1, 0))):
    query(
        _name,
        f"""WITH m AS (SELECT x, row_number() OVER (ORDER BY v, s, k) AS rn FROM (SELECT CAST(round(c_acctbal / 100) AS BIGINT) AS v, {_sides[0]} AS s, c_custkey AS k, 1 AS x FROM customer
        UNION ALL SELECT CAST(round(s_acctbal / 100) AS BIGINT), {_sides[1]}, s_suppkey, 0 FROM supplier))
        SELECT CAST(g AS BIGINT) AS diagonal, CAST(coalesce((SELECT sum(x) FROM m WHERE rn <= g), 0) AS BIGINT) AS a_index FROM (SELECT unnest({DIAGONALS}) AS g)""",
    )(_path(_sides[0] == 1))

query("triangles_by_task", "t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v) SELECT count(*) AS triangles FROM t", "u")(lambda g: triangles.task_counts(g, 3).agg(F.coalesce(F.sum("triangles"), F.lit(0)).cast("long").alias("triangles")))
for _strategy, _count in triangles.STRATEGIES.items():
    query(f"triangles_{_strategy}" if _strategy != "degree" else "triangles_degree_ordered", f"{TRI} SELECT count(*) AS triangles FROM t", "p")(_count)
query("triangles_auto_users", f"{TRI} SELECT count(*) AS triangles FROM t", "u")(triangles.triangle_count)
query("triangles_complete", "SELECT n * (n - 1) * (n - 2) // 6 AS triangles FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem)", "s")(triangles.count_bitmap)
SQL["triangles_complete"] = "SELECT CAST(n * (n - 1) * (n - 2) // 6 AS BIGINT) AS triangles FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem)"
query("triangle_list", f"{TRI} SELECT a, b, c FROM t", "u")(triangles.triangle_list)
SUP = f"{TRI}, s AS (SELECT u, v, count(*) AS n FROM (SELECT a AS u, b AS v FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT a, c FROM t) GROUP BY 1, 2)"
query("edge_support", f"{SUP} SELECT e.u, e.v, coalesce(s.n, 0) AS support FROM e LEFT JOIN s ON e.u = s.u AND e.v = s.v", "u")(triangles.edge_support)
query("vertex_triangles", f"{TRI} SELECT a AS src, count(*) AS triangles FROM t GROUP BY 1", "p")(triangles.vertex_triangles)
query("triangles_by_row_range", f"{TRI} SELECT bucket, CAST(count(a) AS BIGINT) AS triangles FROM (SELECT DISTINCT u // 100 AS bucket FROM e JOIN (SELECT DISTINCT u AS w FROM e) ON w = v) LEFT JOIN t ON a // 100 = bucket GROUP BY 1", "p")(lambda g: triangles.range_counts(g, 100))
query("triangles_by_edge_range", f"{TRI}, i AS (SELECT u, v, (row_number() OVER (ORDER BY u, v) - 1) // 1000 AS bucket FROM e) SELECT bucket, count(a) AS triangles FROM i JOIN (SELECT DISTINCT u AS w FROM e) ON w = i.v LEFT JOIN t ON t.a = i.u AND t.b = i.v GROUP BY 1", "p")(lambda g: triangles.edge_range_counts(g, 1000))

query("generator_complete", "SELECT i AS src, j AS dst FROM range(0, 67) a(i), range(0, 67) b(j) WHERE i <> j")(lambda spark, sf_dir: generators.complete(spark, 67))
query("generator_hubspoke", "SELECT i AS src, j AS dst FROM range(0, 514) a(i), range(0, 514) b(j) WHERE i <> j AND (i = 513 OR j = 513 OR abs(i - j) = 1)")(lambda spark, sf_dir: generators.hubspoke(spark, 513))
query("hubspoke_triangles", "SELECT CAST(538 AS BIGINT) AS triangles")(lambda spark, sf_dir: triangles.triangle_count(build.undirected(generators.hubspoke(spark, 539))))

query("node_eliminate_k", f"{SYM}, g AS (SELECT src FROM d GROUP BY 1 HAVING count(*) >= 80) SELECT u, v FROM e WHERE u IN (SELECT src FROM g) AND v IN (SELECT src FROM g)", "u")(lambda g: truss.node_eliminate(g, 80))
#: Rounds of peeling for k = 3, 4, ...: k rises whenever a round deletes nothing.
TRUSS = """RECURSE st AS (SELECT 0 AS r, 3 AS k, u, v FROM e UNION ALL (
WITH cur AS (SELECT * FROM st), tri AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM cur x JOIN cur y ON x.v = y.u JOIN cur z ON z.u = x.u AND z.v = y.v),
sup AS (SELECT u, v, count(*) AS n FROM (SELECT a AS u, b AS v FROM tri UNION ALL SELECT b, c FROM tri UNION ALL SELECT a, c FROM tri) GROUP BY 1, 2),
keep AS (SELECT cur.* FROM cur JOIN sup ON cur.u = sup.u AND cur.v = sup.v WHERE n >= k - 2),
same AS (SELECT (SELECT count(*) FROM keep) = (SELECT count(*) FROM cur) AS yes)
SELECT r + 1, CASE WHEN yes THEN k + 1 ELSE k END, u, v FROM keep, same)),
tr AS (SELECT u, v, CAST(max(k) - 1 AS BIGINT) AS truss FROM st GROUP BY 1, 2)"""
query("ktruss_5", f"{TRUSS} SELECT u, v FROM tr WHERE truss >= 5", "u")(lambda g: truss.ktruss(g, 5))
query("ktruss_8", f"{TRUSS} SELECT u, v FROM tr WHERE truss >= 8", "p")(lambda g: truss.ktruss(g, 8))
query("truss_decomposition", f"{TRUSS} SELECT u, v, truss FROM tr", "u")(truss.truss_decomposition)
query("truss_histogram", f"{TRUSS} SELECT truss, count(*) AS edges FROM tr GROUP BY 1", "p")(lambda g: truss.truss_decomposition(g).groupBy("truss").agg(F.count(F.lit(1)).alias("edges")))
query("max_truss", f"{TRUSS} SELECT max(truss) AS max_truss FROM tr", "u")(truss.max_truss)
query("max_truss_binary", f"{TRUSS} SELECT max(truss) AS max_truss FROM tr", "u")(lambda g: g.sparkSession.range(1).select(F.lit(truss.max_truss_binary(g)).cast("long").alias("max_truss")))

query("ktruss_pair", f"{TRUSS} SELECT u, v, CASE WHEN truss >= 7 THEN 7 ELSE 5 END::BIGINT AS k FROM tr WHERE truss >= 5", "u")(lambda g: truss.ktruss_pair(g, 5, 7))
#: The rounds of peeling for one k: triangles at the round's begin, and edges that fall below.
ROUNDS = """RECURSE tri0 AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v),
st AS (SELECT 0 AS r, false AS weak, u, v FROM (SELECT a AS u, b AS v FROM tri0 UNION SELECT b, c FROM tri0 UNION SELECT a, c FROM tri0) UNION ALL (
WITH was AS (SELECT * FROM st), cur AS (SELECT * FROM was WHERE NOT weak), tri AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM cur x JOIN cur y ON x.v = y.u JOIN cur z ON z.u = x.u AND z.v = y.v),
sup AS (SELECT u, v, count(*) AS n FROM (SELECT a AS u, b AS v FROM tri UNION ALL SELECT b, c FROM tri UNION ALL SELECT a, c FROM tri) GROUP BY 1, 2),
more AS (SELECT (SELECT bool_or(weak OR r = 0) FROM was) AND (SELECT count(*) FROM tri) > 0 AS yes)
SELECT r + 1, coalesce(n, 0) < 48, cur.u, cur.v FROM more, cur LEFT JOIN sup ON cur.u = sup.u AND cur.v = sup.v WHERE more.yes))
"""


def _rounds(g):
    found = truss.truss_rounds(g, 50)
    return g.sparkSession.createDataFrame([(i + 1, r["k"], r["deleted"]) for i, r in enumerate(found)], "round long, k long, deleted long")


query("truss_rounds", f"{ROUNDS} SELECT CAST(r AS BIGINT) AS round, CAST(50 AS BIGINT) AS k, count(*) FILTER (WHERE weak) AS deleted FROM st WHERE r > 0 GROUP BY r", "u")(_rounds)

query("load_balance", "WITH c AS (SELECT l_orderkey AS obj, count(*) FILTER (WHERE l_quantity > 25) AS cnt FROM lineitem GROUP BY 1) SELECT row_number() OVER (ORDER BY obj, rank) - 1 AS item, obj, rank FROM (SELECT obj, unnest(range(0, cnt)) AS rank FROM c)")(
    lambda spark, sf_dir: lists.load_balance(fixtures.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("obj")).agg(F.sum((F.col("l_quantity") > 25).cast("long")).alias("cnt")))
)
query("tile_rows", f"{SYM} SELECT src, unnest(range(0, (count(*) + 31) // 32)) AS tile FROM d GROUP BY src", "p")(lambda g: lists.tiles(build.degrees(g).withColumnRenamed("node", "src"), 32))

query("elementwise_product", "SELECT a.u AS src, a.v AS dst, coalesce(a.val * b.val, 0) AS val FROM e a LEFT JOIN e b ON a.u = b.u AND a.v = b.v AND b.val > 1", "w")(lambda g: linalg.elementwise(directed(g), directed(g).where("val > 1")))
query("compress", "SELECT a.u AS src, a.v AS dst, a.val * b.val AS val FROM e a JOIN e b ON a.u = b.u AND a.v = b.v AND b.val > 1", "w")(lambda g: linalg.compress(linalg.elementwise(directed(g), directed(g).where("val > 1"))))
query("spgemm_sum", "SELECT CAST(count(*) AS BIGINT) AS nnz, CAST(sum(val) AS BIGINT) AS total FROM (SELECT a.u, b.v, sum(a.val * b.val) AS val FROM e a JOIN e b ON a.v = b.u GROUP BY 1, 2)", "w")(lambda g: linalg.product_figures(directed(g), directed(g)))
query("axpy", "SELECT u AS src, v AS dst, val * 3 + u AS val FROM e", "w")(lambda g: linalg.axpy(directed(g), "val", F.lit(3), "src"))
query("fill_zero", "SELECT u AS src, v AS dst, CAST(0 AS BIGINT) AS val FROM e", "w")(lambda g: linalg.fill(directed(g), "val", 0).withColumn("val", F.col("val").cast("long")))
query("exclusive_scan", "SELECT u AS src, v AS dst, CAST(sum(val) OVER (ORDER BY u, v) - val AS BIGINT) AS val FROM e", "w")(lambda g: running_sum(directed(g), "val", ["src", "dst"], "before", before=True).select("src", "dst", F.col("before").alias("val")))
query("reductions", "SELECT CAST(sum(val) AS BIGINT) AS total, max(val) AS top, min(val) AS low, bit_or(val) AS bits, count(DISTINCT u) AS nodes FROM e", "w")(lambda g: g.agg(F.sum("val").alias("total"), F.max("val").alias("top"), F.min("val").alias("low"), F.bit_or("val").alias("bits"), F.countDistinct("u").alias("nodes")))

query("bitvector_extent", "SELECT u AS src, CAST((max(v) // 64 + 1) * 64 AS BIGINT) AS size, CAST((max(v) // 64 + 1) * 64 AS BIGINT) AS end_idx, count(*) AS bits FROM e GROUP BY 1", "p")(lambda g: bitvec.extent(bitvec.build(directed(g), ["src"], "dst"), ["src"]))
query("bitvector_counts", "SELECT u AS src, v // 64 AS word, count(*) AS bits FROM e GROUP BY 1, 2", "p")(lambda g: bitvec.build(directed(g), ["src"], "dst").select("src", "word", F.bit_count("bits").cast("long").alias("bits")))
query("bitvector_clear", "SELECT u AS src, count(*) AS bits FROM e WHERE v NOT BETWEEN 30 AND 150 GROUP BY 1", "p")(lambda g: bitvec.clear(bitvec.build(directed(g), ["src"], "dst"), 30, 150).groupBy("src").agg(F.sum(F.bit_count("bits")).cast("long").alias("bits")))
query("bitvector_get", "SELECT u AS src, CAST(max(CASE WHEN v = 100 THEN 1 ELSE 0 END) AS BIGINT) AS bit FROM e WHERE v // 64 = 1 GROUP BY 1", "p")(lambda g: bitvec.build(directed(g), ["src"], "dst").where("word = 1").select("src", bitvec.get(F.col("bits"), F.lit(100)).cast("long").alias("bit")))

PARTS = 4


def _sweeps(sweeps: int) -> str:
    """The sweeps unrolled: each turn of a sweep is one common table expression."""
    text = [f"RECURSE {SYM}", "n AS (SELECT DISTINCT src AS node FROM d)", "nn AS (SELECT count(*) AS n FROM n)", f"l0 AS (SELECT node, node % {PARTS} AS part FROM n)"]
    text.append(f"cap AS (SELECT p AS part, CASE WHEN p = {PARTS - 1} THEN n - n // {PARTS} * {PARTS - 1} ELSE n // {PARTS} END AS room FROM nn, range(0, {PARTS}) r(p))")
    for s in range(1, sweeps + 1):
        l = f"l{s - 1}"  # noqa: E741
        text.append(f"card{s} AS (SELECT cap.part, count(node) AS c FROM cap LEFT JOIN {l} ON {l}.part = cap.part GROUP BY 1)")
        text.append(f"conn{s} AS (SELECT src AS node, part, count(*) AS c FROM d JOIN {l} ON d.dst = {l}.node GROUP BY 1, 2)")
        text.append(f"deg{s} AS (SELECT src AS node, count(*) AS g FROM d GROUP BY 1)")
        text.append(f"ch{s} AS (SELECT node, part, cost, row_number() OVER (PARTITION BY node ORDER BY cost DESC, part) AS turn FROM (SELECT n.node, cap.part, 9 * coalesce(k.c, 0) + (nn.n - (card{s}.c + g.g - coalesce(k.c, 0))) AS cost FROM n CROSS JOIN nn CROSS JOIN cap JOIN card{s} ON card{s}.part = cap.part JOIN deg{s} g ON g.node = n.node LEFT JOIN conn{s} k ON k.node = n.node AND k.part = cap.part))")
        done = "SELECT CAST(NULL AS BIGINT) AS node, CAST(NULL AS BIGINT) AS part WHERE false"
        for t in range(1, PARTS + 1):
            text.append(f"in{s}_{t} AS (SELECT node, part FROM (SELECT c.node, c.part, row_number() OVER (PARTITION BY c.part ORDER BY cost DESC, c.node) AS rn FROM ch{s} c WHERE turn = {t} AND c.node NOT IN (SELECT node FROM ({done}))) q JOIN cap USING (part) WHERE rn <= room - (SELECT count(*) FROM ({done}) z WHERE z.part = q.part))")
            done = " UNION ALL ".join(f"SELECT node, part FROM in{s}_{i}" for i in range(1, t + 1))
        text.append(f"l{s} AS ({done})")
    return ", ".join(text)


def _cut(g, sweeps):
    return partition.cross_decompose(build.symmetric(g), PARTS, sweeps)


query("crossdecomp_sweep", f"{_sweeps(1)} SELECT node, part FROM l1", "u")(lambda g: _cut(g, 1))
query("crossdecomp_edges", f"{_sweeps(2)} SELECT a.part AS p_src, b.part AS p_dst, count(*) AS edges FROM d JOIN l2 a ON d.src = a.node JOIN l2 b ON d.dst = b.node GROUP BY 1, 2", "u")(lambda g: partition.edge_matrix(build.symmetric(g), _cut(g, 2)))
query("crossdecomp_rename", f"{_sweeps(1)} SELECT node, row_number() OVER (ORDER BY part, node) - 1 AS new_id FROM l1", "u")(lambda g: partition.rename(_cut(g, 1)))
query("crossdecomp_summary", f"{_sweeps(1)}, c AS (SELECT a.part AS p, b.part AS q, count(*) AS n FROM d JOIN l1 a ON d.src = a.node JOIN l1 b ON d.dst = b.node GROUP BY 1, 2) SELECT l.part, l.nodes, CAST(coalesce(sum(c.n) FILTER (WHERE c.q = l.part), 0) AS BIGINT) AS inner, CAST(coalesce(sum(c.n) FILTER (WHERE c.q <> l.part), 0) AS BIGINT) AS outer FROM (SELECT part, count(*) AS nodes FROM l1 GROUP BY 1) l LEFT JOIN c ON c.p = l.part GROUP BY 1, 2".replace(" AS inner", ' AS "inner"').replace(" AS outer", ' AS "outer"'), "u")(lambda g: partition.summary(build.symmetric(g), _cut(g, 1)))


def _folder(g, suffix: str) -> str:
    return f"{scratch(g.sparkSession)}/{uuid.uuid4().hex[:12]}{suffix}"


def _through_tsv(g):
    path = _folder(g, ".tsv")
    edge_files.write_tsv(directed(g), path)
    return edge_files.read_edges(g.sparkSession, path)


def _through_bel(g):
    path = _folder(g, ".bel")
    edge_files.write_bel_parts(directed(g), path)
    return edge_files.read_edges(g.sparkSession, path)


def _bmtx(g) -> str:
    path, top = _folder(g, ".bmtx"), g.agg(F.coalesce(F.max("v"), F.lit(-1)) + 1).first()[0]
    edge_files.write_bmtx_parts(directed(g), path, top, top)
    return path


def _through_stream(g):
    """Edges in text files, streamed; the rows that arrive."""
    path, out = _folder(g, ".tsv"), _folder(g, "-streamed")
    edge_files.write_tsv(directed(g).repartition(4), path)
    rows = stream.stream_tsv(g.sparkSession, f"{path}/part-*", files=2)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return g.sparkSession.read.parquet(out)


def _recounted(g):
    """Triangles after all files have come in, batch by batch."""
    path, store, found = _folder(g, ".tsv"), _folder(g, "-store"), []
    edge_files.write_tsv(directed(g).repartition(4), path)
    stream.recount(stream.stream_tsv(g.sparkSession, f"{path}/part-*", files=2), store, f"{store}-state", found).awaitTermination()
    return g.sparkSession.range(1).select(F.lit(found[-1][1] if found else 0).cast("long").alias("triangles"))


query("read_tsv", "SELECT u AS src, v AS dst, val FROM e", "w")(_through_tsv)
query("read_bel", "SELECT u AS src, v AS dst, val FROM e", "w")(_through_bel)
query("read_bmtx", "SELECT u AS src, v AS dst, CAST(val AS DOUBLE) AS val FROM e", "w")(lambda g: edge_files.read_edges(g.sparkSession, _bmtx(g)))
query("bmtx_metadata", "SELECT max(v) + 1 AS num_rows, max(v) + 1 AS num_cols, count(*) AS nnz FROM e", "w")(lambda g: edge_files.bmtx_metadata(g.sparkSession, _bmtx(g)).agg(F.max("num_rows").alias("num_rows"), F.max("num_cols").alias("num_cols"), F.sum("nnz").alias("nnz")))
query("stream_edges", "SELECT u AS src, v AS dst, val FROM e", "w")(_through_stream)
query("stream_triangles", f"{TRI} SELECT count(*) AS triangles FROM t", "u")(_recounted)
query("csr_bytes", f"{SYM} SELECT 8 * (count(*) + max(src) + 2) AS bytes FROM d", "p")(lambda g: build.stats(build.symmetric(g)).select((8 * (F.col("nnz") + F.col("num_rows") + 1)).alias("bytes")))
