"""Graph operators on small graphs with known answers, file round trips, and every registered query against SQL."""

import itertools
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import bitvec, rounds
from edgeloom.operators import blocks, build, linalg, lists, partition, triangles, truss
from edgeloom.plans import catalogue
from edgeloom.sources import edge_files, fixtures, generators
from edgeloom.streaming import edges as stream

FIVE = [(0, 1), (0, 2), (1, 0), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2), (3, 4), (4, 1), (4, 2), (4, 3)]


def edges_of(spark, rows, schema="src long, dst long"):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first()[0]


def test_five_nodes(spark):
    e = edges_of(spark, FIVE)
    assert build.orient_upper(e).count() == build.orient_lower(e).count() == 8
    assert build.stats(e).first().asDict() == {"nnz": 16, "num_rows": 5, "num_nodes": 5, "max_degree": 4}
    g = build.undirected(e)
    assert all(one(f(g)) == 5 for f in triangles.STRATEGIES.values())
    assert one(triangles.triangle_count(g)) == 5 and one(truss.max_truss(g)) == truss.max_truss_binary(g) == 4
    found = {(r["u"], r["v"]): r["truss"] for r in truss.truss_decomposition(g).collect()}
    assert sorted(found.values()) == [3, 3, 4, 4, 4, 4, 4, 4]
    assert truss.ktruss(g, 4).count() == 6 and truss.ktruss(g, 5).count() == 0
    assert truss.truss_rounds(g, 4)[0]["deleted"] == 2


def test_gap_and_empty(spark):
    e = edges_of(spark, [(2, 100)])
    assert build.vertices(build.orient_upper(e)).count() == 101 and build.vertices(build.orient_lower(e)).count() == 0
    none = edges_of(spark, [], "u long, v long")
    assert one(triangles.triangle_count(none)) == 0 and one(truss.max_truss(none)) == 0 == truss.max_truss_binary(none)
    assert one(truss.max_truss(edges_of(spark, [(1, 2)], "u long, v long"))) == 2
    assert build.build(edges_of(spark, [(1, 1), (1, 2), (1, 2)])).count() == 1
    assert build.size_bytes(16, 5) == 176


@pytest.mark.parametrize("n", [0, 1, 3, 4, 67])
def test_complete(spark, n):
    e = generators.complete(spark, n)
    assert e.count() == n * (n - 1)
    assert one(triangles.triangle_count(build.undirected(e))) == generators.complete_triangles(n)


@pytest.mark.parametrize(("n", "edges"), [(0, 0), (1, 2), (2, 6), (3, 10), (513, 2050)])
def test_hubspoke(spark, n, edges):
    e = generators.hubspoke(spark, n)
    assert e.count() == edges
    assert one(triangles.triangle_count(build.undirected(e))) == generators.hubspoke_triangles(n)


def test_truss_by_plain_peeling(spark):
    rng = random.Random(5)
    e = {(a, b) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.35}
    want, live, k = {}, set(e), 3
    while live:
        near = {x: {b for a, b in live if a == x} | {a for a, b in live if b == x} for x in range(25)}
        weak = {x for x in live if len(near[x[0]] & near[x[1]]) < k - 2}
        want |= dict.fromkeys(weak, k - 1)
        live -= weak
        k += not weak
    g = edges_of(spark, sorted(e), "u long, v long")
    assert {(r["u"], r["v"]): r["truss"] for r in truss.truss_decomposition(g).collect()} == want


@pytest.mark.parametrize(("a", "b", "n"), [([], [], 0), ([0], [0, 1], 1), ([0, 2, 4], [1, 3, 5], 0), ([0, 1, 4], [1, 4], 2), (list(range(5)), list(range(1, 6)), 4)])
def test_intersections(spark, a, b, n):
    assert one(spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(lists.intersection_count("a", "b"))) == n


@pytest.mark.parametrize(("values", "x", "low", "high"), [([0, 0], 0, 0, 2), ([0, 1, 2], 1, 1, 2), ([1], 2, 1, 1), ([], 3, 0, 0)])
def test_bounds(spark, values, x, low, high):
    hay, needle = spark.createDataFrame([(v,) for v in values], "v long"), spark.createDataFrame([(1, x)], "id long, v long")
    assert [lists.bounds(needle, hay, up).first()["bound"] for up in (False, True)] == [low, high]


def test_search_tells_whether_it_found(spark):
    hay, needles = spark.createDataFrame([(v,) for v in [3] * 500 + [5]], "v long"), spark.createDataFrame([(1, 3), (2, 4), (3, 5), (4, 6)], "id long, v long")
    assert sorted(map(tuple, lists.search(needles, hay).collect())) == [(1, 0, True), (2, 500, False), (3, 500, True), (4, 501, False)]
    assert sorted(map(tuple, lists.search(needles, hay, upper=True).collect())) == [(1, 500, True), (2, 500, False), (3, 501, True), (4, 501, False)]
    assert lists.search(needles, hay.where("false")).where("found or bound > 0").count() == 0


def test_star_with_a_clique(spark):
    """A hub of 100,000 leaves and a clique of 12 that it belongs to: lists go from lower to higher degree."""
    clique = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    g = spark.range(12, 100_012).selectExpr("0L AS u", "id AS v").unionByName(edges_of(spark, clique, "u long, v long"))
    assert triangles.triangle_list(g).count() == 220
    found = {r["support"]: r["n"] for r in triangles.edge_support(g).groupBy("support").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {10: 66, 0: 100_000}
    assert one(triangles.vertex_triangles(g).agg(F.sum("triangles"))) == 220
    assert truss.ktruss(g, 12).count() == 66 and truss.ktruss(g, 13).count() == 0


def test_tasks_and_pairs_of_trusses(spark):
    rng = random.Random(8)
    g = edges_of(spark, [(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.3], "u long, v long")
    tasks = triangles.task_counts(g, 3).collect()
    assert sum(r["triangles"] for r in tasks) == one(triangles.count_array(g)) and len({(r["i"], r["j"], r["k"]) for r in tasks}) == len(tasks) > 3
    pair = {(r["u"], r["v"]): r["k"] for r in truss.ktruss_pair(g, 3, 4).collect()}
    four = {(r["u"], r["v"]) for r in truss.ktruss(g, 4).collect()}
    assert set(pair) == {(r["u"], r["v"]) for r in truss.ktruss(g, 3).collect()} and {x for x, k in pair.items() if k == 4} == four


def test_options_reach_the_operators(spark):
    from edgeloom import session

    g = build.undirected(generators.complete(spark, 6))
    try:
        session.init(session.Options(strategy="wedge", seed=3))
        assert "SortMergeJoin" in triangles.triangle_count(g)._jdf.queryExecution().toString() or one(triangles.triangle_count(g)) == 20
        nodes = spark.range(40).withColumnRenamed("id", "node")
        drawn = [tuple(r) for r in partition.start(nodes, 4, 3).orderBy("node").collect()]
        assert drawn != [tuple(r) for r in partition.start(nodes, 4).orderBy("node").collect()]
        e = build.symmetric(build.undirected(generators.hubspoke(spark, 9)))
        assert partition.cross_decompose(e, 2, 0).orderBy("node").collect() == partition.start(e.select(F.col("src").alias("node")).distinct(), 2, 3).orderBy("node").collect()
    finally:
        spark.conf.unset(session.STRATEGY)
        spark.conf.unset(session.SEED)


def test_merge_path(spark):
    make = lambda vs: spark.createDataFrame([(v, i) for i, v in enumerate(vs)], "v long, k long")
    a, b = make([0, 1, 2, 3]), make([3, 4, 5, 6])
    assert [lists.merge_path(a, b, [4], up).first()["a_index"] for up in (False, True)] == [4, 3]


@pytest.mark.parametrize(("counts", "want"), [([0, 2, 0, 1], [1, 1, 3]), ([2, 0, 1], [0, 0, 2]), ([0, 0], []), ([], [])])
def test_load_balance(spark, counts, want):
    df = spark.createDataFrame(list(enumerate(counts)), "obj long, cnt long")
    rows = sorted((r["item"], r["obj"]) for r in lists.load_balance(df).collect())
    assert rows == list(enumerate(want))


def test_files(spark, tmp_path):
    text = tmp_path / "x.tsv"
    text.write_text("2\t1 1\n1\t2\t7\n\n3 1  1\n")
    e = edge_files.read_edges(spark, str(text))
    assert sorted(map(tuple, e.collect())) == [(1, 2, 1), (1, 3, 1), (2, 1, 7)]
    bel = tmp_path / "x.bel"
    assert edge_files.write_bel(e, str(bel)) == 3 and bel.stat().st_size == 72
    bel.write_bytes(bel.read_bytes() + b"short")
    assert sorted(map(tuple, edge_files.read_edges(spark, str(bel)).collect())) == sorted(map(tuple, e.collect()))
    with pytest.raises(FileExistsError):
        edge_files.write_bel(e, str(bel))
    edge_files.write_tsv(e, str(tmp_path / "y.tsv"))
    assert edge_files.read_edges(spark, str(tmp_path / "y.tsv")).count() == 3
    mtx = tmp_path / "x.bmtx"
    mtx.write_bytes(struct.pack("<QQQqqd", 1, 7, 3, 1, 7, 0.0))
    assert [tuple(r) for r in edge_files.read_edges(spark, str(mtx)).collect()] == [(0, 6, 0.0)]
    assert tuple(edge_files.bmtx_metadata(spark, str(mtx)).first()) == (1, 7, 3)
    with pytest.raises(ValueError, match="no reader"):
        edge_files.read_edges(spark, "x.csv")
    text.write_text("7\n")
    with pytest.raises(Exception, match="malformed"):
        edge_files.read_tsv(spark, str(text)).collect()


def test_numbers_in_text_files(spark, tmp_path):
    """Signs, base 16 and base 8 as C reads them; every line has three fields."""
    text = tmp_path / "x.tsv"
    text.write_text("0x1F -2 +3\n010 0 -0x10\n9223372036854775807 1 00\n")
    assert sorted(map(tuple, edge_files.read_tsv(spark, str(text)).collect())) == [(-2, 31, 3), (0, 8, -16), (1, 2**63 - 1, 0)]
    for bad in ("1 2\n", "1 2 x\n", "08 1 1\n", "9223372036854775808 1 1\n", "1.5 2 3\n"):
        text.write_text(bad)
        with pytest.raises(Exception, match="malformed"):
            edge_files.read_tsv(spark, str(text)).collect()


def test_files_written_by_tasks(spark, tmp_path):
    e = spark.range(5000).select(F.col("id").alias("src"), (F.col("id") * 7 % 5000).alias("dst"), (F.col("id") % 3).alias("val")).repartition(3)
    rows = sorted(map(tuple, e.collect()))
    bel, mtx = tmp_path / "x.bel", tmp_path / "x.bmtx"
    assert edge_files.write_bel_parts(e, str(bel)) == 5000 and len(list(bel.glob("part-*"))) == 3
    assert sorted(map(tuple, edge_files.read_edges(spark, str(bel)).collect())) == rows
    assert edge_files.write_bmtx_parts(e, f"file://{mtx}", 5000, 5000) == 5000
    assert sorted(map(tuple, edge_files.read_edges(spark, str(mtx)).collect())) == rows
    heads = edge_files.bmtx_metadata(spark, str(mtx)).collect()
    assert {(r["num_rows"], r["num_cols"]) for r in heads} == {(5000, 5000)} and sum(r["nnz"] for r in heads) == 5000
    with pytest.raises(FileExistsError):
        edge_files.write_bel_parts(e, str(bel))
    assert edge_files.exists(spark, str(bel)) and not edge_files.exists(spark, str(tmp_path / "none"))
    q = stream.stream_binary(spark, str(bel), "bel", 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5000


def test_stream_counts_only_what_closes(spark, tmp_path):
    """Batch by batch the count equals that of all edges so far; repeated and turned edges change nothing."""
    rng, src, found, seen = random.Random(9), tmp_path / "in", [], set()
    src.mkdir()
    want = []
    for i in range(4):
        rows = [(rng.randrange(12), rng.randrange(12)) for _ in range(25)]
        (src / f"{i}.tsv").write_text("".join(f"{a} {b} 1\n" for a, b in rows))
        os.utime(src / f"{i}.tsv", (1_700_000_000 + i, 1_700_000_000 + i))
        seen |= {(min(x), max(x)) for x in rows if x[0] != x[1]}
        want.append(sum({(a, b), (b, c), (a, c)} <= seen for a, b, c in itertools.combinations(range(12), 3)))
    stream.recount(stream.stream_tsv(spark, str(src)), str(tmp_path / "store"), str(tmp_path / "cp"), found).awaitTermination(120)
    assert [n for _, n in found] == want


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.tsv").write_text("2 1 1\n3 2 1\n")
    (src / "b.tsv").write_text("3 1 1\n")
    found: list = []
    q = stream.recount(stream.stream_tsv(spark, str(src)), str(tmp_path / "store"), str(tmp_path / "cp"), found)
    q.awaitTermination(120)
    assert len(found) == 2 and found[-1][1] == 1


def test_bits(spark):
    df = spark.createDataFrame([(1, i) for i in (0, 3, 63, 64, 130)], "k long, i long")
    words = bitvec.build(df, ["k"], "i")
    assert words.count() == 3
    left = bitvec.clear(words, 3, 64)
    assert sorted((r["word"], r["bits"]) for r in left.collect()) == [(0, 1), (2, 4)]
    assert one(words.where("word = 0").select(bitvec.get(F.col("bits"), F.lit(63)))) == 1
    assert tuple(bitvec.extent(words, ["k"]).first()) == (1, 192, 192, 5)


def test_scans(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(9)) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v long")
    want, total = {}, 0
    for k, v in sorted(rows):
        want[k] = total
        total += v
    assert {r["k"]: r["s"] for r in rounds.running_sum(df, "v", ["k"], "s", before=True).collect()} == want
    after = {r["k"]: r["w"] for r in rounds.next_value(df, "v", ["k"], "w").collect()}
    values = dict(rows)
    assert after == {k: values.get(k + 1) for k in values}


def test_matrices(spark):
    a = edges_of(spark, [(0, 1, 2), (1, 2, 3), (0, 2, 0)], "src long, dst long, val long")
    assert sorted(map(tuple, linalg.multiply(a, a).collect())) == [(0, 2, 6)]
    assert linalg.compress(linalg.elementwise(a, a)).count() == 2
    assert one(linalg.axpy(a, "val", F.lit(2), "src", "r").where("src = 1").select("r")) == 7


def test_parts_keep_their_capacity(spark):
    e = build.symmetric(build.undirected(generators.hubspoke(spark, 30)))
    labels = partition.cross_decompose(e, 4)
    sizes = {r["part"]: r["count"] for r in labels.groupBy("part").count().collect()}
    assert [sizes[p] for p in range(4)] == partition.capacities(31, 4)
    assert one(partition.edge_matrix(e, labels).agg(F.sum("edges"))) == e.count()
    assert sorted(r["new_id"] for r in partition.rename(labels).collect()) == list(range(31))
    parts = partition.summary(e, labels).collect()
    assert sum(r["inner"] + r["outer"] for r in parts) == e.count() and sum(r["nodes"] for r in parts) == 31


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_queries_equal_their_sql(spark, small_dir, oracle, rows_of, name):
    assert rows_of(catalogue.QUERIES[name](spark, small_dir)) == oracle(catalogue.SQL[name], small_dir)


def test_entry(spark):
    import __spark_entry__

    assert one(__spark_entry__.entry(spark)) == 125968
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pairs_take_tasks_by_their_number(spark, small_dir, monkeypatch):
    """Tasks grow with the pairs, not with the bytes that come in, so that none holds more than ROWS of them."""
    monkeypatch.setattr(rounds, "ROWS", 500)
    for name in ("part_graph", "weighted_part_graph"):
        g = getattr(fixtures, name)(spark, small_dir)
        assert max(r["n"] for r in g.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()) < 1500
    e = build.build(build.symmetric(fixtures.part_graph(spark, small_dir)))
    assert max(r["n"] for r in e.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()) < 1500
    rows = fixtures.table(spark, small_dir, "lineitem").select("l_orderkey", "l_partkey")
    more = fixtures._pairs(rows.unionByName(rows).unionByName(spark.createDataFrame([(None, 1), (None, 2), (3, None)], rows.schema)), "l_orderkey", "l_partkey")
    assert more.agg(F.sum("n")).first()[0] == 4 * fixtures._pairs(rows, "l_orderkey", "l_partkey").agg(F.sum("n")).first()[0]


def test_reverse_ids_without_a_join(spark):
    """Ids in (src, dst) order; a loop is its own reverse, an edge without a reverse has none; no join of edges."""
    found = build.reverse_ids(edges_of(spark, [(5, 1), (1, 5), (2, 2), (1, 3)]))
    assert sorted(map(tuple, found.collect())) == [(1, 3), (2, 2), (3, 1)]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_binary_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """A large partition is written as several files, each with a header of its own."""
    monkeypatch.setattr(edge_files, "FILE", 1000)
    e = spark.range(4500).select(F.col("id").alias("src"), (F.col("id") * 7 % 5000).alias("dst"), F.lit(2).alias("val")).coalesce(1)
    mtx = tmp_path / "x.bmtx"
    assert edge_files.write_bmtx_parts(e, str(mtx), 5000, 5000) == 4500
    assert sorted(r["nnz"] for r in edge_files.bmtx_metadata(spark, str(mtx)).collect()) == [500, 1000, 1000, 1000, 1000]
    assert sorted(map(tuple, edge_files.read_edges(spark, str(mtx)).collect())) == sorted(map(tuple, e.collect()))
    assert edge_files.write_bel_parts(e.where("false"), str(tmp_path / "none.bel")) == 0


def test_packed_edges(spark):
    """Any 64-bit ids and marks come back."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-50, 50, 5000)
    x[:4000] = rng.integers(0, 40, 4000)
    mark = rng.integers(-9, 9, 5000)
    got = [(i, *(c.tolist() for c in blocks.decode(body))) for i, body in blocks.pieces(x % 3, x, y, mark.copy())]
    back = sorted((a, b, c - (1 << 64) if c >> 63 else c) for _, xs, ys, ms in got for a, b, c in zip(xs, ys, ms, strict=True))
    assert back == sorted(zip(x.tolist(), y.tolist(), mark.tolist(), strict=True)) and [i for i, *_ in got] == [0, 1, 2]
    assert len(blocks.encode(np.repeat(np.arange(1000), 60), np.tile(np.arange(0, 6000, 100), 1000))) < 60_000


@pytest.mark.parametrize("groups", [1, 2, 5])
def test_blocks_find_each_triangle_once(spark, monkeypatch, groups):
    """Whatever the number of groups and the size of a slab; counts shuffle packed edges and join nothing."""
    monkeypatch.setattr(blocks, "groups_for", lambda rows: groups)
    monkeypatch.setattr(blocks, "SLAB", 7)
    rng = random.Random(groups)
    e = {(a, b) for a in range(-20, 20) for b in range(a + 1, 20) if rng.random() < 0.3} | {(-20, b) for b in range(-19, 60)}
    want = [t for t in itertools.combinations(range(-20, 60), 3) if {t[:2], t[1:], t[::2]} <= e]
    g = edges_of(spark, sorted(e), "u long, v long")
    assert sorted(map(tuple, triangles.triangle_list(g).collect())) == want
    for count in triangles.STRATEGIES.values():
        assert one(count(g)) == len(want) and "Join" not in count(g)._jdf.queryExecution().executedPlan().toString()
    sides = [s for t in want for s in (t[:2], t[1:], t[::2])]
    assert {(r["u"], r["v"]): r["support"] for r in triangles.edge_support(g).collect()} == {x: sides.count(x) for x in e}
    assert {r["src"]: r["triangles"] for r in triangles.vertex_triangles(g).collect()} == {a: sum(t[0] == a for t in want) for a, _, _ in want}


def test_figures_of_a_product(spark, monkeypatch):
    """Entries and sum as of the product itself, with many groups and small slabs, negative values and cancelled entries."""
    monkeypatch.setattr(linalg, "SQUARE", 40)
    monkeypatch.setattr(blocks, "SLAB", 9)
    rng = random.Random(3)
    a, b = ({(rng.randrange(30), rng.randrange(30)): rng.randrange(-5, 6) for _ in range(300)} for _ in range(2))
    a, b = (edges_of(spark, [(*k, v) for k, v in m.items()], "src long, dst long, val long") for m in (a, b))
    found = linalg.product_figures(a, b)
    assert tuple(found.first()) == tuple(linalg.multiply(a, b).agg(F.count(F.lit(1)), F.sum("val")).first())
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert tuple(linalg.product_figures(a.where("src < 0"), b).first()) == (0, None)


def test_closing_shuffles_no_wedges(spark):
    """Triangles with a new edge among old ones, each once; edges are joined with ends, never with edges."""
    rng = random.Random(4)
    e = sorted({(a, b) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.4})
    old, new = e[::2], e[1::2]
    found = stream.closed_by(edges_of(spark, new, "u long, v long"), edges_of(spark, old, "u long, v long"))
    want = [t for t in itertools.combinations(range(25), 3) if {t[:2], t[1:], t[::2]} <= set(e) and not {t[:2], t[1:], t[::2]} <= set(old)]
    assert sorted(map(tuple, found.collect())) == want
    assert "Inner" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_truss_by_counting_anew(spark, monkeypatch):
    """Edges fall by rounds of counts before any triangle is written; the truss is that of plain peeling, and none are left of a
    graph that falls apart."""
    monkeypatch.setattr(truss, "groups_for", lambda rows: 3)
    rng = random.Random(12)
    e = sorted({(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.97 if b < 14 else 0.2)})
    g, live = edges_of(spark, e, "u long, v long"), set(e)
    while True:
        near = {x: {b for a, b in live if a == x} | {a for a, b in live if b == x} for x in range(40)}
        weak = {x for x in live if len(near[x[0]] & near[x[1]]) < 6}
        if not weak:
            break
        live -= weak
    assert {(r["u"], r["v"]) for r in truss.ktruss(g, 8).collect()} == live and live
    written = []
    monkeypatch.setattr(truss, "_triangles", lambda graph: written.append(graph.count()) or (_ for _ in ()).throw(AssertionError("listed")))
    assert truss.ktruss(g.where("v >= 14"), 8).count() == 0 and not written
