"""Operators against plain Python, and functions against tables of cases."""

import random

from pyspark.sql import functions as F

from regesta.functions import life, money, names
from regesta.operators import graph, runs, search
from regesta.plans import catalogue, joins
from regesta.streaming.runs import windowed_counts


def test_anchored_runs(spark):
    rows = [[1400, 1450, 1480, 1481, 1600], [1500], list(range(1300, 1700, 7))]

    def plain(years, cap, gap):
        starts, start, last = [], None, None
        for y in years:
            if start is None or y - start > cap or y - last >= gap:
                start = y
                starts.append(y)
            last = y
        return starts

    df = spark.createDataFrame([(r,) for r in rows], "ys array<int>").select("ys", runs.anchored_runs(F.col("ys"), 80, 40).alias("s"))
    assert all(r.s == plain(r.ys, 80, 40) for r in df.collect())


def test_death_split(spark):
    df = spark.createDataFrame([("a", 1500, False), ("a", 1510, True), ("a", 1510, False), ("a", 1511, False), ("b", 1, False)], "k string, y int, dead boolean")
    assert [r.part for r in runs.death_split(df, ["k"], "y", "dead").orderBy("k", "y", "dead").collect()] == [0, 0, 0, 1, 0]


def test_components_and_guard(spark):
    random.seed(2)
    nodes = [(i, 1500 + random.randint(0, 150)) for i in range(80)]
    nodes = [(i, lo, lo + 10) for i, lo in nodes]
    pairs = [(a, b, k) for k, (a, b) in enumerate({tuple(sorted(random.sample(range(80), 2))) for _ in range(90)})]
    root = {i: i for i, _, _ in nodes}
    span = {i: (lo, hi) for i, lo, hi in nodes}
    for a, b, _ in pairs:
        x, y = root[a], root[b]
        lo, hi = min(span[x][0], span[y][0]), max(span[x][1], span[y][1])
        if x != y and hi - lo <= 80:
            keep, gone = min(x, y), max(x, y)
            span[keep] = (lo, hi)
            root = {n: keep if r == gone else r for n, r in root.items()}
    got = graph.guarded_clusters(spark.createDataFrame(nodes, "node long, lo int, hi int"), spark.createDataFrame(pairs, "a long, b long, seq long"), 80).collect()
    assert got and all(root[r.node] == r.cluster for r in got)


def test_guard_with_hubs_ties_and_unknown_years(spark):
    """Merging pair by pair gives the same groups where hubs grow by many pairs, orders tie and bounds or nodes are missing."""
    rnd = random.Random(5)
    nodes = [(i, *[None if rnd.random() < 0.1 else rnd.randint(0, 150)] * 2) for i in range(150) if rnd.random() > 0.05]
    pairs = [(a, b, (a * 7 + b) % 30) for a, b in {(rnd.randrange(3) if rnd.random() < 0.5 else rnd.randrange(150), rnd.randrange(150)) for _ in range(400)}]
    root = {n: n for a, b, _ in pairs if a != b for n in (a, b)}
    known = {i: [x for x in (lo, hi) if x is not None] for i, lo, hi in nodes}
    years = {n: known.get(n, []) for n in root}
    for a, b, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a != b and root[a] != root[b]:
            both = years[root[a]] + years[root[b]]
            if not both or max(both) - min(both) <= 80:
                keep, gone = sorted((root[a], root[b]))
                years[keep] = both
                root = {n: keep if r == gone else r for n, r in root.items()}
    got = graph.guarded_clusters(spark.createDataFrame(nodes, "node long, lo int, hi int"), spark.createDataFrame(pairs, "a long, b long, seq long"), 80)
    assert {r.node: r.cluster for r in got.collect()} == root


def test_guard_goes_on_in_parts_of_the_order(spark, monkeypatch):
    """Components with more pairs than a task takes are merged in parts and give the same groups; a long chain in rising
    order takes no round a pair."""
    rnd = random.Random(7)
    nodes = [(i, y, y + 5) for i, y in ((i, rnd.randint(0, 120)) for i in range(120))]
    pairs = [(rnd.randrange(4) if rnd.random() < 0.5 else rnd.randrange(120), rnd.randrange(120), rnd.randrange(50)) for _ in range(400)]
    asked = spark.createDataFrame(nodes, "node long, lo int, hi int"), spark.createDataFrame(pairs, "a long, b long, seq long"), 60
    whole = {tuple(r) for r in graph.guarded_clusters(*asked).collect()}
    monkeypatch.setattr(graph, "PAIRS", 150)
    assert {tuple(r) for r in graph.guarded_clusters(*asked).collect()} == whole and len({c for _, c in whole}) < len(whole)
    monkeypatch.undo()
    real, calls = graph.saved, []
    monkeypatch.setattr(graph, "saved", lambda df: calls.append(1) or real(df))
    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b", "id AS seq")
    got = graph.guarded_clusters(spark.range(301).selectExpr("id AS node", "0 AS lo", "0 AS hi"), chain)
    assert {r.cluster for r in got.collect()} == {0} and got.count() == 301 and len(calls) < 60


def test_components_of_chains(spark, monkeypatch):
    """Each round leaves the edges between trees only."""
    rnd, sizes, real = random.Random(4), [], graph.saved

    def counted(df):
        out = real(df)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "saved", counted)
    names = list(range(2000))
    rnd.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(1999) if i % 500 != 499] + [(7, 7), (None, 3)]
    want = {n: min(names[i // 500 * 500 : i // 500 * 500 + 500]) for i, n in enumerate(names)}
    got = graph.component_labels(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == want
    assert all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
    assert graph.component_labels(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_guard_without_pairs(spark):
    nodes, pairs = spark.createDataFrame([(1, 0, 5)], "node long, lo int, hi int"), "a long, b long, seq long"
    assert graph.guarded_clusters(nodes, spark.createDataFrame([], pairs)).isEmpty()
    assert [tuple(r) for r in graph.guarded_clusters(nodes.union(nodes.selectExpr("2L", "200", "210")), spark.createDataFrame([(1, 2, 1)], pairs)).orderBy("node").collect()] == [(1, 1), (2, 2)]


def test_graph_queries_take_all_rows(spark, tmp_path):
    rows = [(1, 10, 5, 1.0, 30.0, "A"), (2, 10, 5, 2.0, 40.0, "R"), (2, 11, 6, 3.0, 50.0, "A"), (3, 12, 7, 4.0, 20.0, "R"), (4, 12, 5, 5.0, 45.0, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_extendedprice double, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, DATE '1995-01-01' AS o_orderdate FROM range(1, 5)").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: {tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("guarded_cluster") == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert run("component_labels") == {(2, 2), (4, 2), (21, 2), (23, 2), (6, 6), (8, 6), (25, 6)}
    assert {r[:3] for r in run("transitive_link_best")} == {(1, 10, 5), (1, 12, 5)}


def test_best_links_equal_plain_loops_in_small_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 50)
    monkeypatch.setattr(joins, "SIDE", 6)
    rnd = random.Random(5)
    some = lambda *values: rnd.choice([None, *values])
    rows = [(some(*range(12)), some(*range(9)), some(0, 0, 0, *range(1, 9)), some(1.0, 2.0, 3.0), rnd.choice(["A", "R", "N", None])) for _ in range(600)]  # part 0 is hot
    want, pairs = {}, 0
    for x, _, via, amb, flag in rows:
        for _, z, other, _, back in rows:
            if flag == "A" and back == "R" and via is not None and via == other:
                pairs += 1
                want[x, z] = min(want.get((x, z), (True, 99, 99)), (amb is None, amb or 0, via))
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["transitive_link_best"](spark, str(tmp_path))
    links = got.collect()
    assert len(links) == len(want) and {(r.x, r.z): (r.amb is None, r.amb or 0, r.via) for r in links} == want
    assert got.rdd.getNumPartitions() > pairs // 50


def test_life_anchor_cases(spark):
    cases = [(1619, False, False, "before_birth"), (1630, False, True, "child"), (1686, False, True, "after_death"), (1700, False, False, "late_naming"), (1680, True, False, "dead_early"), (1750, True, False, "beyond"), (1684, False, True, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, y int, late boolean, strong boolean, want string")
    got = df.select("y", "want", life.conflict(life.bounds(F.lit(1620), F.lit(1683)), F.col("y"), F.col("late"), F.col("strong")).alias("c")).collect()
    assert all(r.c == r.want for r in got)


def test_years_money_names(spark):
    one = spark.range(1)
    row = one.select(
        life.year_of(F.lit("um 1423/24")).alias("a"), life.year_of(F.lit("149X")).alias("b"), money.total(F.lit("2 pound 3 shilling")).alias("c"), money.total(F.lit("none")).alias("d"),
        money.first_of_parts(F.lit("10 pound 2 shilling|3 shilling")).alias("e"), names.levenshtein_ratio(F.lit("anna"), F.lit("hanna")).alias("f"), names.strip_accents(F.lit("Éva")).alias("g"),
    ).first()
    assert tuple(row) == (1423, None, 43.0, None, 203.0, 0.0, "eva")


def test_search_prefix(spark):
    index = search.token_index(spark.createDataFrame([(1, "House and garden"), (2, "housing")], "id long, t string"), "id", "t")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.prefix_fallback(index, "house")) == [1] and ids(search.prefix_fallback(index, "hou")) == [1, 2]
    assert ids(search.boolean(index, ["house"], ["garden"])) == []


def test_asked_index_equals_the_whole_one(spark):
    docs = spark.createDataFrame([(1, "The thing, the"), (2, "thing"), (3, None), (4, " ,")], "id long, t string")
    index, lengths = search.asked_index(docs, "id", "t", ["the", "thing"])
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "term", "tf", "dl").collect())
    assert rows(index) == rows(search.token_index(docs, "id", "t")) and sorted(tuple(r) for r in lengths.collect()) == [(1, 3), (2, 1)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    show = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert show(spark.table("counts")) == show(windowed_counts(events))
