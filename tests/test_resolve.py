"""Likeness, merges, runs and file sources: decisive cases by hand, and folds against plain loops."""

import random

from pyspark.sql import functions as F

from regesta.functions import records, similar
from regesta.operators import resolve, space
from regesta.sources import files


def test_sound_codes(spark):
    known = {"Wikipedia": "3412", "Breschnew": "17863", "Vogt": "342", "Meyer": "67", "Maier": "67", "Philipp": "351", "Xaver": "4837", "": "", "Schmidt": "862"}
    rows = spark.createDataFrame(list(known.items()), "name string, want string").withColumn("got", similar.sound_code(F.col("name"))).collect()
    assert {r.name: r.got for r in rows} == known


def test_ratios(spark):
    rows = [("hans", "hans", 1.0), ("hans", "anna", 0.0), ("", "x", 0.0), ("gisler", "gysler", 10 / 12), (None, "a", 0.0)]
    got = spark.createDataFrame(rows, "a string, b string, want double").withColumn("r", similar.ratio("a", "b")).collect()
    assert all(abs(r.r - r.want) < 1e-9 for r in got)
    given = spark.createDataFrame([("hans peter", "hans", 1.0), ("hans", "hans peter", 0.0), ("", "", 0.0)], "a string, b string, want double")
    assert all(r.got == r.want for r in given.withColumn("got", similar.article_given_ratio(F.col("a"), F.col("b"))).collect())


def merged(spark, rows):
    return {(r.dossier, r.name): r.merged for r in resolve.merged_names(spark.createDataFrame(rows, "dossier string, name string, year int")).collect()}


def test_names_merge_into_the_only_fuller_one(spark):
    got = merged(spark, [("a", "Anna", 1500), ("a", "Anna Clor", 1510), ("b", "Anna", 1500), ("b", "Anna Clor", 1510), ("b", "Anna Meyer", 1512), ("c", "Hans Gisler", 1500), ("c", "Hans Gisler Jakob", 1590), ("d", None, 1500)])
    assert got["a", "Anna"] == "Anna Clor" and got["b", "Anna"] == "Anna" and got["c", "Hans Gisler"] == "Hans Gisler" and len(got) == 7
    assert merged(spark, [("e", "Hans Gysler", 1500), ("e", "Hans Gisler Jakob", 1520)])["e", "Hans Gysler"] == "Hans Gisler Jakob"


def runs(spark, rows):
    return {r.id: r.run for r in resolve.attached_runs(spark.createDataFrame([("k", i, y, b) for i, y, b in rows], "key string, id int, year int, bare boolean"), ["key"]).collect()}


def test_runs_with_bare_names(spark):
    got = runs(spark, [(1, 1439, False), (2, 1441, False), (3, 1519, False), (4, 1520, False), (5, None, False), (6, 1534, True), (7, 1600, True), (8, 1614, True), (9, 1629, True)])
    assert got[1] == got[2] == got[3] and got[4] != got[3] and got[5] == "f0"
    assert got[6] == got[4] and got[7] == got[8] != got[9]
    assert runs(spark, [(1, 1500, False), (2, 1580, False), (3, 1590, True)])[3] == "b1"  # would stretch the run beyond a life
    assert runs(spark, [(1, 1500, False), (2, 1514, True), (3, 1520, False)])[2] == "f1"


def test_runs_equal_plain_loops_and_go_in_one_pass(spark):
    rng = random.Random(3)
    for life, silence in [(80, 15), (10, 40), (900, 60)]:
        rows = sorted((rng.randrange(1000), rng.random() < 0.5) for _ in range(150))
        years, bare = [y for y, _ in rows], [b for _, b in rows]
        got, anchors, start = resolve.attach(years, bare, life, silence), [], None
        for y, b in rows:
            if not b and (start is None or y - start > life):
                start = y
                anchors.append([])
            if not b:
                anchors[-1].append(y)
        span = [[v[0], v[-1]] for v in anchors]
        for (y, b), run in zip(rows, got):
            if b:
                fit = [(min(abs(y - a) for a in v), k) for k, v in enumerate(anchors) if max(span[k][1], y) - min(span[k][0], y) <= life]
                fit = [x for x in fit if x[0] < silence]
                assert run.startswith("f") == bool(fit)
                if fit:
                    k = min(fit)[1]
                    span[k] = [min(span[k][0], y), max(span[k][1], y)]
            else:
                k = next(k for k, v in enumerate(anchors) if v[0] <= y <= v[-1])
            assert not run.startswith("f") or run == f"f{k + 1}"
    rows = spark.createDataFrame([("k", 1, 1500, False)], "key string, id int, year int, bare boolean")
    assert "FlatMapGroups" not in operators_of(resolve.attached_runs(rows, ["key"]))


def test_across_dossiers(spark):
    schema = "key string, id int, y0 int, y1 int, dead int, living array<int>"
    rows = [("k", 1, 1500, 1520, None, [1500, 1520]), ("k", 2, 1515, 1530, 1530, [1515]), ("k", 3, 1525, 1540, None, [1525, 1540]), ("k", 4, 1510, 1595, None, [1510]), ("k", 5, 1531, 1531, 1531, []), ("m", 6, 1500, 1500, None, [1500])]
    got = {r.id: r.person for r in resolve.across_dossiers(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6}


def operators_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dossiers_are_folded_many_in_a_pass(spark):
    """A task folds its dossiers over its batches, not by a call a dossier; dossiers may go over several batches."""
    rows = [(d, n, y) for d in range(40) for n, y in [("Anna", 1500), ("Anna Clor", 1510), ("Hans", 1500), ("Hans Gysler Jakob", 1590), *[(f"x{d} y{k}", None) for k in range(d % 7)]]] + [(None, "Anna", 1), (None, "Anna Clor", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = resolve.merged_names(spark.createDataFrame(rows, "dossier long, name string, year int"))
        assert "FlatMapGroups" not in operators_of(df)
        got = {(r.dossier, r.name): r.merged for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(d, n): "Anna Clor" if n == "Anna" else n for d, n, _ in rows}


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, rng.random() * 100, rng.random() * 10) for i in range(60)] + [(100, 1e4, 1e4)]
    got = sorted((r.a, r["rank"], r.b) for r in space.nearest(spark.createDataFrame(pts, "id long, x double, y double"), 3, 5.0).collect())
    want = []
    for a, x, y in pts:
        near = sorted(((x - p) ** 2 + (y - q) ** 2, b) for b, p, q in pts if b != a)[:3]
        want += [(a, k + 1, b) for k, (_, b) in enumerate(near)]
    assert got == sorted(want)
    assert space.nearest(spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"), 3, 5.0).count() == 0


def test_nearest_and_sums_of_crowds(spark):
    """Many points at one place, and a crowd far from a few others, make no pairs of points."""
    rng = random.Random(2)
    pts = [(i, 5.0, 5.0, 1.0) for i in range(3000)] + [(3000 + i, rng.random(), rng.random(), None if i % 3 else 2.0) for i in range(300)] + [(4000, 1e5, 1e5, None), (4001, None, 1.0, 3.0), (4002, float("nan"), 1.0, 3.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double, v double")
    got, pairs = space.nearest(df, 3, 1e6), []
    real, space.within = space.within, lambda *a: pairs.append(real(*a).count()) or real(*a)
    try:
        rows = {(r.a, r["rank"]): r.b for r in space.nearest(df, 3, 1e6).collect()}
    finally:
        space.within = real
    assert max(pairs) < 60_000  # of 3300 * 3300
    known = [p for p in pts if p[0] < 4001]
    for a, x, y, _ in known[:3] + known[3000:3040] + known[-1:]:
        assert [rows[a, k] for k in (1, 2, 3)] == [b for _, b in sorted(((x - p) * (x - p) + (y - q) * (y - q), b) for b, p, q, _ in known if b != a)[:3]]
    assert len(rows) == 3 * len(known) == got.count()
    sums = {r.id: r for r in space.around(df, 0.3, 1.0).collect()}
    assert len(sums) == len(known) and sums[0].near == 3000 and sums[4000].near == 1 and sums[4000].value is None
    for a, x, y, _ in known[3000:3300:20]:
        near = [((x - p) * (x - p) + (y - q) * (y - q), v) for _, p, q, v in known]
        near = [(d, v) for d, v in near if d <= 0.09]
        assert sums[a].near == len(near) and abs(sums[a].weight - sum(1 / (d + 1) for d, _ in near)) < 1e-9
        assert abs((sums[a].value or 0) - sum(v / (d + 1) for d, v in near if v is not None)) < 1e-9


DOC = """<corpus><document id="d1"><metadata><year>1500</year><dossier_id>x</dossier_id><source>s</source></metadata><text>t</text><spans>
<span id="p1" start="0" end="9" element="reference" class="per"><text>Anna, wife of Hans</text><span id="h1" start="0" end="4" element="head" class=""><text>Anna</text></span></span>
<span id="p2" start="10" end="12" element="reference" class="per"><text>she</text></span></spans>
<relations><role role="seller" ref="p1"/><role role="buyer" ref="p1"/><role role="seller" ref="p1"/></relations></document>
<document id="d2"><metadata><year>none</year></metadata><text/></document></corpus>"""


def test_annotated_documents(spark, tmp_path):
    (tmp_path / "a.xml").write_text(DOC)
    docs = files.read_documents(spark, str(tmp_path))
    assert {(r.id, r.year, r.dossier) for r in docs.collect()} == {("d1", 1500, "x"), ("d2", None, None)}
    assert [tuple(r) for r in files.person_rows(docs).collect()] == [("d1", 1500, "x", "p1", "Anna", "seller|buyer")]


def test_persons_of_documents_are_read_once(spark, tmp_path):
    """One parse, no join: a document met twice gives its rows twice, not four times; a person without a head gives none."""
    (tmp_path / "a.xml").write_text(DOC)
    (tmp_path / "b.xml").write_text(DOC.replace('id="h1"', 'id="h3"').replace("</span>\n<span id=\"p2\"", '<span id="h2" start="0" end="1" element="head" class=""><text>Ann</text></span></span>\n<span id="p2"'))
    df = files.person_rows(files.read_documents(spark, str(tmp_path)))
    assert operators_of(df).count("Scan xml") == 1 and "Join" not in operators_of(df)
    assert sorted(tuple(r) for r in df.collect()) == [("d1", 1500, "x", "p1", "Ann", "seller|buyer"), ("d1", 1500, "x", "p1", "Anna", "seller|buyer")]


def test_year_ranges(spark):
    rows = [("1500-73", 1500, 1573), ("x 1598-02", 1598, 1602), ("1500-1700", None, None), ("none", None, None), ("1500/1520", 1500, 1520)]
    got = spark.createDataFrame(rows, "t string, a int, b int").select("t", "a", "b", records.year_range(F.col("t")).alias("r")).collect()
    assert all((r.r.first, r.r.last) == (r.a, r.b) for r in got)
