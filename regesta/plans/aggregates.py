"""Grouped counts, shares and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query

#: First word of a part type -> group; other words fall into the default group.
GROUPS = {"STANDARD": "plain", "SMALL": "plain", "MEDIUM": "middle", "LARGE": "heavy", "ECONOMY": "plain", "PROMO": "promoted"}
DEFAULT = "other"


def group_of(token):
    return F.coalesce(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[token], F.lit(DEFAULT))


GROUP_CASE = "CASE token " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GROUPS.items()) + f" ELSE '{DEFAULT}' END"


@query(
    "cat_trajectory",
    f"""
WITH t AS (SELECT split_part(p_type, ' ', 1) AS token, CAST(floor(year(o_orderdate) / 5.0) * 5 AS INTEGER) AS bin
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
g AS (SELECT {GROUP_CASE} AS grp, bin FROM t),
c AS (SELECT grp, bin, count(*) AS n FROM g GROUP BY grp, bin)
SELECT a.grp, b.bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT grp FROM g) a CROSS JOIN (SELECT DISTINCT bin FROM g) b LEFT JOIN c ON c.grp = a.grp AND c.bin = b.bin
""",
)
def cat_trajectory(table):
    """Counts of every group in every bin of five years, absent pairs as 0: partial sums before the one shuffle, and a
    pivot over groups that are known beforehand."""
    lines = table("lineitem").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    bins = lines.select(group_of(F.split("p_type", " ")[0]).alias("grp"), (F.floor(F.year("o_orderdate") / 5) * 5).cast("int").alias("bin"))
    counts = bins.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
    scaffold = counts.select("grp").distinct().crossJoin(counts.select("bin").distinct())  # groups and bins are few by definition
    return scaffold.join(counts, ["grp", "bin"], "left").select("grp", "bin", F.coalesce("n", F.lit(0)).alias("n"))


W_ORDERS = "SELECT o_custkey AS dossier, o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS y, o_totalprice AS p FROM orders"


def entries(table):
    """Orders as documents of a dossier (the customer): dossier, status, y, p."""
    return table("orders").select(F.col("o_custkey").alias("dossier"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").cast("int").alias("y"), F.col("o_totalprice").alias("p"))


@query("dossier_stats", f"SELECT dossier, count(*) AS n, min(y) AS y0, max(y) AS y1, string_agg(DISTINCT status, '|' ORDER BY status) AS sources FROM ({W_ORDERS}) GROUP BY dossier")
def dossier_stats(table):
    """Documents, first and last year and the sorted set of sources of a dossier."""
    return entries(table).groupBy("dossier").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.array_join(F.array_sort(F.collect_set("status")), "|").alias("sources"))


@query(
    "entry_summary",
    f"""SELECT dossier, status, count(*) AS c, min(y) AS y0, max(y) AS y1, min(CASE WHEN status = 'F' THEN y END) AS dead_year,
           max(CASE WHEN status <> 'F' THEN y END) AS last_living FROM ({W_ORDERS}) GROUP BY dossier, status""",
)
def entry_summary(table):
    """An entry for each dossier and name form, with death and last living year by conditional aggregation."""
    dead = F.col("status") == "F"
    return entries(table).groupBy("dossier", "status").agg(F.count(F.lit(1)).alias("c"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min(F.when(dead, F.col("y"))).alias("dead_year"), F.max(F.when(~dead, F.col("y"))).alias("last_living"))


@query(
    "person_assemble",
    f"""WITH e AS (SELECT dossier, status, count(*) AS c, min(y) AS y0, max(y) AS y1 FROM ({W_ORDERS}) GROUP BY dossier, status)
        SELECT dossier, CAST(sum(c) AS BIGINT) AS c, min(y0) AS y0, max(y1) AS y1, string_agg(status, '|' ORDER BY status) AS forms FROM e GROUP BY dossier""",
)
def person_assemble(table):
    """Persons from entries: counts add up, years widen, sets unite."""
    parts = entry_summary(table)
    return parts.groupBy("dossier").agg(F.sum("c").alias("c"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.array_join(F.array_sort(F.collect_set("status")), "|").alias("forms"))


@query("multi_value_collect", "SELECT p_brand, string_agg(DISTINCT t, '|' ORDER BY t) AS tokens FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS t FROM part) WHERE t <> 'unk' GROUP BY p_brand")
def multi_value_collect(table):
    """The distinct values of a multi-valued column, without the mark for unknown."""
    split = table("part").select("p_brand", F.explode(F.split("p_type", " ")).alias("t")).where("t <> 'unk'")
    return split.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("t")), "|").alias("tokens"))


@query(
    "cat_share",
    f"SELECT y, status, round(100.0 * n / sum(n) OVER (PARTITION BY y), 6) AS share FROM (SELECT y, status, count(*) AS n FROM ({W_ORDERS}) GROUP BY y, status)",
)
def cat_share(table):
    """Share of each category in its year, in percent."""
    from pyspark.sql import Window as W

    counts = entries(table).groupBy("y", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("y", "status", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("y")), 6).alias("share"))


@query("top_occupations", "SELECT p_type AS occ, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, occ LIMIT 80")
def top_occupations(table):
    """The 80 most frequent categories (a report)."""
    return table("part").groupBy(F.col("p_type").alias("occ")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "occ").limit(80)


@query(
    "occ_heatmap",
    """WITH t AS (SELECT p_brand AS occ, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem JOIN part ON l_partkey = p_partkey),
            top AS (SELECT occ FROM t GROUP BY occ ORDER BY count(*) DESC, occ LIMIT 30)
       SELECT occ, y, count(*) AS n FROM t WHERE occ IN (SELECT occ FROM top) GROUP BY occ, y""",
)
def occ_heatmap(table):
    """The 30 top categories by year: the frequent ones come first, by a semi-join of at most 30 rows."""
    t = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("occ"), F.year("l_shipdate").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    top = t.groupBy("occ").agg(F.sum("n").alias("s")).orderBy(F.col("s").desc(), "occ").limit(30).select("occ")
    return t.join(F.broadcast(top), "occ", "left_semi")


@query(
    "span_rates",
    """SELECT l_orderkey, count(*) AS tokens, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r,
              round(100.0 * count(*) FILTER (WHERE l_returnflag = 'A') / greatest(count(*), 1), 6) AS r_a FROM lineitem GROUP BY l_orderkey""",
)
def span_rates(table):
    """Counts of spans by class and the rate per 100 tokens; classes without spans are 0."""
    n = lambda v: F.count_if(F.col("l_returnflag") == v)
    return table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("tokens"), n("A").alias("n_a"), n("R").alias("n_r"), F.round(100.0 * n("A") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("r_a"))


@query(
    "role_entropy",
    """WITH c AS (SELECT l_orderkey AS k, l_returnflag AS r, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY k) AS s FROM c)
       SELECT k, round(-sum(n / s * log2(n / s)) + 0.0, 6) AS h FROM t GROUP BY k""",
)
def role_entropy(table):
    """Entropy (base 2) of the roles of an event: counts first, then one aggregation a key."""
    from pyspark.sql import Window as W

    c = table("lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_returnflag").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("k")))
    return c.groupBy("k").agg(F.round(-F.sum(F.col("p") * F.log2("p")) + 0.0, 6).alias("h"))


@query("conf_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS low FROM events GROUP BY event_type")
def conf_stats(table):
    """Mean, population deviation and share of low values."""
    return table("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.avg((F.col("value") < 50).cast("double")), 6).alias("low"))


@query("dossier_medians", f"SELECT dossier, round(median(p), 6) AS med, round(avg(p), 6) AS mean, count(*) AS n FROM ({W_ORDERS}) GROUP BY dossier")
def dossier_medians(table):
    """Median, mean and count of a dossier."""
    return entries(table).groupBy("dossier").agg(F.round(F.median("p"), 6).alias("med"), F.round(F.avg("p"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    "ring_gradient",
    """WITH d AS (SELECT sqrt(CAST(embedding[1] AS DOUBLE) * embedding[1] + CAST(embedding[2] AS DOUBLE) * embedding[2]) AS r, embedding[3] AS v FROM embeddings)
       SELECT CAST(ceil(r / 0.05) AS BIGINT) AS ring, round(avg(v), 5) AS mean, count(*) AS n FROM d WHERE r > 0 GROUP BY 1""",
)
def ring_gradient(table):
    """Means by rings (a, b] around the centre; the centre itself is in no ring, empty rings are absent."""
    e = table("embeddings").select(F.hypot(F.col("embedding")[0], F.col("embedding")[1]).alias("r"), F.col("embedding")[2].cast("double").alias("v")).where("r > 0")
    return e.groupBy(F.ceil(F.col("r") / 0.05).cast("long").alias("ring")).agg(F.round(F.avg("v"), 5).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    "flow_grouping_sets",
    """WITH e AS (SELECT CAST(floor(vec_id / 100) AS BIGINT) AS decade, CAST(floor(embedding[1] / 0.1) AS BIGINT) AS cx, CAST(embedding[2] AS DOUBLE) AS dx, CAST(embedding[3] AS DOUBLE) AS dy FROM embeddings)
       SELECT decade, cx, count(*) AS n, round(atan2(sum(dy), sum(dx)), 5) AS angle, round(sqrt(sum(dx) * sum(dx) + sum(dy) * sum(dy)) / count(*), 5) AS coherence
       FROM e GROUP BY GROUPING SETS ((decade, cx), (cx)) HAVING count(*) >= 3""",
)
def flow_grouping_sets(table):
    """Vector sums of a cell, by decade and over all decades in one pass."""
    e = table("embeddings").select(F.floor(F.col("vec_id") / 100).cast("long").alias("decade"), F.floor(F.col("embedding")[0] / 0.1).cast("long").alias("cx"), F.col("embedding")[1].cast("double").alias("dx"), F.col("embedding")[2].cast("double").alias("dy"))
    g = e.groupingSets([["decade", "cx"], ["cx"]], "decade", "cx").agg(F.count(F.lit(1)).alias("n"), F.round(F.atan2(F.sum("dy"), F.sum("dx")), 5).alias("angle"), F.round(F.hypot(F.sum("dx"), F.sum("dy")) / F.count(F.lit(1)), 5).alias("coherence"))
    return g.where("n >= 3")


@query("name_index", "SELECT event_type AS name, count(*) AS c, min(user_id) AS y0, max(user_id) AS y1, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY c DESC, name LIMIT 80")
def name_index(table):
    """Names by frequency, with bounds and distinct counts (a report of 80)."""
    g = table("events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("c"), F.min("user_id").alias("y0"), F.max("user_id").alias("y1"), F.countDistinct("user_id").alias("users"))
    return g.orderBy(F.col("c").desc(), "name").limit(80)


@query("place_status", "SELECT s_nationkey AS place, CASE WHEN bool_or(s_acctbal < 0) THEN 'auto' ELSE 'checked' END AS status, count(*) AS n FROM supplier GROUP BY 1")
def place_status(table):
    """Any automatic member makes a place automatic."""
    return table("supplier").groupBy(F.col("s_nationkey").alias("place")).agg(F.when(F.bool_or(F.col("s_acctbal") < 0), "auto").otherwise("checked").alias("status"), F.count(F.lit(1)).alias("n"))


@query("corpus_stats", "SELECT count(*) AS docs, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (WHERE n_chars < 200) AS short FROM documents")
def corpus_stats(table):
    """Seven figures of a corpus in one aggregation."""
    return table("documents").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("n_chars") < 200).alias("short"))


@query("identity_stats", "SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS poor FROM labels")
def identity_stats(table):
    """Filtered counts in one pass."""
    q, t = F.col("quality"), F.col("toxic")
    return table("labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(q == 1).alias("good"), F.count_if(t == 1).alias("toxic"), F.count_if((q == 0) & (t == 0)).alias("poor"))


@query("dossier_listing", f"SELECT dossier, min(y) AS y0, max(y) AS y1, count(*) AS n, min(status) AS place FROM ({W_ORDERS}) GROUP BY dossier ORDER BY n DESC, dossier LIMIT 100")
def dossier_listing(table):
    """The 100 largest dossiers (a listing); the bare column is pinned to its minimum."""
    return entries(table).groupBy("dossier").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"), F.min("status").alias("place")).orderBy(F.col("n").desc(), "dossier").limit(100)


@query(
    "year_scaffold",
    f"""WITH c AS (SELECT y, status, count(*) AS n FROM ({W_ORDERS}) WHERE p > 300000 GROUP BY 1, 2), b AS (SELECT min(y) AS a, max(y) AS z FROM c)
        SELECT s.y, t.status, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (SELECT CAST(unnest(range(a, z + 1)) AS INTEGER) AS y FROM b) s CROSS JOIN (SELECT DISTINCT status FROM c) t LEFT JOIN c ON c.y = s.y AND c.status = t.status""",
)
def year_scaffold(table):
    """Counts by year and category over the whole range of years, gaps as 0."""
    c = entries(table).where("p > 300000").groupBy("y", "status").agg(F.count(F.lit(1)).alias("n"))
    years = c.agg(F.min("y").alias("a"), F.max("y").alias("z")).select(F.explode(F.sequence("a", "z")).alias("y"))
    frame = years.crossJoin(c.select("status").distinct())  # a row a year and category
    return frame.join(c, ["y", "status"], "left").select("y", "status", F.coalesce("n", F.lit(0)).alias("n"))
