"""Look-ups, cascades, interval and set joins, candidate links."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import levenshtein_ratio
from .aggregates import W_ORDERS, entries
from .registry import query

c = F.col
PAIRS, SIDE = 1_000_000, 1_000  # of links, in a task; of either side of a cell


@query("coord_lookup_join", "SELECT o_orderkey, n_nationkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def coord_lookup_join(table):
    """Mention -> person -> place: equi-joins; Spark broadcasts the small sides by their measured size."""
    return table("orders").join(table("customer"), c("o_custkey") == c("c_custkey")).join(table("nation"), c("c_nationkey") == c("n_nationkey")).join(table("region"), c("n_regionkey") == c("r_regionkey")).select("o_orderkey", "n_nationkey", "n_name", "r_name")


@query(
    "explode_topk_persons",
    """WITH t AS (SELECT l_suppkey AS person, l_partkey AS place, count(*) AS n FROM lineitem GROUP BY 1, 2)
       SELECT place, person, n, k FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY n DESC, person) AS k FROM t) WHERE k <= 8""",
)
def explode_topk_persons(table):
    """The eight persons with most mentions of a place: one row a pair before the window."""
    t = table("lineitem").groupBy(c("l_suppkey").alias("person"), c("l_partkey").alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("k", F.row_number().over(W.partitionBy("place").orderBy(c("n").desc(), "person"))).where("k <= 8").select("place", "person", "n", c("k").cast("long"))


@query(
    "full_outer_meta",
    """WITH a AS (SELECT c_custkey AS k, c_name FROM customer), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1)
       SELECT coalesce(a.k, b.k) AS k, c_name, coalesce(n, 0) AS n FROM a FULL JOIN b ON a.k = b.k""",
)
def full_outer_meta(table):
    """Both key sets, with metadata where there is some."""
    a = table("customer").select(c("c_custkey").alias("k"), "c_name")
    b = table("orders").where("o_totalprice > 200000").groupBy(c("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, "k", "full").select("k", "c_name", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "lookup_cascade",
    """WITH e AS (SELECT o_custkey AS d, o_orderpriority AS name, min(o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), g AS (SELECT o_orderpriority AS name, min(o_orderkey) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
       SELECT o_orderkey, coalesce(e.p, g.p) AS person, CASE WHEN e.p IS NOT NULL THEN 'exact' WHEN g.p IS NOT NULL THEN 'global' ELSE 'none' END AS how
       FROM orders o LEFT JOIN e ON e.d = o_custkey AND e.name = o_orderpriority LEFT JOIN g ON g.name = o_orderpriority WHERE o.o_orderstatus = 'P'""",
)
def lookup_cascade(table):
    """Exact pair, else the first of the name anywhere, else nothing."""
    o = table("orders")
    e = o.where("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("d"), c("o_orderpriority").alias("en")).agg(F.min("o_orderkey").alias("ep"))
    g = o.where("o_orderstatus = 'O'").groupBy(c("o_orderpriority").alias("gn")).agg(F.min("o_orderkey").alias("gp"))
    j = o.where("o_orderstatus = 'P'").join(e, (c("d") == c("o_custkey")) & (c("en") == c("o_orderpriority")), "left").join(g, c("gn") == c("o_orderpriority"), "left")
    return j.select("o_orderkey", F.coalesce("ep", "gp").alias("person"), F.when(c("ep").isNotNull(), "exact").when(c("gp").isNotNull(), "global").otherwise("none").alias("how"))


@query(
    "interval_lookup_status",
    f"""WITH p AS (SELECT dossier, status, min(y) AS y0, max(y) AS y1, count(*) AS n FROM ({W_ORDERS}) GROUP BY 1, 2), m AS (SELECT o_orderkey AS id, o_custkey AS dossier, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
        j AS (SELECT m.id, m.y, p.status, y0, y1, n, m.y BETWEEN y0 AND y1 AS inside FROM m JOIN p ON m.dossier = p.dossier),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, n DESC, status) AS k, count(*) FILTER (WHERE inside) OVER (PARTITION BY id) AS hits FROM j)
        SELECT id, status AS person, CASE WHEN hits = 1 THEN 'unique' WHEN hits > 1 THEN 'ambiguous' ELSE 'year_outside' END AS how FROM r WHERE k = 1""",
)
def interval_lookup_status(table):
    """Who of a dossier was meant in a year: the pairs stay within a dossier, then a ranked choice with its status."""
    p = entries(table).groupBy("dossier", "status").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
    m = table("orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("dossier"), F.year("o_orderdate").alias("y"))
    j = m.join(p, "dossier").withColumn("inside", c("y").between(c("y0"), c("y1")))
    by = W.partitionBy("id")
    r = j.withColumn("k", F.row_number().over(by.orderBy(F.when(c("inside"), 0).otherwise(1), c("n").desc(), "status"))).withColumn("hits", F.sum(c("inside").cast("int")).over(by))
    return r.where("k = 1").select("id", c("status").alias("person"), F.when(c("hits") == 1, "unique").when(c("hits") > 1, "ambiguous").otherwise("year_outside").alias("how"))


@query(
    "set_equality_join",
    """WITH s AS (SELECT l_orderkey AS k, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), '|' ORDER BY CAST(l_suppkey AS VARCHAR)) AS pages FROM lineitem GROUP BY 1)
       SELECT pages, count(*) AS n, min(k) AS first, max(k) AS last FROM s GROUP BY pages HAVING count(*) > 1""",
)
def set_equality_join(table):
    """Documents with the same set of pages: the sorted set is the key, so groups need no pairs."""
    s = table("lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_set(c("l_suppkey").cast("string"))), "|").alias("pages"))
    return s.groupBy("pages").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.max("k").alias("last")).where("n > 1")


@query(
    "transitive_link_best",
    """WITH a AS (SELECT DISTINCT l_orderkey AS x, l_partkey AS via, l_quantity AS amb FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS z, l_partkey AS via FROM lineitem WHERE l_returnflag = 'R')
       SELECT x, z, via, amb FROM (SELECT x, z, via, amb, row_number() OVER (PARTITION BY x, z ORDER BY amb, via) AS k FROM a JOIN b USING (via)) WHERE k = 1""",
)
def transitive_link_best(table):
    """Links over a shared id, the least ambiguous a pair, unknown ambiguities last. Both the join and the choice go in
    as many tasks as there are PAIRS of links, counted first; an id with more of them is cut into cells of SIDE by SIDE."""
    li = table("lineitem").select(c("l_orderkey").alias("x"), c("l_suppkey").alias("z"), c("l_partkey").alias("via"), c("l_quantity").alias("amb"), c("l_returnflag").alias("flag")).where("via is not null and flag in ('A', 'R')")
    found = li.groupBy("via").agg(F.count_if(c("flag") == "A").alias("na"), F.count_if(c("flag") == "R").alias("nb")).withColumn("pairs", c("na") * c("nb"))
    work, hot = found.agg(F.sum(c("pairs") + c("na") + c("nb")), F.collect_list(F.when(c("pairs") > PAIRS, F.struct("via", F.ceil(c("na") / SIDE), F.ceil(c("nb") / SIDE))))).first()
    n = max((work or 0) // PAIRS + 1, li.sparkSession.sparkContext.defaultParallelism)
    cells = li.sparkSession.createDataFrame(hot, f"via {li.schema['via'].dataType.simpleString()}, rows long, cols long")
    li = li.join(F.broadcast(cells), "via", "left").na.fill(1, ["rows", "cols"])
    place = lambda name, by, of: F.pmod(F.xxhash64(by), of).alias(name)
    all_of = lambda name, of: F.explode(F.sequence(F.lit(0).cast("long"), c(of) - 1)).alias(name)
    a = li.where("flag = 'A'").select("x", "via", "amb", place("row", "x", c("rows")), all_of("col", "cols")).repartition(n, "via", "row", "col").groupBy("via", "row", "col", "x").agg(F.min("amb").alias("amb"))
    b = li.where("flag = 'R'").select("z", "via", place("col", "z", c("cols")), all_of("row", "rows")).repartition(n, "via", "row", "col").distinct()
    links = a.join(b, ["via", "row", "col"]).select("x", "z", F.struct(c("amb").isNull().alias("unknown"), "amb", "via").alias("m")).repartition(n, "x", "z")
    return links.groupBy("x", "z").agg(F.min("m").alias("m")).select("x", "z", "m.via", "m.amb")


@query(
    "date_check_join",
    """SELECT a.o_orderkey AS id, CASE WHEN b.y IS NULL THEN 'unchecked' WHEN abs(year(a.o_orderdate) - b.y) <= 1 THEN 'ok' ELSE 'MISMATCH' END AS verdict
       FROM orders a JOIN (SELECT l_orderkey AS k, max(CASE WHEN l_returnflag = 'R' THEN year(l_shipdate) END) AS y FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.k""",
)
def date_check_join(table):
    """Facts joined to candidates, dates compared."""
    b = table("lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.max(F.when(c("l_returnflag") == "R", F.year("l_shipdate"))).alias("y"))
    v = F.when(c("y").isNull(), "unchecked").when(F.abs(F.year("o_orderdate") - c("y")) <= 1, "ok").otherwise("MISMATCH")
    return table("orders").join(b, c("o_orderkey") == c("k")).select(c("o_orderkey").alias("id"), v.alias("verdict"))


@query(
    "prefer_tagged_else_unique",
    """WITH k AS (SELECT s_nationkey AS f, s_suppkey AS a, s_acctbal > 8000 AS tagged, count(*) OVER (PARTITION BY s_nationkey) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 8000 THEN 0 ELSE 1 END, s_suppkey) AS r FROM supplier)
       SELECT f, a, tagged FROM k WHERE r = 1 AND (tagged OR n = 1)""",
)
def prefer_tagged_else_unique(table):
    """A tagged article if there is one, else the only one."""
    by = W.partitionBy("f")
    k = table("supplier").select(c("s_nationkey").alias("f"), c("s_suppkey").alias("a"), (c("s_acctbal") > 8000).alias("tagged"))
    k = k.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("r", F.row_number().over(by.orderBy(F.when(c("tagged"), 0).otherwise(1), "a")))
    return k.where((c("r") == 1) & (c("tagged") | (c("n") == 1))).select("f", "a", "tagged")


@query(
    "cooccurrence_docs",
    """SELECT b.l_suppkey AS other, count(*) AS n, count(DISTINCT b.l_orderkey) AS docs FROM lineitem b WHERE b.l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1) AND b.l_suppkey <> 1 GROUP BY 1""",
)
def cooccurrence_docs(table):
    """Other names in the documents of a name: a semi-join on documents, never a self-join of mentions."""
    li = table("lineitem")
    mine = li.where("l_suppkey = 1").select("l_orderkey").distinct()
    return li.where("l_suppkey <> 1").join(mine, "l_orderkey", "left_semi").groupBy(c("l_suppkey").alias("other")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("docs"))


@query("optional_enrich", "SELECT d.doc_id, lang, quality, toxic, 'doc/' || lang || '/' || CAST(d.doc_id AS VARCHAR) AS iri FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def optional_enrich(table):
    """Optional facts and a derived key."""
    return table("documents").select("doc_id", "lang").join(table("labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic", F.concat(F.lit("doc/"), "lang", F.lit("/"), c("doc_id").cast("string")).alias("iri"))


@query("semi_wanted", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_wanted(table):
    """Rows of wanted ids."""
    return table("documents").select("doc_id", "n_chars").join(table("labels").where("quality = 1"), "doc_id", "left_semi")


@query("anti_new", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_new(table):
    """Ids that only one side has."""
    return table("documents").select("doc_id").join(table("labels"), "doc_id", "left_anti")


@query(
    "life_overlap_nulls",
    """WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(1500 + c_custkey % 200 AS INTEGER) END AS b, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(1560 + c_custkey % 200 AS INTEGER) END AS d FROM customer)
       SELECT id, b, d FROM l WHERE coalesce(b, d) <= 1650 AND coalesce(d, b) >= 1600""",
)
def life_overlap_nulls(table):
    """Lives that meet a range of years; one date may be missing, not both."""
    k = c("c_custkey")
    lives = table("customer").select(k.alias("id"), F.when(k % 3 != 0, 1500 + k % 200).cast("int").alias("b"), F.when(k % 5 != 0, 1560 + k % 200).cast("int").alias("d"))
    return lives.where((F.coalesce("b", "d") <= 1650) & (F.coalesce("d", "b") >= 1600))


@query(
    "fuzzy_block_join_lev",
    """WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS n FROM part), b AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS n FROM part WHERE split_part(p_name, ' ', 2) <> ''),
       s AS (SELECT a.n AS x, b.n AS y, CASE WHEN a.n = b.n THEN 1.0 ELSE 1 - levenshtein(a.n, b.n) / CAST(greatest(length(a.n), length(b.n)) AS DOUBLE) END AS r FROM a JOIN b ON substr(a.n, 1, 1) = substr(b.n, 1, 1))
       SELECT x, y, round(r, 6) AS r, row_number() OVER (PARTITION BY x ORDER BY r DESC, y) AS k, count(*) OVER (PARTITION BY x) AS n_candidates FROM s WHERE r >= 0.4""",
)
def fuzzy_block_join_lev(table):
    """Blocked fuzzy join over the distinct names only, ranked, with the number of candidates."""
    name = lambda i, as_: table("part").select(F.split("p_name", " ").alias("w")).select(F.get(c("w"), F.lit(i)).alias(as_)).where(f"{as_} <> ''").distinct()
    s = name(0, "x").join(name(1, "y"), F.substring("x", 1, 1) == F.substring("y", 1, 1)).withColumn("r", levenshtein_ratio(c("x"), c("y"))).where("r >= 0.4")
    by = W.partitionBy("x")
    return s.select("x", "y", F.round("r", 6).alias("r"), F.row_number().over(by.orderBy(c("r").desc(), "y")).cast("long").alias("k"), F.count(F.lit(1)).over(by).alias("n_candidates"))


@query(
    "fill_anchor_join",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN event_id END AS anchor FROM events),
       f AS (SELECT event_id, user_id, max(anchor) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before, min(anchor) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM e)
       SELECT event_id, before, after, CASE WHEN before IS NULL OR after IS NULL THEN 'open' WHEN before = after THEN 'single' WHEN after - before <= 1200 THEN 'range' ELSE 'wide' END AS kind FROM f""",
)
def fill_anchor_join(table):
    """Nearest anchors before and after by id order, within a key: an as-of join by two windows."""
    by = W.partitionBy("user_id").orderBy("event_id")
    e = table("events").select("event_id", "user_id", F.when(c("event_type") == "purchase", c("event_id")).alias("anchor"))
    f = e.select("event_id", F.last("anchor", True).over(by.rowsBetween(W.unboundedPreceding, 0)).alias("before"), F.first("anchor", True).over(by.rowsBetween(0, W.unboundedFollowing)).alias("after"))
    kind = F.when(c("before").isNull() | c("after").isNull(), "open").when(c("before") == c("after"), "single").when(c("after") - c("before") <= 1200, "range").otherwise("wide")
    return f.select("event_id", "before", "after", kind.alias("kind"))


@query(
    "tier_rules",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.08 AND l_quantity >= 30 THEN 'strong' WHEN l_discount >= 0.05 AND l_quantity >= 20 THEN 'probable' WHEN l_discount >= 0.02 THEN 'possible' ELSE 'none' END AS tier FROM lineitem""",
)
def tier_rules(table):
    """Tiers of a link from two scores."""
    d, q = c("l_discount"), c("l_quantity")
    return table("lineitem").select("l_orderkey", "l_linenumber", F.when((d >= 0.08) & (q >= 30), "strong").when((d >= 0.05) & (q >= 20), "probable").when(d >= 0.02, "possible").otherwise("none").alias("tier"))


@query(
    "namesake_gate",
    """SELECT c_custkey, n FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) WHERE n <= 3 """,
)
def namesake_gate(table):
    """Names with at most three bearers."""
    return table("customer").select("c_custkey", F.count(F.lit(1)).over(W.partitionBy("c_nationkey", "c_mktsegment")).alias("n")).where("n <= 3")


@query("union_provenance", "SELECT k, string_agg(DISTINCT s, '+' ORDER BY s) AS sources FROM (SELECT o_custkey AS k, 'orders' AS s FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_acctbal > 0 UNION ALL SELECT user_id, 'events' FROM events) GROUP BY k")
def union_provenance(table):
    """Keys of several sources, with the set of sources."""
    parts = [table("orders").select(c("o_custkey").alias("k"), F.lit("orders").alias("s")), table("customer").where("c_acctbal > 0").select(c("c_custkey").alias("k"), F.lit("customer").alias("s")), table("events").select(c("user_id").alias("k"), F.lit("events").alias("s"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("s")), "+").alias("sources"))


@query("intersect_signals", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def intersect_signals(table):
    """Ids that both signals name."""
    return table("orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("k")).intersect(table("events").where("event_type = 'purchase'").select(c("user_id").alias("k")))


@query("except_unmatched", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def except_unmatched(table):
    """Ids without a match."""
    return table("customer").select(c("c_custkey").alias("k")).subtract(table("orders").where("o_totalprice > 250000").select(c("o_custkey").alias("k")))


@query("distinct_edges", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_returnflag AS kind, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2, 3")
def distinct_edges(table):
    """An edge for each pair and kind, with its first source."""
    return table("lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), c("l_returnflag").alias("kind")).agg(F.min("l_orderkey").alias("first"))


@query("list_union_ci", "SELECT p_brand, string_agg(DISTINCT lower(t), '|' ORDER BY lower(t)) AS words FROM (SELECT p_brand, unnest(string_split(p_name || ' ' || p_type, ' ')) AS t FROM part) GROUP BY p_brand")
def list_union_ci(table):
    """Union of lists without regard to case."""
    words = F.transform(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), F.lower)
    return table("part").select("p_brand", F.explode(words).alias("t")).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("t")), "|").alias("words"))
