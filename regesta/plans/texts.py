"""Queries through files and over likeness of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similar
from ..operators import graph, resolve
from ..sources import files
from .records import MENTIONS, mentions
from .registry import query

c, lit = F.col, F.lit


def spark_of(df):
    return df.sparkSession


@query("csv_scan", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_scan(table):
    """A table written as CSV, with two more in the same pass, and read again."""
    t = table("customer").select("c_custkey", "c_name", "c_mktsegment")
    path = graph.folder(spark_of(t), "csv")
    files.write_outputs(path, customer=t, nation=table("nation"), region=table("region"))
    return files.read_csv(spark_of(t), f"{path}/customer", "c_custkey long, c_name string, c_mktsegment string")


@query("json_lines_first", f"SELECT key, min(id) AS id, arg_min(prio, id) AS prio FROM {MENTIONS} GROUP BY key")
def json_lines_first(table):
    """Compressed JSON lines, the first line of a key wins."""
    t = mentions(table).select("key", "id", "prio")
    path = graph.folder(spark_of(t), "json")
    t.write.json(path, compression="gzip")
    return files.read_json_lines(spark_of(t), path, "key long, id long, prio string", "key", "id").select("key", "id", "prio")


@query("preview_rows", "SELECT count(*) AS n, least(200, count(*)) AS shown FROM orders")
def preview_rows(table):
    """Parquet with a preview of 200 rows."""
    t = table("orders")
    path = graph.folder(spark_of(t), "preview")
    files.write_with_preview(t, path)
    n = F.count(lit(1))
    shown = spark_of(t).read.csv(f"{path}/preview", header=True).agg(n.alias("shown"))  # one row
    return spark_of(t).read.parquet(f"{path}/table").agg(n.alias("n")).crossJoin(shown)


XML = """format_string('<document id="%d"><metadata><year>%d</year><dossier_id>%d</dossier_id><source>s</source></metadata><text>t</text><spans><span id="a" start="0" end="1" element="reference" class="per"><text>x</text><span id="h" start="0" end="1" element="head" class=""><text>%s</text></span></span><span id="b" start="2" end="3" element="reference" class="per"><text>er</text></span></spans><relations><role role="buyer" ref="a"/><role role="%s" ref="a"/><role role="buyer" ref="a"/></relations></document>', id, y, key, prio, status)"""


@query("annotated_documents", f"SELECT CAST(id AS VARCHAR) AS id, y AS year, CAST(key AS VARCHAR) AS dossier, 'a' AS span_id, prio AS name, 'buyer|' || status AS roles FROM {MENTIONS}")
def annotated_documents(table):
    """Annotated XML documents read for their persons: names, roles by span, metadata; pronouns give no row."""
    t = mentions(table)
    path = graph.folder(spark_of(t), "xml")
    docs = t.select(F.floor(c("id") / 20_000).alias("file"), F.expr(XML).alias("doc")).groupBy("file").agg(F.concat(lit("<corpus>"), F.concat_ws("", F.collect_list("doc")), lit("</corpus>")).alias("value"))  # some 10 MB a file, which the parser reads in one task: it takes one root a file
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.person_rows(files.read_documents(spark_of(t), path))


CODES = "CASE WHEN x IN ('a','e','i','j','o','u','y') THEN '0' WHEN x = 'b' THEN '1' WHEN x = 'p' THEN CASE WHEN a = 'h' THEN '3' ELSE '1' END WHEN x IN ('d','t') THEN CASE WHEN a IN ('c','s','z') THEN '8' ELSE '2' END WHEN x IN ('f','v','w') THEN '3' WHEN x IN ('g','k','q') THEN '4' WHEN x = 'c' THEN CASE WHEN (i = 1 AND a IN ('a','h','k','l','o','q','r','u','x')) OR (i > 1 AND b NOT IN ('s','z') AND a IN ('a','h','k','o','q','u','x')) THEN '4' ELSE '8' END WHEN x = 'x' THEN CASE WHEN b IN ('c','k','q') THEN '8' ELSE '48' END WHEN x = 'l' THEN '5' WHEN x IN ('m','n') THEN '6' WHEN x = 'r' THEN '7' WHEN x IN ('s','z') THEN '8' ELSE '' END"


@query("sound_codes", f"WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(strip_accents(lower(text)), '[^a-z ]', '', 'g'), ' ')) AS w FROM benchmark), l AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM w WHERE w <> ''), d AS (SELECT w, i, {CODES} AS d FROM (SELECT w, i, substr(w, i, 1) AS x, CASE WHEN i < length(w) THEN substr(w, i + 1, 1) ELSE '~' END AS a, CASE WHEN i > 1 THEN substr(w, i - 1, 1) ELSE '~' END AS b FROM l)), s AS (SELECT w, string_agg(d, '' ORDER BY i) AS s FROM d GROUP BY w), e AS (SELECT w, s, unnest(range(1, length(s) + 1)) AS i FROM s) SELECT w AS word, string_agg(CASE WHEN (i = 1 OR substr(s, i, 1) <> substr(s, i - 1, 1)) AND (i = 1 OR substr(s, i, 1) <> '0') THEN substr(s, i, 1) ELSE '' END, '' ORDER BY i) AS code FROM e GROUP BY w")
def sound_codes(table):
    """Cologne codes of all words."""
    words = F.split(F.regexp_replace(F.translate(F.lower("text"), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"), "[^a-z ]", ""), " ")
    t = table("benchmark").select(F.explode(words).alias("word")).where("word <> ''").distinct()
    return t.select("word", similar.sound_code(c("word")).alias("code"))


@query("name_ratios")
def name_ratios(table):
    """Likeness of part names of a brand and first letter, by matching blocks."""
    t = table("part").select("p_brand", "p_name").distinct().withColumn("first", F.substring("p_name", 1, 1))
    pairs = t.join(t.withColumnRenamed("p_name", "other"), ["p_brand", "first"]).where("p_name < other")
    return pairs.select("p_brand", "p_name", "other", F.round(similar.ratio("p_name", "other"), 6).alias("ratio")).where("ratio >= 0.6")


@query("years_align", f"WITH s AS (SELECT key, min(y) AS lo, max(y) AS hi FROM {MENTIONS} GROUP BY key) SELECT a.key, CASE WHEN a.key % 5 = 0 THEN NULL ELSE a.lo <= b.hi + 2 AND b.lo <= a.hi + 2 END AS ok FROM s a JOIN s b ON b.key = a.key + 1")
def years_align(table):
    """Whether the spans of neighbours lie near, unknown where one is."""
    s = mentions(table).groupBy("key").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    b = s.select((c("key") - 1).alias("key"), c("lo").alias("b0"), c("hi").alias("b1"))
    return s.join(b, "key").select("key", similar.years_align(F.when(c("key") % 5 != 0, c("lo")), c("hi"), c("b0"), c("b1"), 2).alias("ok"))


@query("dossier_names")
def dossier_names(table):
    """Names of a dossier merged into the only fuller one."""
    part = table("part").select("p_partkey", "p_name")
    rows = table("lineitem").join(part, c("l_partkey") == c("p_partkey")).select(c("l_orderkey").alias("dossier"), F.when(c("l_linenumber") % 2 == 0, F.split_part("p_name", lit(" "), lit(1))).otherwise(c("p_name")).alias("name"), F.year("l_shipdate").alias("year"))
    return resolve.merged_names(rows)


@query("person_runs")
def person_runs(table):
    """Runs of a customer's days, bare mentions attached to the nearest full one."""
    t = table("orders").select(c("o_custkey").alias("key"), c("o_orderkey").alias("id"), F.datediff("o_orderdate", lit("1990-01-01")).alias("year"), (c("o_orderstatus") == "P").alias("bare"))
    return resolve.attached_runs(t, ["key"], 900, 60)


@query("persons_across")
def persons_across(table):
    """Customers' years by segment, merged across within a life."""
    t = mentions(table).groupBy("prio", c("key").alias("id")).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min(F.when(c("status") == "P", c("y"))).alias("dead"), F.collect_set(F.when(c("status") != "P", c("y"))).alias("living"))
    return resolve.across_dossiers(t.withColumn("key", F.concat_ws("-", "prio", (c("id") % 200).cast("string"))).drop("prio"), 5)
