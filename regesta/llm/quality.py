"""Operator 6: quality rules with host-level verdicts [native].

Every document gets the base counts and four rules (symbols, repeated lines, shouting, word length). Per host the
share of documents that break a rule is shrunk towards an empirical beta prior, fitted to all hosts by the method of
moments: rate = (failures + a) / (documents + a + b). A host above HOST_MAX is rejected with all its documents, one
below TRUSTED may break one rule in a document, any other host none. The verdict goes back to the documents by join.
Counts are computed once, within the row (no shuffle of text), and stored; only a few numbers a document are joined.

Nulls: a null text has no words and fails the base rules; null is a host of its own. Repeated rows are judged each.
An empty table gives an empty result; with one host the prior is flat (a + b = 2). Three-word windows are compared by
64-bit hashes of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, by_place, let, located, picked, placed, stored

HOST_MAX, TRUSTED = 0.8, 0.02
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def gone(text: Column, chars: str) -> Column:
    """How many characters of text are in chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words within three-word windows that occur twice or more: windows are sorted by hash, equal neighbours found,
    and the union of their places measured from their sorted starts."""
    # An index outside 0..n-1 isn't read: when() guards each side.
    def places(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
        return let(F.sort_array(windows), covered)

    def covered(s: Column) -> Column:
        same = lambda a, j: F.when((j >= 0) & (j < F.size(s)), F.element_at(s, (j + 1).cast("int"))["h"] == a["h"]).otherwise(False)
        marked = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return let(F.sort_array(F.filter(marked, lambda x: x.isNotNull())), span)

    def span(p: Column) -> Column:
        steps = F.transform(p, lambda x, t: F.when(t + 1 < F.size(p), F.least(F.lit(3), F.element_at(p, F.when(t + 1 < F.size(p), t + 2).otherwise(1)) - x)).otherwise(3))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    return let(words, lambda w: F.when(F.size(w) >= 3, places(w)).otherwise(F.lit(0)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    place = {"file": "place_file_", "row": "place_row_"} if "place_file_" in docs.columns else {}
    base = picked(docs, doc_id=id_col, text=text_col, host=host_col, **place).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    dup = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).alias("n_lines")))
    rows = base.select(*place, "doc_id", F.col("host").cast("string").alias("host"), counts.alias("c"), dup.alias("d"), F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"), gone(text, SYMBOLS).cast("long").alias("n_symbols"), gone(text, UPPER).alias("n_upper"))
    return rows.select(*place, "doc_id", "host", "c.n_words", "word_chars", "n_symbols", "d.n_dup_lines", "c.n_repeat_words", "d.n_lines", "n_upper")


def host_verdicts(rows: DataFrame) -> DataFrame:
    """host, rate, verdict (trusted, normal, rejected) from rows (host, rules)."""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("rules") > 0, 1).otherwise(0)).alias("k"))
    p = F.col("k") / F.col("n")
    pooled = hosts.agg(F.sum("n").alias("docs"), F.sum("k").alias("fails"), F.count(F.lit(1)).alias("hosts"), F.sum(p * p * F.col("n")).alias("squares"))
    m = F.col("fails") / F.col("docs")
    spread = F.greatest(F.col("squares") / F.col("docs") - m * m, F.lit(0.0))
    noise = m * (1 - m) * F.col("hosts") / F.col("docs")
    strength = F.when((F.col("hosts") < 2) | (m <= 0) | (m >= 1), F.lit(2.0)).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(2.0), (m * (1 - m) - spread) / F.greatest(spread - noise, F.lit(1e-9)))))
    prior = pooled.select(F.when(F.col("hosts") < 2, F.lit(1.0)).otherwise(m * strength).alias("a"), strength.alias("ab"))
    rated = hosts.crossJoin(F.broadcast(prior)).select("host", ((F.col("k") + F.col("a")) / (F.col("n") + F.col("ab"))).alias("rate"))  # the prior is one row
    verdict = F.when(F.col("rate") > HOST_MAX, "rejected").when(F.col("rate") < TRUSTED, "trusted").otherwise("normal")
    return rated.withColumn("verdict", verdict)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, the counts, base_failed, rules (broken), verdict (of the host), kept."""
    rows = measured(docs, id_col, text_col, host_col)
    n = F.col("n_words")
    rules = [
        F.col("n_symbols") * 10 > n,
        F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        F.col("n_upper") * 2 > F.col("word_chars"),
        (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 20),
    ]
    rows = rows.withColumn("base_failed", (n < 50) | (F.col("n_repeat_words") * 100 > n * 50))
    rows = stored(rows.withColumn("rules", sum((F.when(x, 1).otherwise(0) for x in rules), F.lit(0))), "quality-counts")
    hosts = stored(host_verdicts(rows), "quality-hosts")
    joined = rows.join(hosts.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_")), "left")
    allowed = F.when(F.col("verdict") == "trusted", 1).otherwise(0)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("verdict") != "rejected") & (F.col("rules") <= allowed)).drop("host_", "rate")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without the rows that the rules reject; all columns stay. Every row is judged for itself, whatever its id."""
    docs = located(docs)
    names = docs.columns
    bad = stored(judged(placed(docs), id_col, text_col, host_col).where("not kept").select("file", "row"), "quality-rejected")
    return by_place(docs, bad, "left_anti").select(*[f"c{i}_" for i in range(len(names))]).toDF(*names)


COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COUNTS)


def oracle(documents: str = "documents") -> str:
    return f"""
WITH base AS (SELECT row_number() OVER () AS row_id, doc_id, source AS host, coalesce(text, '') AS text FROM {documents}),
split AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM base),
grams AS (SELECT row_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
named AS (SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
twice AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, g) AS c FROM named) WHERE c > 1),
cover AS (SELECT row_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS t(d) GROUP BY row_id),
counts AS (
  SELECT s.doc_id, s.host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM split s LEFT JOIN cover c USING (row_id)),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CAST(n_symbols * 10 > n_words AS INTEGER) + CAST(n_dup_lines * 10 > n_lines * 3 AS INTEGER) + CAST(n_upper * 2 > word_chars AS INTEGER)
         + CAST(word_chars < n_words * 2 OR word_chars > n_words * 20 AS INTEGER) AS rules
  FROM counts),
hosts AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN rules > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS k FROM ruled GROUP BY host),
pooled AS (SELECT sum(k) / sum(n) AS m, sum(n) AS docs, count(*) AS hosts, sum(k / n * k / n * n) AS squares FROM hosts),
moments AS (SELECT *, greatest(squares / docs - m * m, 0.0) AS spread, m * (1 - m) * hosts / docs AS noise FROM pooled),
prior AS (SELECT *, CASE WHEN hosts < 2 OR m <= 0 OR m >= 1 THEN 2.0 ELSE least(1e6, greatest(2.0, (m * (1 - m) - spread) / greatest(spread - noise, 1e-9))) END AS ab FROM moments),
rated AS (SELECT h.host, (h.k + CASE WHEN p.hosts < 2 THEN 1.0 ELSE p.m * p.ab END) / (h.n + p.ab) AS rate FROM hosts h, prior p)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND h.rate <= {HOST_MAX} AND rules <= CASE WHEN h.rate < {TRUSTED} THEN 1 ELSE 0 END AS kept
FROM ruled r JOIN rated h ON r.host IS NOT DISTINCT FROM h.host"""


ORACLE = oracle()
