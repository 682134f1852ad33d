"""Full-text search: an inverted index as a table, BM25, boolean and prefix queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import saved

K1, B = 1.2, 0.75


def terms_of(text: str) -> Column:
    """The terms of a text in order: lower-case runs of Latin letters and digits."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^a-z0-9à-ÿ]+"), "")


def token_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, term, tf, dl (tokens of the document): terms are lower-case runs of Latin letters and digits."""
    terms = F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9à-ÿ]+"), lambda x: x != "")
    split = docs.select(F.col(key).alias("id"), terms.alias("terms")).withColumn("dl", F.size("terms"))
    return split.select("id", "dl", F.explode("terms").alias("term")).groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def asked_index(docs: DataFrame, key: str, text: str, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """The token index for some terms, and id, dl of the documents with any term: from one pass over the texts, which are
    counted in their rows."""
    split = docs.select(F.col(key).alias("id"), terms_of(text).alias("terms")).where(F.size("terms") > 0)
    tf = lambda t: F.size("terms") - F.size(F.array_remove("terms", t))
    hits = F.array(*[F.struct(F.lit(t).alias("term"), tf(t).cast("long").alias("tf")) for t in sorted(set(terms))])
    rows = saved(split.select("id", F.size("terms").alias("dl"), hits.alias("hits")))
    found = rows.select("id", "dl", F.inline("hits")).where("tf > 0")
    return found.groupBy("id", "term", "dl").agg(F.sum("tf").alias("tf")), rows.select("id", "dl")


def bm25(index: DataFrame, terms: list[str], lengths: DataFrame | None = None) -> DataFrame:
    """id, score of documents with all terms. lengths: id, dl of the documents with a term, if known apart; then the
    index is only read for the terms asked for."""
    docs = (index.select("id", "dl").distinct() if lengths is None else lengths).agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("mean"))  # one row
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # at most a row a query term
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(docs))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    found = scored.groupBy("id").agg(F.sum(part).alias("score"), F.countDistinct("term").alias("n"))
    return found.where(F.col("n") == len(set(terms))).drop("n")


def boolean(index: DataFrame, all_of: list[str], none_of: list[str], any_of: list[str] | None = None) -> DataFrame:
    """ids with every term of all_of, some term of any_of and none of none_of: one aggregation over the terms asked for."""
    asked = [*all_of, *none_of, *(any_of or [])]
    hit = lambda terms: F.count_if(F.col("term").isin(terms)) if terms else F.lit(0)
    found = index.where(F.col("term").isin(asked)).groupBy("id").agg(hit(all_of).alias("a"), hit(none_of).alias("n"), hit(any_of or []).alias("o"))
    wanted = (F.col("a") == len(set(all_of))) & (F.col("n") == 0)
    return found.where(wanted & (F.col("o") > 0) if any_of else wanted).select("id")


def prefix_fallback(index: DataFrame, term: str) -> DataFrame:
    """ids with the term, or, if there is none, with a term that begins with it."""
    hits = index.where(F.col("term").startswith(term)).groupBy("id").agg(F.bool_or(F.col("term") == term).alias("exact"))
    some = hits.where("exact").limit(1).select(F.lit(True).alias("some"))  # a row at most
    return hits.join(F.broadcast(some), how="left").where(F.col("exact") | F.col("some").isNull()).select("id")
