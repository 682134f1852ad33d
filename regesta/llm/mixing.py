"""Operator 3: mixing sources to target weights by capped water-filling [native].

Targets: every source gets the smaller of its cap (max_epochs times its words) and level times its weight; the level
is the one at which the targets sum to the wanted size. That is where repeated resharing of the excess ends, and it
comes from one sort of the sources (one row a source) by cap / weight.

Repetitions: with r = target / source_size a document is taken floor(r) or ceil(r) times. The documents of a source
are ordered by size, then by a seeded hash; the k-th (from 0) gets floor(r(k+1)+u) - floor(rk+u) copies, u a seeded
offset of the source. Because sizes only rise along that order, the words taken miss the target by no more than the
source's largest document; of OFFSETS seeded offsets the one that comes nearest to the target is used. Ranks come from counts in three steps (sizes of a source, 4,096 hash buckets of a size,
rows of a bucket), so no task holds a source or a size; a source has at most sqrt(2 * words) different sizes.

Nulls: a null text or one without words has size 0 and is taken 0 times over; null is a source of its own, last in
order. Rows without an id are ordered by a hash of their text. Rows with equal ids and sizes are separate rows whose order doesn't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, by_place, located, picked, placed, stored

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
OFFSETS = 16


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """source, source_size, target, u from rows (source, size)."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = total.withColumn("at", F.row_number().over(order)).select(
        "source", "source_size", "at", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("at") - 1) % len(weights) + 1).cast("int")).alias("weight")
    )
    listed = listed.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    full, rising = W.partitionBy(F.lit(1)), W.orderBy(F.col("cap") / F.col("weight"), "at")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    filled = listed.select(
        "*",
        F.row_number().over(rising).alias("k"),
        (F.sum("source_size").over(full) * F.lit(share)).alias("wanted"),
        F.sum("weight").over(full).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    ).withColumn("level", (F.col("wanted") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    filled = filled.withColumn("first", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("k", "level"))).over(full))
    target = F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("cap")).otherwise(F.col("first.level") * F.col("weight"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return filled.select("source", "source_size", target.alias("target"), u.alias("u"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, copies, taken (copies * size)."""
    place = {"file": "place_file_", "row": "place_row_"} if "place_file_" in docs.columns else {}
    base = picked(docs, doc_id=id_col, text=text_col, source=source_col, **place)
    mark = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce("text", F.lit("")))))
    sized = stored(base.select(*place, "doc_id", mark.alias("mark"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    hashed = sized.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "mark"))).withColumn("b", F.substring("h", 1, 3))
    keys = ["source", "size", "b"]
    buckets = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    within = W.partitionBy("source", "size").orderBy("b")
    buckets = stored(buckets.select(*keys, "n", F.coalesce(F.sum("n").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("in_size")), "mix-buckets")
    lengths = buckets.groupBy("source", "size").agg(F.sum("n").alias("n"))
    lengths = lengths.select("source", "size", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("in_source"))
    goals = targets(sized, weights, share, epochs, seed)
    goals = goals.withColumnRenamed("source", "goal_source")
    starts = lengths.join(goals, lengths.source.eqNullSafe(goals.goal_source)).select(F.col("source").alias("s_source"), F.col("size").alias("s_size"), "in_source", "source_size", "target", "u")
    starts = buckets.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")))
    starts = stored(starts.select("s_source", "s_size", F.col("b").alias("s_b"), "source_size", "target", "u", (F.col("in_source") + F.col("in_size")).alias("start")), "mix-starts")
    ranked = hashed.withColumn("in_bucket", F.row_number().over(W.partitionBy(*keys).orderBy("h", "doc_id", *place)) - 1)
    joined = ranked.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("b") == F.col("s_b")))
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = stored(joined.select(*place, "doc_id", "source", "size", "source_size", "target", "u", (F.col("start") + F.col("in_bucket")).cast("double").alias("k"), r.alias("r")), "mix-ranks")
    sums = ranked.groupBy("source").agg(F.first("target").alias("goal"), *[F.sum(copies_at(offset(j)) * F.col("size")).alias(f"s{j}") for j in range(OFFSETS)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{j}") - F.col("goal")).alias("miss"), F.lit(j).alias("j")) for j in range(OFFSETS)]))["j"]
    chosen = stored(sums.select(F.col("source").alias("c_source"), nearest.alias("j")), "mix-offsets")
    out = ranked.join(chosen, F.col("source").eqNullSafe(F.col("c_source"))).withColumn("copies", copies_at(offset(F.col("j"))).cast("long"))
    return out.select(*place, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def offset(j) -> Column:
    u = F.col("u") + (F.lit(float(j)) if isinstance(j, int) else j.cast("double")) / F.lit(float(OFFSETS))
    return u - F.floor(u).cast("double")


def copies_at(u: Column) -> Column:
    return F.floor(F.col("r") * (F.col("k") + 1.0) + u) - F.floor(F.col("r") * F.col("k") + u)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with every row as often as the mix takes it; all columns stay. Rows are taken each for itself, whatever
    their ids."""
    docs = located(docs)
    names = docs.columns
    takes = stored(mix(placed(docs), id_col, text_col, source_col, **how).where("copies > 0").select("file", "row", "copies"), "mix-takes")
    joined = by_place(docs, takes, "inner").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select(*[f"c{i}_" for i in range(len(names))]).toDF(*names)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def oracle(documents: str = "documents") -> str:
    """DuckDB: doc_id, source, size, source_size, target, copies, taken."""
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '#' || md5(coalesce(text, ''))) AS mark, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM {documents}),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
listed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos FROM total),
weighed AS (SELECT *, CAST([3.0, 1.0, 2.0][1 + CAST((pos - 1) % 3 AS INTEGER)] AS DOUBLE) AS weight, source_size * CAST(2.0 AS DOUBLE) AS cap FROM listed),
filled AS (
  SELECT *, row_number() OVER w AS k,
         (SELECT CAST(sum(source_size) AS DOUBLE) * CAST(1.5 AS DOUBLE) FROM weighed) AS wanted, (SELECT sum(weight) FROM weighed) AS all_weight,
         coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cap_before,
         coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS weight_before
  FROM weighed WINDOW w AS (ORDER BY cap / weight, pos)),
leveled AS (SELECT *, (wanted - cap_before) / (all_weight - weight_before) AS level FROM filled),
first_ok AS (SELECT k, level FROM leveled WHERE level * weight <= cap ORDER BY k LIMIT 1),
goals AS (
  SELECT l.source, l.source_size, CASE WHEN f.k IS NULL OR l.k < f.k THEN l.cap ELSE f.level * l.weight END AS target,
         CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(l.source, chr(0))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM leveled l LEFT JOIN first_ok f ON true),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY size, md5('{SEED}:' || mark), doc_id) - 1 AS DOUBLE) AS k FROM sized),
rated AS (SELECT r.*, g.source_size, g.target, g.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS r
          FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source),
tried AS (SELECT *, CAST(floor(r * (k + 1.0) + v) - floor(r * k + v) AS BIGINT) AS copies
          FROM (SELECT *, CAST(u + j / CAST({OFFSETS}.0 AS DOUBLE) AS DOUBLE) - floor(CAST(u + j / CAST({OFFSETS}.0 AS DOUBLE) AS DOUBLE)) AS v FROM rated, (SELECT CAST(unnest(range({OFFSETS})) AS DOUBLE) AS j))),
missed AS (SELECT source, j, abs(CAST(sum(copies * size) AS DOUBLE) - min(target)) AS miss FROM tried GROUP BY source, j),
chosen AS (SELECT source, j FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss, j) AS place FROM missed) WHERE place = 1)
SELECT t.doc_id, t.source, t.size, t.source_size, t.target, t.copies, t.copies * t.size AS taken
FROM tried t JOIN chosen c ON t.source IS NOT DISTINCT FROM c.source AND t.j = c.j"""


ORACLE = f"SELECT doc_id, size, source_size, target, taken FROM ({oracle()})"
