"""Operator 2: exact deduplication by stateful streaming [native].

A feed of (digest, stable identifier, content locator) flows through a streaming aggregation whose state, one row a
digest, lives in RocksDB on the executors' disks with its change log in the shared folder. The state has no watermark
and no expiry, and goes on from call to call under a given path: it keeps the digest, the identifier that stays, the locator of its text and the count. A digest seen
twice is a hit; the full texts of all hits are then compared byte by byte, so equal digests of different texts (a
collision) stay apart.

Nulls: a null text counts as empty; a null identifier is smaller than any other. Rows equal in identifier and text
are separate rows: the one with the largest locator stays. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_place, located, picked, placed, shared_dir, stored

#: Digests that may be broadcast: 32 bytes each, 32 MB at most. More are joined by shuffle.
BROADCAST_ROWS = 1_000_000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store reserves megabytes for its logs
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_place(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return picked(placed(docs), doc_id=id_col, text=text_col, file="place_file_", row="place_row_").withColumn("text", F.coalesce("text", F.lit("")))


def stream_state(spark: SparkSession, feed: DataFrame, path: str, bytes_per_trigger: int) -> DataFrame:
    """digest, keep, n: the state after all files of path/feed have gone through. A call with the same path goes on
    where the last one stopped; files that came in the meantime meet the digests of all earlier ones."""
    out = f"{path}/state"

    def update(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    source = spark.readStream.schema(feed.schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(f"{path}/feed")
    seen = source.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    with settings(spark, STATE):
        query = seen.writeStream.outputMode("update").foreachBatch(update).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = len(system.listStatus(folder)) if system.exists(folder) else 0
    if not batches:
        return spark.createDataFrame([], seen.schema)
    state = spark.read.schema(seen.schema).parquet(f"{out}/batch=*")
    if batches == 1:
        return state
    return state.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))  # both only grow


def trigger_bytes(feed: DataFrame) -> int:
    """A sixteenth of the feed, 256 MB at least: large feeds go through the state in several batches."""
    return max(256 << 20, int(str(feed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 16)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, bytes_per_trigger: int | None = None, state_path: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, and file, row (its locator).

    With a state_path in a shared folder a call that was stopped is taken up again by the next one: the feed is written
    once, and the stream goes on at the batch that wasn't finished. docs must be the same then."""
    spark = docs.sparkSession
    base = with_place(located(docs), id_col, text_col)
    path = state_path or shared_dir(spark, "dedup")
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/feed/_SUCCESS")
    if not whole.getFileSystem(spark._jsc.hadoopConfiguration()).exists(whole):
        base.select("doc_id", "file", "row", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256")).write.mode("overwrite").parquet(f"{path}/feed")
    feed = spark.read.parquet(f"{path}/feed")
    state = stream_state(spark, feed.drop("text_sha256"), path, bytes_per_trigger or trigger_bytes(feed))
    multi = stored(state.where("n > 1"), "dedup-multi")
    # Full bytes of the hits: copies meet in the map-side aggregation, a digest's different texts stay different keys.
    keys = multi.select("digest")
    hits = base.withColumn("digest", digest(F.col("text"))).join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "digest", "left_semi")
    texts = hits.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    clashes = stored(texts.select("digest", F.lit(1).alias("one")).groupBy("digest").agg(F.sum("one").alias("texts")).where("texts > 1").select("digest"), "dedup-clashes")
    whole = ["doc_id", "file", "row", "text_sha256", "keep", "n"]
    if clashes.limit(1).count():
        apart = texts.join(clashes, "digest", "left_semi").withColumnRenamed("text", "other")
        mixed = base.withColumn("digest", digest(F.col("text"))).join(clashes, "digest", "left_semi").withColumn("text_sha256", F.sha2("text", 256))
        mixed = mixed.join(apart, (mixed.digest == apart.digest) & (mixed.text == apart.other)).select(*whole)
        clean = feed.join(clashes, "digest", "left_anti").join(multi, "digest", "left").select(*whole)
        joined = clean.unionByName(mixed)
    else:
        joined = feed.join(multi, "digest", "left").select(*whole)
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row")))).alias("kept"),
        "text_sha256",
        "file",
        "row",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another, kept row has; all columns stay."""
    docs = located(docs)
    names = docs.columns
    gone = stored(exact_dedup(docs, id_col, text_col).where("not kept").select("file", "row"), "dedup-gone")
    return by_place(docs, gone, "left_anti").select(*[f"c{i}_" for i in range(len(names))]).toDF(*names)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("file", "row")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
