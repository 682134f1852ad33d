"""Operator 10: near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: COORDS bins are filled in rounds. In round i every shingle is hashed to one bin with value (i, hash); a bin
keeps its smallest value, so an early round wins. After COORDS rounds, round COORDS + b sends all shingles to bin b.
So every bin is filled at last, and mostly after the first few rounds, at about n + COORDS * log(COORDS) hash
evaluations; equal coordinates estimate the Jaccard similarity with the concentration of independent draws.

Candidates: documents with the same shingle set are one class, of which the smallest doc_id stands for all. Classes that
agree on a band of coordinates meet in a bucket; rows per band are chosen so that a pair at the threshold is missed
with a chance under 1e-8. A bucket isn't turned into all its pairs at first: each document is compared with the most central
member of its buckets (first links), and only buckets whose members are then still in several components are compared
pair by pair, in blocks of BLOCK sketches, where a pair from different components counts if its sketches agree enough
(five standard deviations below the threshold). All links are confirmed on full shingle sets made from whole texts.

Shingles are compared by 64-bit hashes. Documents without words have an empty set and are linked with nothing.

Nulls: a null text is empty; each row with a null doc_id is a document of its own, numbered beyond the largest doc_id; its
component is the smallest doc_id reachable, or null without one. Repeated rows are a class; rows that share a doc_id are
one document, linked through each of their texts. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, kept_columns, picked, stored

COORDS, BANDED, BLOCK, SIGMAS = 480, 240, 2048, 5.0
CACHED = 1_000_000
_words: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted 64-bit hashes; A-Z count as a-z, words end at ASCII blanks."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    if len(_words) > CACHED:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """A row of coords 64-bit values for each set that isn't empty."""
    empty = np.uint64(2**64 - 1)
    out = np.full((len(sets), coords), empty)
    left = np.flatnonzero([len(s) > 0 for s in sets])
    seeds = mixed(np.arange(1, 2 * coords + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    x = np.concatenate([sets[i] for i in left]) if len(left) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(left)), [len(sets[i]) for i in left])
    for i in range(2 * coords):
        if not len(left):
            break
        h = mixed(x + seeds[i])
        bins = (h >> np.uint64(32)) * np.uint64(coords) >> np.uint64(32) if i < coords else np.full(len(x), i - coords, np.uint64)
        fresh = np.full(len(left) * coords, empty)
        np.minimum.at(fresh, owner * coords + bins.astype(np.int64), mixed(h) >> np.uint64(1))
        fresh = fresh.reshape(len(left), coords)
        mine = out[left]
        take = (mine == empty) & (fresh != empty)
        mine[take] = fresh[take]
        out[left] = mine
        if i < 4 or i % 8 == 0 or i >= coords:
            going = (mine == empty).any(1)
            if not going.all():
                inside = going[owner]
                x, owner = x[inside], (np.cumsum(going) - 1)[owner[inside]]
                left = left[going]
    return out


def banding(threshold: float, banded: int = BANDED, miss: float = 1e-8) -> int:
    """The most rows a band for which a pair at the threshold agrees on no band with a chance under miss."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** (banded // (rows + 1)) < miss:
        rows += 1
    return rows


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.binary()), ("sketch", pa.binary())])


def sketch_table(docs: DataFrame, k: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, digest (of the set), bands (8 bytes each), sketch (a byte a coordinate)."""
    rows = banding(threshold)
    bands = BANDED // rows

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                keys = batch.column(0).slice(at, 128)
                sets = [shingles(x, k) for x in batch.column(1).slice(at, 128).to_pylist()]
                full = sketches(sets)
                part = full[:, : bands * rows].reshape(len(sets), bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands)).copy()
                for r in range(rows):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
                low = (full & np.uint64(255)).astype(np.uint8)
                some = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([x.astype(">u8").tobytes() if ok else b"" for x, ok in zip(key, some)], pa.binary()), pa.array([x.tobytes() if ok else b"" for x, ok in zip(low, some)], pa.binary()),
                ], schema=SKETCH)

    base = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return base.mapInArrow(make, "doc_id long, n long, digest binary, bands binary, sketch binary")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Texts travel to the pairs; a text
    that many pairs need is dealt out in parts of 256 pairs."""
    texts = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    busy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).withColumn("parts", F.ceil(F.col("pairs") / 256).cast("int"))
    busy = stored(busy, "near-busy")
    first = texts.join(busy, F.col("doc_id") == F.col("a")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("a").alias("ta"), "p", F.col("text").alias("text_a"))
    spread = pairs.join(busy.select(F.col("a").alias("ba"), "parts"), F.col("a") == F.col("ba")).select("a", "b", F.pmod("part", "parts").cast("int").alias("q"))
    second = spread.join(texts, F.col("b") == F.col("doc_id")).select("a", "b", "q", F.col("text").alias("text_b"))
    both = second.join(first, (F.col("a") == F.col("ta")) & (F.col("q") == F.col("p"))).select("a", "b", "text_a", "text_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, text = None, None
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                t = batch.column(2)[i].as_py()
                if held is None or t != text:
                    held, text = shingles(t, k), t
                other = shingles(batch.column(3)[i].as_py(), k)
                least = min(len(held), len(other))
                if 100 * least < percent * max(len(held), len(other)):
                    ok.append(False)
                    continue
                same = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(least > 0 and 100 * same >= percent * (len(held) + len(other) - same))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    return both.mapInArrow(check, "a long, b long").distinct()


def agreeing(pairs: DataFrame, table: DataFrame, least: int, percent: int) -> DataFrame:
    """a, b, same (coordinates that agree) for the pairs that may reach the threshold by sketch and size."""
    one = table.select(F.col("doc_id").alias("ia"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = table.select(F.col("doc_id").alias("ib"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(one, F.col("a") == F.col("ia")).join(two, F.col("b") == F.col("ib"))
    joined = joined.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "sa", "sb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDS) for i in (2, 3))
            same = (x == y).sum(1)
            keep = pa.array(same >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(same.astype(np.int32)).filter(keep)], schema=schema)

    return joined.mapInArrow(count, "a long, b long, same int")


def block_pairs(members: DataFrame, least: int, percent: int) -> DataFrame:
    """a, b: pairs from different components of a bucket that may reach the threshold, each found in the first band it shares."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, lo, hi = (x.as_py() for x in key)
        block, ids, comp, n, band = (np.array(table[c].to_pylist()) for c in ("block", "doc", "comp", "n", "band"))
        sk = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, COORDS)
        bands = np.frombuffer(b"".join(table["bands"].to_pylist()), ">u8").reshape(len(ids), -1)
        rows, cols = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        left, right = [], []
        for i in rows:
            js = cols[(comp[cols] != comp[i]) & (100 * np.minimum(n[cols], n[i]) >= percent * np.maximum(n[cols], n[i]))]
            if lo == hi:
                js = js[ids[js] > ids[i]]
            if not len(js):
                continue
            js = js[(sk[js] == sk[i]).sum(1) >= least]
            js = js[(bands[js] == bands[i]).argmax(1) == band[i]] if len(js) else js
            left += [ids[i]] * len(js)
            right += ids[js].tolist()
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

    dealt = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "comp", "n", "band", "sketch", "bands")
    return dealt.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int | None]:
    """(doc_id, text) with numbers in place of null doc_ids, and the largest doc_id there was, if any was null."""
    base = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    if not base.where("doc_id is null").limit(1).count():
        return base, None
    largest = base.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    fresh = stored(base.where("doc_id is null").select((F.lit(largest + 1) + F.monotonically_increasing_id()).alias("doc_id"), "text"), "near-numbered")
    return base.where("doc_id is not null").unionByName(fresh), largest


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; links are pairs with 100 * intersection >= percent * union."""
    docs, largest = numbered(docs, id_col, text_col)
    id_col, text_col = "doc_id", "text"
    threshold = percent / 100
    least = math.floor(COORDS * threshold - SIGMAS * math.sqrt(COORDS * threshold * (1 - threshold)))
    bands = BANDED // banding(threshold)
    table = stored(sketch_table(docs, k, threshold, id_col, text_col), "near-sketches")
    classes = stored(table.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "near-classes")
    reps = table.where("n > 0").join(classes.where("n > 0").select(F.col("rep").alias("r_"), F.col("digest").alias("d_")), (F.col("doc_id") == F.col("r_")) & (F.col("digest") == F.col("d_")))
    reps = stored(reps.select("doc_id", "n", "bands", "sketch").dropDuplicates(["doc_id", "n", "bands"]), "near-reps")
    # Buckets: a number a band; the band's number is part of what the key hashes.
    places = F.sequence(F.lit(0), F.lit(bands - 1))
    keys = reps.select("doc_id", F.posexplode(F.transform(places, lambda i: F.conv(F.hex(F.substring("bands", i * 8 + 1, 8)), 16, -10).cast("long"))).alias("band", "key")).withColumnRenamed("doc_id", "doc")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("key", "k_")
    members = stored(keys.join(sizes, F.col("key") == F.col("k_")).select("key", "band", "doc", "size"), "near-members")
    central = members.groupBy("doc").agg(F.sum("size").alias("weight"))
    ranked = members.join(central.withColumnRenamed("doc", "c_"), F.col("doc") == F.col("c_"))
    pivots = ranked.groupBy("key").agg(F.max(F.struct("weight", -F.col("doc"))).alias("top")).select(F.col("key").alias("p_"), (-F.col("top").getField("col2")).alias("pivot"))
    stars = members.join(pivots, F.col("key") == F.col("p_")).where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    stars = stored(agreeing(stars, reps, least, percent), "near-stars")
    best = stars.groupBy("b").agg(F.max(F.struct("same", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    links = stored(confirmed(best, docs, k, percent, id_col, text_col), "near-links")
    labels = components(links)
    # What is left: buckets with members in several components.
    known = members.join(labels, F.col("doc") == F.col("node"), "left").select("key", "band", "doc", "size", F.coalesce("label", "doc").alias("comp"))
    known = stored(known, "near-known")
    split = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select(F.col("key").alias("k_"))
    rest = known.join(split, F.col("key") == F.col("k_")).drop("k_").join(reps.withColumnRenamed("doc_id", "i_"), F.col("doc") == F.col("i_"))
    more = stored(block_pairs(rest, least, percent).distinct(), "near-rest")
    if more.limit(1).count():
        links = links.unionByName(stored(confirmed(more, docs, k, percent, id_col, text_col), "near-links"))
        labels = components(links)
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("d_"), F.coalesce("label", "rep").alias("label"))
    named = stored(named, "near-named")
    joined = table.join(named, F.col("digest") == F.col("d_"))
    real = lambda x: x if largest is None else F.when(x <= largest, x)
    return joined.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("label"))).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest doc_id of each group of near-duplicates; all columns stay. Rows with a null id stay."""
    gone = near_groups(docs, k, percent, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_"))
    return kept_columns(docs, lambda flat, ref: flat.join(gone, ref(id_col) == F.col("gone_"), "left_anti"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))
