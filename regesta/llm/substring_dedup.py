"""Operator 5: repeated passages by content-defined chunking with a gear rolling hash.

A 32-bit gear hash runs over the bytes of a text; its value at the start of a word depends on the last 32 bytes alone.
A chunk begins where that value is smaller than at the REACH word starts before and after it (ties: the earlier one).
So chunk borders depend on nearby text only: an insertion moves the borders around it and no others, and the same
passage is cut alike wherever it stands, but for its ends. Chunks are 2 * REACH + 1 words long on average. They are
compared by a 128-bit digest over all documents; runs of neighbouring chunks that other documents have as well, of
MIN_WORDS words or more, are the repeated passages. The first holder (smallest doc_id) of each chunk keeps it.

A run of more than LONG bytes without a blank is cut by content too: pieces begin at the characters before which the
hash begins with three zero bits, LETTERS bytes apart on average, and count as a word for each LETTERS bytes. So the same passage in
two such runs is cut alike wherever it stands. Counts come from a map-side aggregation and the way back is a join that
Spark can split by key, so a passage that a third of all documents share puts no load on one task.

without_repeats() takes the passages out of all texts but the first holder's.

Nulls: a null or empty text has no chunks; a null doc_id is a document of its own for each row and is reported as null.
Rows that share a doc_id count as one document for what is repeated, but as holders each. Repeats within one document
are not reported. Other columns are ignored, and kept by without_repeats(). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import picked, stored

REACH, MIN_WORDS, LONG, LETTERS = 4, 16, 256, 8
PIECE = re.compile(rb"[^\x20\x09-\x0D]+")
GEAR = np.random.Generator(np.random.PCG64(20240101)).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
PAD = 32


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the rolling hash over it and the 31 bytes before: sum of GEAR[b] << age, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    return h


def cuts(values: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places where values is the smallest of reach neighbours on either side; 0 is always one."""
    n = len(values)
    low = np.ones(n, bool)
    for d in range(1, reach + 1):
        low[d:] &= values[d:] < values[:-d]
        low[:d] = False
        low[:-d] &= values[:-d] <= values[d:]
        low[n - d :] = False
    low[0] = True
    return np.flatnonzero(low)


def pieces(raw: bytes, hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, words) of the words of a text, long runs in pieces. hashes: at PAD + i what ends at byte i."""
    out = []
    for m in PIECE.finditer(raw):
        a, b = m.span()
        if b - a <= LONG:
            out.append((a, b, 1))
            continue
        inner = np.frombuffer(raw, np.uint8)[a + 1 : b]
        edges = [a, *(np.flatnonzero((hashes[PAD + a : PAD + b - 1] >> np.uint32(29) == 0) & (inner & 0xC0 != 0x80)) + a + 1).tolist(), b]
        out += [(x, y, max(1, (y - x) // LETTERS)) for x, y in zip(edges, edges[1:])]
    return out


def chunks(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each chunk, in bytes of the text's UTF-8."""
    raw = text.encode()
    hashes = gear_hashes(np.frombuffer(b"\0" * PAD + raw, np.uint8))
    spans = pieces(raw, hashes)
    if not spans:
        return []
    starts, words = np.array([x[0] for x in spans]), np.cumsum([0, *(x[2] for x in spans)])
    first = cuts(hashes[starts + PAD - 1])  # what stands before the word
    edges = [*first.tolist(), len(spans)]
    out = []
    for a, b in zip(edges, edges[1:]):
        x, y = spans[a][0], spans[b - 1][1]
        out.append((x, y, int(words[b] - words[a]), hashlib.blake2b(raw[x:y], digest_size=16).digest()))
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("new", pa.int32()), ("digest", pa.binary())])


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, at, start, end (bytes), words, new (1 where the text has the chunk first), digest: a row for each chunk.
    row is the doc_id, or a number below 0 for each null doc_id."""
    base = picked(docs, doc_id=id_col, text=text_col).where("text is not null")
    base = base.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), -1 - F.monotonically_increasing_id()).alias("row"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids, rows, digests, nums = [], [], [], []
                for doc, row, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    got = chunks(text)
                    ids += [doc] * len(got)
                    rows += [row] * len(got)
                    digests += [x[3] for x in got]
                    met = {x[3]: i for i, x in reversed(list(enumerate(got)))}
                    nums += [(i, *x[:3], int(met[x[3]] == i)) for i, x in enumerate(got)]
                cols = np.array(nums, np.int32).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), *(pa.array(cols[:, i]) for i in range(5)), pa.array(digests, pa.binary())], schema=SCHEMA)

    return base.mapInArrow(cut, "doc_id long, row long, at int, start int, end int, words int, new int, digest binary")


def shared_chunks(table: DataFrame) -> DataFrame:
    """The rows of a chunk table whose chunk several documents have, with first, first_doc (the first holder) and n
    (texts that have it)."""
    shared = table.groupBy("digest").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.min_by("doc_id", "row").alias("first_doc"), F.sum("new").alias("n"))
    shared = stored(shared.where("first <> last").select(F.col("digest").alias("d_"), "first", "first_doc", "n"), "chunks-shared")
    return table.join(shared, F.col("digest") == F.col("d_")).drop("d_")


def in_runs(hits: DataFrame) -> DataFrame:
    """hits with run: neighbouring chunks of a text have the same one."""
    by = W.partitionBy("row").orderBy("at")
    return hits.dropDuplicates(["row", "at", "start", "end", "first"]).withColumn("run", F.col("at") - F.dense_rank().over(by))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each repeated passage of a document: doc_id, start_byte, end_byte, n_words, kept_words (of chunks that
    this document is the first to have), n_holders (most texts that share a chunk), first_ids (first holders with an id)."""
    hits = shared_chunks(stored(chunk_table(docs, id_col, text_col), "chunks")).select("doc_id", "row", "at", "start", "end", "words", "first", "first_doc", "n")
    spans = in_runs(hits).groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").cast("long").alias("start_byte"),
        F.max("end").cast("long").alias("end_byte"),
        F.sum("words").alias("n_words"),
        F.sum(F.when(F.col("first") == F.col("row"), F.col("words")).otherwise(0)).alias("kept_words"),
        F.max("n").alias("n_holders"),
        F.sort_array(F.collect_set("first_doc")).alias("first_ids"),
    )
    return spans.where(F.col("n_words") >= min_words).drop("row", "run")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the passages taken out of their texts that an earlier holder has; all columns stay. A passage is a run
    of at least min_words words in chunks first held by others; the blanks around it stay."""
    names = docs.columns
    held = stored(docs.toDF(*[f"c{i}_" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()), "chunks-docs")
    key, text = f"c{names.index(id_col)}_", f"c{names.index(text_col)}_"
    # The first holder is the one of smallest doc_id, rows without one come last.
    table = stored(chunk_table(held.select(F.col("row").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text"), "chunks")
    owner = table.join(held.select("row", F.struct(F.col(key).isNull().alias("none"), F.col(key).cast("long").alias("id"), F.col("row").alias("r")).alias("rank")), "row")
    first = owner.groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d_"), F.col("first.r").alias("first"))
    hits = table.join(first, F.col("digest") == F.col("d_")).where(F.col("first") != F.col("row")).select("row", "at", "start", "end", "words", "first")
    spans = in_runs(hits).groupBy("row", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.sum("words").alias("w")).where(F.col("w") >= min_words)
    spans = spans.groupBy(F.col("row").alias("r_")).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    raw = F.encode(text, "utf-8")
    ends = F.concat(F.array(F.lit(0)), F.col("spans.b"))
    starts = F.concat(F.col("spans.a"), F.array(F.octet_length(raw)))
    kept = F.decode(F.unhex(F.array_join(F.zip_with(ends, starts, lambda a, b: F.hex(F.substring(raw, a + 1, b - a))), "")), "utf-8")
    joined = held.join(spans, F.col("row") == F.col("r_"), "left").withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(kept))
    return joined.select(*[f"c{i}_" for i in range(len(names))]).toDF(*names)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
