"""Operator 7: toxicity by compression distance.

Two zstandard dictionaries are trained separately by the library's trainer, one on windows of toxic text, one on windows
of ordinary text, of equal size. A window of text compresses better with the dictionary it resembles. A second pair tells
words: both begin with the same ordinary passages; to that the toxic one adds all words of toxic documents that hold
letter groups hardly met in ordinary documents, the ordinary one as many bytes of the others. Every window of WIDE words
of a text is compressed with all four; the windows where the second pair's toxic dictionary saves GAIN bytes or more are
compressed again in parts of NARROW words. A logistic function, calibrated on labelled documents that no dictionary has
seen, turns the savings of both pairs into a score.

Training reads labelled rows whose crc32(doc_id as text) mod 4 is not 2. It takes at most 2 * SAMPLE documents of either
label, in the order of their hash, and reads their texts whole: those for the dictionaries come to the driver, those for
the calibration stay on the executors, which send their features. Scoring reads every text whole. Only the text enters
a score.

Nulls: a null or empty text has no window and gets the score of a document without savings. Labels that are null are
left out, as are those of documents that don't exist; a document labelled twice is toxic if one label says so. Without
labels of both kinds the score is 0 for all. Rows that share an id are scored each. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import picked, stored

SAMPLE = 1_500
LEVEL, BASE_BYTES, TRAINED_BYTES = 6, 400_000, 50_000
WIDE, NARROW, GAIN, THRESHOLD = 10, 5, 2, 0.3
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
GROUPS = (5, 6, 7, 8)


def windows(words: list[bytes], k: int) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + k]) + b" " for i in range(0, len(words), k)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def groups(word: bytes) -> set[bytes]:
    x = b" " + word + b" "
    return {x[i : i + n] for n in GROUPS for i in range(len(x) - n + 1)}


def telling_groups(toxic: list[list[bytes]], ordinary: list[list[bytes]], ratio: float = 3.0, z_least: float = 14.0) -> set[bytes]:
    """Letter groups far more frequent in toxic documents, by log ratio of document shares and by z. A table of hashed
    counts of fixed size leaves out, beforehand, groups too rare to tell, so only candidates are counted by name."""
    n, m, out = len(toxic), len(ordinary), set()
    least = max(4, 0.005 * n)
    rough = np.zeros(1 << 22, np.int32)
    for words in toxic:
        rough[np.fromiter({hash(g) & 0x3FFFFF for w in set(words) for g in groups(w)}, np.int64)] += 1
    often = set(np.flatnonzero(rough >= least).tolist())
    a: Counter = Counter()
    for words in toxic:
        a.update({g for w in set(words) for g in groups(w) if hash(g) & 0x3FFFFF in often})
    a = Counter({g: k for g, k in a.items() if k >= least})
    cached = lru_cache(20_000)(lambda w: [g for g in groups(w) if g in a])
    b: Counter = Counter()
    for words in ordinary:
        b.update({g for w in set(words) for g in cached(w)})
    for g, k in a.items():
        p = (b[g] + 1) / (m + 2)
        z = (k - n * p) / math.sqrt(n * p * (1 - p))
        if z > z_least * min(1.0, math.sqrt(n / 800)) and math.log((k + 0.5) / (n + 1)) - math.log((b[g] + 0.5) / (m + 1)) > ratio:
            out.add(g)
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """Raw dictionary content by the library's trainer."""
    try:
        return zs.train_dictionary(size + 8192, samples).as_bytes()[-size:]
    except zs.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)[-size:]


def separate(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """(toxic, ordinary), each trained on its own documents alone, of equal size."""
    samples = [[x for words in kind for x in windows(words, WIDE)] for kind in (toxic, ordinary)]
    size = max(1, min(TRAINED_BYTES, *(sum(map(len, x)) // 2 for x in samples)))
    return trained(samples[0], size), trained(samples[1], size)


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) as raw dictionary content: ordinary passages in both, then words."""
    base = trained([x for words in ordinary for x in windows(words, 160)], BASE_BYTES)
    telling = telling_groups(toxic, ordinary)
    bad, other = Counter(), Counter()
    for words in toxic:
        for w in set(words):
            (other if telling.isdisjoint(groups(w)) else bad)[w] += 1
    extra = b" " + b" ".join(w for w, _ in sorted(bad.items(), key=lambda x: (x[1], x[0]))) + b" "
    rest = sorted(other.elements())
    np.random.Generator(np.random.PCG64(7)).shuffle(rest)
    return base + extra, base + (b" " + b" ".join(rest[: len(extra)]))[: len(extra) - 1] + b" "


class Lengths:
    """Savings of a pair of word dictionaries and of a pair trained separately."""

    def __init__(self, toxic: bytes, ordinary: bytes, toxic_alone: bytes, ordinary_alone: bytes):
        make = lambda raw: zs.ZstdCompressor(level=LEVEL, dict_data=zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self.words, self.alone = (make(toxic), make(ordinary)), (make(toxic_alone), make(ordinary_alone))

    def saved(self, parts: list[bytes], pair: tuple) -> np.ndarray:
        toxic, ordinary = pair
        return np.array([len(ordinary(x)) - len(toxic(x)) for x in parts], float) if parts else np.zeros(1)

    def features(self, text: str | None) -> list[float]:
        wide = windows(words_of(text), WIDE)
        d = self.saved(wide, self.words)
        near = [p for x, s in zip(wide, d) if s >= GAIN for p in windows(x.split(), NARROW)]
        return [*shape(d, len(d)), *shape(self.saved(near, self.words), len(d)), *shape(self.saved(wide, self.alone), len(d))]


def shape(d: np.ndarray, n: int) -> list[float]:
    top = np.sort(d)[::-1]
    return [top[0], top[:3].mean(), d.sum() / n, d.std(), (d >= 3).sum() / n, (d >= 5).sum() / n, math.log1p((d >= 4).sum()), math.log1p((d >= 6).sum()), top[-1], d.mean() * math.sqrt(len(d)) / (d.std() + 0.5), (np.maximum(d - 2, 0) ** 2).sum() / n, math.log(n)]


class Model:
    """Dictionaries and calibration; small enough to travel with the task."""

    def __init__(self, *parts: bytes):
        self.parts, self.weights, self.mean, self.scale = parts, None, None, None

    def inputs(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -8, 8)
        return np.c_[z, z * z, np.ones(len(z))]

    def calibrate(self, features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> None:
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-6
        x, b = self.inputs(features), np.zeros(2 * features.shape[1] + 1)
        keep = np.r_[np.ones(len(b) - 1), 0] * ridge * len(x)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            b = b - np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-6), x.T @ (weights * (p - labels)) + keep * b)
        self.weights = b

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(features) @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """The model from at most 2 * sample documents of either label; None without both kinds."""
    marks = picked(labels, id=id_col, toxic=label_col).where("toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    counts = {r.toxic > 0: r.n for r in marks.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = [F.xxhash64("id"), F.col("id")]
    chosen = marks.where("toxic > 0").orderBy(*order).limit(2 * sample).unionByName(marks.where("toxic <= 0").orderBy(*order).limit(2 * sample))
    texts = picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # at most 4 * sample small rows
    rows = stored(texts.select("id", (F.col("toxic") > 0).alias("toxic"), "text").dropDuplicates(["id"]), "toxicity-labelled")
    marks = sorted(rows.select("id", "toxic").collect())
    if len({r.toxic for r in marks}) < 2:  # the labelled documents of a kind don't exist
        return None
    halves = {(kind, i): [r.id for r in marks if r.toxic == kind][i::2] for kind in (True, False) for i in (0, 1)}
    if not all(halves.values()):
        halves = {(kind, i): [r.id for r in marks if r.toxic == kind] for kind, i in halves}
    part = lambda i: rows.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for kind in (True, False) for x in halves[kind, i]], rows.select("id").schema)), "id")
    seen: dict[bool, list[list[bytes]]] = {True: [], False: []}
    for r in sorted(part(0).collect(), key=lambda r: r.id):
        seen[r.toxic].append(words_of(r.text))
    model = Model(*dictionaries(seen[True], seen[False]), *separate(seen[True], seen[False]))
    measured = sorted(measure(part(1), model.parts).collect(), key=lambda r: (not r.toxic, r.id))
    features = np.array([r.features for r in measured])
    y = np.array([float(r.toxic) for r in measured])
    share = counts[True] / (counts[True] + counts[False])
    model.calibrate(features, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return model


def measure(rows: DataFrame, parts: tuple[bytes, ...]) -> DataFrame:
    """id, toxic, features of labelled texts (id, toxic, text), worked out on the executors."""
    types = T.StructType([rows.schema["id"], rows.schema["toxic"], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(*parts)
        for batch in batches:
            got = [lengths.features(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.float64()))], names=["id", "toxic", "features"])

    return rows.select("id", "toxic", "text").repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(work, types)


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row of docs."""
    base = picked(docs, doc_id=id_col, text=text_col)
    if model is None:
        return base.select("doc_id", F.lit(0.0).alias("score"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(*model.parts)
        for batch in batches:
            if batch.num_rows:
                got = model.score(np.array([lengths.features(x) for x in batch.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], schema=schema)

    return base.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
