"""Operator 1: token ids in binary shards behind a minimal perfect hash index.

Documents are dealt to ranges of doc_id, encoded, and written in ascending order to shard files:

    ids       n_ids * 2 or 4 bytes, little-endian, every document ended by the end id
    offsets   (n_docs + 1) * 8 bytes, in ids from the start of the shard
    keys      n_docs * 8 bytes, the doc_ids in order, and n_docs bytes, 1 where the key is null
    slots     n_keys * 8 bytes: by slot of the hash, the first document of the key
    prints    n_keys * 4 bytes: by slot, the fingerprint of the key
    levels    the bit arrays of the hash; rest: keys that no level took (none in practice)
    footer    JSON with the sizes, its length in 8 bytes, and the magic

The hash is built in levels: keys alone in their place of a bit array are settled, the others go to the next array;
the slot of a key is the number of set bits before its own. A look-up reads the levels' bit (1.6 tries on average) and
checks the stored fingerprint, in constant time whatever the size of the shard. Shards roll at SHARD_IDS ids and
are listed, with key range and counts, in a manifest; starts over all documents come from the manifest's counts.

Nulls: a null text is empty (the end id alone); null doc_ids come first. Rows that share a doc_id follow each other,
ordered by text, and may run on into the next shard; the index gives the first one. An empty table gives no shard.
Other columns are ignored. Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files
from .common import picked, shared_dir, stored, tasks_for

MAGIC = b"REGIDS01"
SHARD_IDS, CACHED, BATCH_BYTES, TASK_BYTES = 8 << 20, 900_000, 32 << 20, 256 << 20


# ---- encoding ------------------------------------------------------------------------------------------------------
#: Written before each run of blanks, and between a Latin letter and a digit or sign after it (but an apostrophe), to
#: cut there; texts that hold it already aren't cut.
CUT = "\x01"
EDGES = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-&(-@\[-`{-~])|([\s\x0b\x{85}\pZ]+)"
#: What byte-level pre-tokens are, and the characters whose classes all versions of Unicode in use agree on.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KNOWN = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u024f\u0400-\u0481\u048a-\u04ff]*")


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """ids of texts as bytes. With a byte-level vocabulary a text is cut before its runs of blanks and after its letters,
    where no pre-token reaches across. Each different piece of a batch is looked up in a bounded cache or put together from its
    pre-tokens, which the tokenizers library's model encodes once each; the ids of the texts are then gathered by
    numpy. Pieces with rare characters, and all texts of other vocabularies, go to the library as they are."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.inner = tokenizers.Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.dtype = np.dtype(dtype)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.signs = byte_signs()
        parts = json.loads(self.inner.to_str())
        before = parts["pre_tokenizer"] or {}
        self.cuts = (
            before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")
            and parts["normalizer"] is None and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout")
            and all(x["special"] for x in parts["added_tokens"])
        )
        self.model = self.inner.model

    def pieces(self, texts: pa.Array) -> pa.ListArray:
        if not self.cuts:
            return pc.split_pattern(texts, CUT)
        whole = pc.match_substring(texts, CUT)
        return pc.split_pattern(pc.if_else(whole, texts, pc.replace_substring_regex(texts, EDGES, r"\1" + CUT + r"\2\3")), CUT)

    def as_bytes(self, ids: list[list[int]]) -> list[bytes]:
        raw = np.fromiter(chain.from_iterable(ids), self.dtype).tobytes()
        ends = (np.cumsum([0, *map(len, ids)]) * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def learn(self, new: list[str]) -> None:
        """Puts new pieces, and their pre-tokens, into the cache."""
        cache, one, signs = self.cache, self.model.tokenize, self.signs
        for i in range(0, len(new), 8192):  # few lists alive at a time
            part = new[i : i + 8192]
            plain = [x for x in part if KNOWN.fullmatch(x)] if self.cuts else []
            if len(plain) < len(part):
                rest = list(set(part).difference(plain))
                cache.update(zip(rest, self.as_bytes([e.ids for e in self.inner.encode_batch_fast(rest, add_special_tokens=False)])))
            alone = [x for x in plain if x[1:].isalpha() and (x[0] == " " or x[0].isalpha())]  # a blank and letters
            split = [(x, PRETOKEN.findall(x)) for x in set(plain).difference(alone)]
            lacking = [t for t in {*alone, *chain.from_iterable(ts for _, ts in split)} if t not in cache]
            cache.update(zip(lacking, self.as_bytes([[x.id for x in one(t.encode().decode("latin-1").translate(signs))] for t in lacking])))
            cache.update([(x, b"".join([cache[t] for t in ts])) for x, ts in split])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """texts: an array of strings without nulls."""
        if not len(texts):
            return []
        cut = self.pieces(texts)
        if pc.any(held := pc.match_substring(texts, CUT)).as_py():  # such texts are pieces as a whole
            at = held.to_pylist()
            cut = pa.array([[t.as_py()] if ok else x for x, t, ok in zip(cut.to_pylist(), texts, at)], pa.list_(pa.string()))
        coded = cut.flatten().dictionary_encode()
        need = coded.dictionary.to_pylist()
        if len(self.cache) + len(need) > CACHED:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        new = [x for x in need if x not in cache]
        if older:
            cache.update((x, older[x]) for x in new if x in older)
            new = [x for x in new if x not in cache]
        self.learn(new)
        known = list(map(cache.__getitem__, need))
        size = self.dtype.itemsize
        flat = np.frombuffer(b"".join(known), self.dtype)
        lengths = np.fromiter(map(len, known), np.int32, len(known)) // size
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        words = coded.indices.to_numpy()
        counts = lengths[words]
        ends = np.cumsum(counts, dtype=np.int64)
        at = np.repeat((starts[words] - (ends - counts)).astype(np.int32), counts)  # a batch has fewer than 2**31 ids: bytes bound them
        at += np.arange(ends[-1], dtype=np.int32)
        out = flat[at].tobytes()
        edges = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()] * size
        return [out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str) -> Encoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]


# ---- minimal perfect hash ------------------------------------------------------------------------------------------
def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, np.sort(rest)
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.concatenate([[0], np.cumsum(x)]) for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < 40:
            size = max(8, 2 * len(left))
            place = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[place]]
        return cls(levels, left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; -1, or any slot, for keys that weren't there (the fingerprint tells)."""
        out = np.full(len(keys), -1, np.int64)
        for k, bits in enumerate(self.levels):
            open_ = np.flatnonzero(out < 0)
            place = (mixed(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[open_[hit]] = self.before[k] + self.ranks[k][place[hit]]
        if len(self.rest) and (out < 0).any():
            open_ = np.flatnonzero(out < 0)
            at = np.searchsorted(self.rest, keys[open_])
            hit = self.rest[np.minimum(at, len(self.rest) - 1)] == keys[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out


def prints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


# ---- shards --------------------------------------------------------------------------------------------------------
class ShardWriter:
    def __init__(self, folder: str, dtype: str):
        self.folder, self.dtype, self.out = folder, np.dtype(dtype), None

    def add(self, key: int | None, ids: bytes) -> None:
        if self.out is None:
            (self.out, self.name), self.keys, self.ends = files.create(self.folder, "shard"), [], [0]
        self.out.write(ids)
        self.keys.append(key)
        self.ends.append(self.ends[-1] + len(ids) // self.dtype.itemsize)

    @property
    def n_ids(self) -> int:
        return self.ends[-1] if self.out is not None else 0

    def close(self) -> dict | None:
        if self.out is None:
            return None
        null = np.array([k is None for k in self.keys])
        keys = np.array([0 if k is None else k for k in self.keys], np.int64)
        there = np.flatnonzero(~null)
        distinct, first = np.unique(keys[there].astype(np.uint64), return_index=True)
        first = there[first]
        index = PerfectHash.build(distinct)
        slots = index.slots(distinct)
        by_slot, marks = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.uint32)
        by_slot[slots], marks[slots] = first, prints(distinct)
        parts = [np.array(self.ends, np.int64), keys, null.astype(np.uint8), by_slot, marks, *(np.packbits(x) for x in index.levels), index.rest]
        for part in parts:
            self.out.write(part.tobytes())
        foot = json.dumps({"dtype": self.dtype.str, "n_ids": self.ends[-1], "n_docs": len(keys), "n_keys": len(distinct), "levels": [len(x) for x in index.levels], "rest": len(index.rest)}).encode()
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.out.close()
        seen = [k for k in self.keys if k is not None]
        row = {"name": self.name, "n_docs": len(keys), "n_ids": self.ends[-1], "first_key": min(seen, default=None), "last_key": max(seen, default=None), "has_null": bool(null.any())}
        self.out = None
        return row


class Shard:
    """Keyed access to a shard: the index is read at once, payloads by range."""

    def __init__(self, folder: str, name: str):
        self.file = files.open_input(folder, name)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is no shard")
        long = int.from_bytes(tail[:8], "little")
        foot = json.loads(self.file.read_at(long, size - 16 - long))
        self.dtype, self.n_ids, n, k = np.dtype(foot["dtype"]), foot["n_ids"], foot["n_docs"], foot["n_keys"]
        at = self.n_ids * self.dtype.itemsize

        def section(dtype, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(self.file.read_at(count * np.dtype(dtype).itemsize, at), dtype)
            at += got.nbytes
            return got

        self.ends, self.keys, self.null = section(np.int64, n + 1), section(np.int64, n), section(np.uint8, n).astype(bool)
        self.by_slot, self.marks = section(np.int64, k), section(np.uint32, k)
        levels = [np.unpackbits(section(np.uint8, (x + 7) // 8), count=x).astype(bool) for x in foot["levels"]]
        self.index = PerfectHash(levels, section(np.uint64, foot["rest"]))

    def find(self, keys: np.ndarray, null: np.ndarray | None = None) -> np.ndarray:
        """The first document of each key (of null, where null is set), -1 if the key isn't there."""
        hashes = keys.astype(np.uint64)
        slots = self.index.slots(hashes)
        ok = slots >= 0
        ok[ok] = self.marks[slots[ok]] == prints(hashes[ok])
        found = np.where(ok, self.by_slot[np.maximum(slots, 0)] if len(self.by_slot) else -1, -1)
        return found if null is None else np.where(null, int(self.null.argmax()) if self.null.any() else -1, found)

    def ids(self, document: int) -> np.ndarray:
        width = self.dtype.itemsize
        a, b = int(self.ends[document]), int(self.ends[document + 1])
        return np.frombuffer(self.file.read_at((b - a) * width, a * width), self.dtype)

    def close(self) -> None:
        self.file.close()


def write_token_ids(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, dtype: str = "<u2", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards in folder; the manifest: part, seq, name, n_docs, n_ids, first_key, last_key, has_null. dtype must hold the vocabulary."""
    base = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = tasks_for(docs, TASK_BYTES)
    ranged = base.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    ranged = ranged.select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("has_null", pa.bool_())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(path, dtype), np.array([end_id], dtype).tobytes()
        shard, rows, part = ShardWriter(folder, dtype), [], 0

        def done() -> None:
            if (row := shard.close()) is not None:
                rows.append({"part": part, "seq": len(rows), **row})

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            block = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // BATCH_BYTES
            starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for i, j in zip(starts, starts[1:]):
                for key, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), tool.encode(batch.column(1).slice(i, j - i))):
                    shard.add(key, ids + end)
                    if shard.n_ids >= shard_ids:
                        done()
        done()
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return stored(ranged.mapInArrow(write, "part int, seq int, name string, n_docs long, n_ids long, first_key long, last_key long, has_null boolean"), "token-manifest")


def read_token_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each found through its shard's index."""
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # one row a shard of some million ids
    starts = manifest.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(8, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count() // 4)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(folder, r["name"])
                found = shard.find(shard.keys, shard.null)
                new = np.concatenate([[True], (shard.keys[1:] != shard.keys[:-1]) | (shard.null[1:] != shard.null[:-1])])[: len(found)]
                run = np.flatnonzero(new)
                if (found != run[np.cumsum(new) - 1]).any():
                    raise ValueError(f"the index of {r['name']} doesn't match its keys")
                place = np.arange(len(found)) - run[np.cumsum(new) - 1] + found
                crc = [zlib.crc32(shard.ids(int(i)).astype("<u4").tobytes()) for i in place]
                starts_, ends_ = shard.ends[place], shard.ends[place + 1]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys, pa.int64(), mask=shard.null), pa.array(starts_ + r["base"]), pa.array(ends_ - starts_), pa.array(crc, pa.int64())], schema=schema)
                shard.close()

    return starts.repartition(n, "name").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-ids")
    manifest = write_token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_ids(manifest, folder)
