"""Token shards and WARC archives: exact round trips, index look-ups, ranges of any size, edge cases."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers

from regesta.llm import files, token_ids, warc
from regesta.llm.common import shared_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids():
    tool = tokenizers.Tokenizer.from_file(BPE)
    tool.encode_special_tokens = True
    return lambda text: [*tool.encode(text or "", add_special_tokens=False).ids, 0]


def brute(rows):
    """doc_id, start, n_tokens, crc32, by the library on whole texts."""
    encode, out, start = plain_ids(), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def as_rows(df):
    return [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()]


def test_tokens_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(as_rows(token_ids.op1_token_ids(spark, sf))) == sorted(brute(rows))


def test_token_edges(spark, odd, empty):
    folder = shared_dir(spark, "t1")
    got = as_rows(token_ids.read_token_ids(token_ids.write_token_ids(odd, folder, BPE, shard_ids=300), folder))
    want = brute([(r[0], r[1]) for r in odd.collect()])
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    assert [r[:1] + r[2:] for r in sorted(got, key=key)] == [r[:1] + r[2:] for r in sorted(want, key=key)]
    by_start = sorted(got, key=lambda r: r[1])
    assert all(a[1] + a[2] == b[1] for a, b in zip(by_start, by_start[1:])) and by_start[0][1] == 0
    folder = shared_dir(spark, "t2")
    manifest = token_ids.write_token_ids(empty, folder, BPE)
    assert manifest.count() == 0 and token_ids.read_token_ids(manifest, folder).count() == 0


def test_cutting_changes_no_ids():
    rng, encode = np.random.default_rng(5), plain_ids()
    parts = [" ", "  ", "\n", "\t", "a", "é", " ", "\x1c", "\xa0", "!", "'s", "12", "<|endoftext|>", "\x85", "漢", "\x00", "😀", "\x0b", "\x01"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)]
    got = token_ids.Encoder(BPE, "<u2").encode(pa.array(texts))
    assert all(np.frombuffer(x, "<u2").tolist() == encode(t)[:-1] for x, t in zip(got, texts))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    index = token_ids.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_keyed_access(spark, tmp_path):
    folder = f"file://{tmp_path}"
    writer = token_ids.ShardWriter(folder, "<u2")
    for k in (5, -3, None, 99):
        writer.add(k, np.arange(k or 7, (k or 7) + 3).astype("<u2").tobytes() if k != -3 else b"")
    shard = token_ids.Shard(folder, writer.close()["name"])
    assert shard.find(np.array([99, 5, -3, 1000, 0])).tolist() == [3, 0, 1, -1, -1]
    assert shard.ids(3).tolist() == [99, 100, 101] and shard.ids(1).tolist() == []
    assert shard.find(np.array([0]), np.array([True])).tolist() == [2]


def test_any_key_beside_null(spark):
    rows = [(k, "a b") for k in (None, -7046029254386353131, 2**63 - 1, -(2**63), None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = shared_dir(spark, "t3")
    got = as_rows(token_ids.read_token_ids(token_ids.write_token_ids(docs, folder, BPE), folder))
    key = lambda x: (x is not None, x or 0)
    assert sorted((r[0] for r in got), key=key) == sorted((r[0] for r in rows), key=key)


def test_warc_equals_sql(spark, sf, same):
    same(warc.op4_warc(spark, sf), warc.ORACLE)


def test_every_range_size_reads_every_record_once(spark, sf):
    folder = shared_dir(spark, "w1")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    manifest = warc.write_warc(pages, folder)
    want = sorted(str(r.page_id) for r in pages.collect())
    for row in manifest.collect():
        with files.open_input(folder, row["name"]) as handle:
            whole = [f["x-key"] for f, _ in warc.read_range(handle, row["bytes"], 0, row["bytes"])]
            for step in (997, 4096, 50_000):
                parts = [f["x-key"] for at in range(0, row["bytes"], step) for f, _ in warc.read_range(handle, row["bytes"], at, min(row["bytes"], at + step))]
                assert parts == whole
    assert sorted(r.key for r in warc.read_warc(manifest, folder, 10_000).collect()) == want


def test_magic_in_the_trailer(tmp_path):
    """Records of 2,187 bytes whose checksum ends in 1f: checksum and length hold a gzip magic."""
    rest, found = 2187 - len(warc.record("1", "u", b"%01000d" % 0, None, False)) + 1000, []
    for i in range(40_000):
        if zlib.crc32(data := warc.record("1", "u", b"%0*d" % (rest, i), None, False)) >> 24 == 0x1F and len(data) == 2187:
            found.append(data)
    assert len(found) > 50
    members = [warc.member(x) for x in found]
    assert all(m.find(warc.MAGIC, len(m) - 9) > 0 for m in members)
    (tmp_path / "a").write_bytes(whole := b"".join(members))
    with files.open_input(f"file://{tmp_path}", "a") as handle:
        want = [body for _, body in warc.read_range(handle, len(whole), 0, len(whole))]
        assert len(want) == len(found)
        for step in (7, 101, len(members[0]) - 5, len(members[0])):
            assert [b for at in range(0, len(whole), step) for _, b in warc.read_range(handle, len(whole), at, min(len(whole), at + step))] == want


def test_nested_members_of_every_kind():
    inner = [warc.member(warc.record(str(i), "u", b"x" * i, None, False)) for i in range(0, 400, 23)]
    for payload in (b"".join(inner), b"\x00".join(inner * 3), inner[3] * 50):
        data = warc.record("9", "u", payload, None, False)
        out = warc.member(data)
        assert zlib.decompress(out, 31) == data
        assert [at for at in range(1, len(out)) if out.startswith(warc.MAGIC, at) and warc.inflate(out[at:], whole=True) is not None] == []


def test_warc_edges(spark):
    nested = warc.member(warc.record("9", "u", b"inner", None, False)).decode("latin-1")
    rows = [(1, "u", "a"), (2, None, "a"), (None, "u", "a"), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", nested), (6, "u", "x" * 200_000), (6, "u", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, HTML string")
    folder = shared_dir(spark, "w2")
    got = warc.read_warc(warc.write_warc(pages, folder), folder, 64).collect()
    assert sorted((r.key or "", r.record_type, r.refers_to or "", r.payload_bytes) for r in got) == sorted(
        [("1", "revisit", "2", 1), ("2", "response", "", 1), ("", "revisit", "2", 1), ("3", "revisit", "4", 0), ("4", "response", "", 0), ("5", "response", "", len(nested.encode())), ("6", "response", "", 200_000), ("6", "response", "", 200_000)]
    )
    assert {r.payload.decode() for r in got if r.key == "5"} == {nested}
    none = warc.write_warc(pages.where("page_id > 99"), shared_dir(spark, "w3"))
    assert none.count() == 0 and warc.read_warc(none, folder).count() == 0
