"""Exact dedup, mixing, quality rules: SQL twins on data and edge cases."""

import hashlib
import os
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import functions as F

from regesta.llm import exact_dedup, mixing, quality


def test_queries_equal_sql(spark, sf, same):
    same(exact_dedup.op2_exact_dedup(spark, sf), exact_dedup.ORACLE)
    same(mixing.op3_mixing(spark, sf), mixing.ORACLE)
    same(quality.op6_quality_rules(spark, sf), quality.ORACLE)


def test_exact_edges(odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == 13
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    abcd = groups[hashlib.sha256(b"a b c d").hexdigest()]
    assert {r.keep_id for r in abcd} == {4} and {r.group_size for r in abcd} == {4} and sum(r.kept for r in abcd) == 1
    none = groups[hashlib.sha256(b"").hexdigest()]
    assert sorted(r.doc_id or 0 for r in none) == [0, 2, 3] and [r.doc_id for r in none if r.kept] == [3]
    assert all(sum(r.kept for r in g) == 1 for g in groups.values())
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_colliding_digests_stay_apart(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "b"), (5, "ab")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs, digest=lambda t: F.substring(t, 1, 1).cast("binary")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == {1: (3, 2, False), 2: (5, 2, False), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 2, True)}


def test_many_batches(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 37).alias("text")).repartition(8)
    rows = exact_dedup.exact_dedup(docs, bytes_per_trigger=2_000).collect()
    assert Counter(r.kept for r in rows) == {True: 37, False: 363}
    assert all(r.keep_id == max(x for x in range(400) if x % 37 == r.doc_id % 37) for r in rows)


def test_a_stopped_stream_goes_on(spark, monkeypatch):
    docs = exact_dedup.stored(spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 37).alias("text")).repartition(6), "t-docs")
    path, whole = exact_dedup.shared_dir(spark, "t-state"), exact_dedup.stream_state
    seen = []

    def stopped(spark, feed, path, size):
        """Only a part of the feed's files are there at first."""
        at = path.removeprefix("file://") + "/feed"
        parts = sorted(x for x in os.listdir(at) if x.startswith("part-"))
        for name in parts[::2]:
            os.rename(f"{at}/{name}", f"{at}/_{name}")
        seen.append(whole(spark, feed, path, size).agg(F.sum("n")).first()[0])
        for name in parts[::2]:
            os.rename(f"{at}/_{name}", f"{at}/{name}")
        raise InterruptedError

    monkeypatch.setattr(exact_dedup, "stream_state", stopped)
    try:
        exact_dedup.exact_dedup(docs, state_path=path, bytes_per_trigger=1_000)
    except InterruptedError:
        pass
    monkeypatch.setattr(exact_dedup, "stream_state", whole)
    assert 0 < seen[0] < 300
    for _ in range(2):  # the second time there is nothing new
        rows = exact_dedup.exact_dedup(docs, state_path=path).collect()
        assert Counter(r.kept for r in rows) == {True: 37, False: 263}
        assert all(r.keep_id == max(x for x in range(300) if x % 37 == r.doc_id % 37) for r in rows)


def test_rows_are_judged_and_taken_each_for_itself(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(None, "short", "s"), (None, good, "s"), (1, "short", "s"), (1, good + " x", "s"), (1, good + " y", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = quality.drop_rejected(docs).collect()
    assert sorted(r.text for r in kept) == sorted([good, good + " x", good + " y"])
    sizes = Counter()
    for r in mixing.mixed_rows(docs).collect():
        sizes[r.source] += len(r.text.split())
    want = sum(r.taken for r in mixing.mix(docs).collect())
    assert sizes["s"] == want and abs(want - 1.5 * sum(len(t.split()) for _, t, _ in rows)) <= 61


def test_mixing_edges(odd, empty, same):
    pdf = pd.DataFrame([(r[0], r[1], r[3]) for r in odd.collect()], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    pdf["text"] = pdf["text"].str.replace("\x00", "")
    same(mixing.mix(odd), mixing.oracle("d"), {"d": pdf})
    assert mixing.mix(empty).count() == 0
    taken = mixing.mix(odd).collect()
    assert all(r.taken <= 2 * r["size"] for r in taken)
    assert mixing.mixed_rows(odd).columns == odd.columns


def test_mix_is_near_and_stable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sorted(mixing.mix(docs.repartition(n)).collect()) for n in (2, 7))
    assert one == two
    got, goal = Counter(), {}
    for r in one:
        got[r.source] += r.taken
        goal[r.source] = (r.target, max(goal.get(r.source, (0, 0))[1], r["size"]))
    assert all(abs(got[s] - t) <= largest for s, (t, largest) in goal.items())


def water_fill(sizes, weights, total, cap):
    """Resharing round by round."""
    target, free = dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        left = total - sum(target[s] for s in sizes if s not in free)
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        target |= share if not over else {s: cap * sizes[s] for s in over}
        if not over:
            return target
        free -= set(over)
    return target


def test_targets_equal_resharing(spark):
    sizes = {"a": 10, "b": 500, "c": 90, "d": 3, "e": 1000, "f": 40}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    weights = dict(zip(sorted(sizes), (3, 1, 2) * 2))
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in rows)


def test_quality_edges(odd, empty, same):
    rows = {r.doc_id: r for r in quality.judged(odd).collect()}
    assert rows[2].n_words == 0 and rows[2].base_failed and not rows[2].kept
    assert rows[7].n_words == 30_000 and rows[7].n_repeat_words == 0
    pdf = pd.DataFrame([(r[0], r[1], r[3]) for r in odd.where(F.coalesce(F.col("n_chars"), F.lit(0)) == 0).collect()], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    pdf["text"] = pdf["text"].str.replace("\x00", "")
    clean = odd.sparkSession.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in pdf.astype(object).itertuples(index=False)], "doc_id long, text string, source string")
    same(quality.judged(clean).select(*quality.COUNTS), quality.oracle("d"), {"d": pdf})
    assert quality.judged(empty).count() == 0
    assert quality.drop_rejected(odd).columns == odd.columns


def test_repeats_brute_force(spark):
    import random

    random.seed(4)
    texts = [" ".join(random.choice("ab") for _ in range(random.randint(0, 30))) for _ in range(200)]

    def brute(text):
        w = text.split()
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({i + d for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for d in range(3)})

    rows = quality.measured(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    assert all(r.n_repeat_words == brute(texts[r.doc_id]) for r in rows)


def test_bad_host_goes_and_trusted_may_slip(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"w#{i}#" for i in range(60))
    rows = [(i, bad + str(i), "junk") for i in range(500)] + [(1000 + i, good + str(i), "fine") for i in range(500)] + [(5000, bad, "fine"), (5001, good, "junk")] + [(2000 + i, bad if i % 4 == 0 else good, "mid") for i in range(100)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[5000] and not got[5001] and got[1000] and not got[0] and not got[2000] and got[2001]
