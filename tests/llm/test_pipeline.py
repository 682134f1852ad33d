"""The pipeline's stages against their own operators by brute force, and a run over edge cases."""

from collections import Counter

from test_texts import brute_components

import corpus_pipeline
from regesta.llm import mixing, quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    rules, exact, near, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    kept = {r.doc_id for r in quality.judged(docs).where("kept").select("doc_id").collect()}
    one = rules(spark, docs, sf)
    assert one.columns == names and {r.doc_id for r in one.collect()} == kept
    last = {}
    for r in sorted(one.collect(), key=lambda r: r.doc_id):
        last[r.text or ""] = r.doc_id
    two = exact(spark, one, sf)
    assert two.columns == names and {r.doc_id for r in two.collect()} == set(last.values())
    rows = [(r.doc_id, r.text) for r in two.collect()]
    three = near(spark, two, sf)
    assert three.columns == names and {r.doc_id for r in three.collect()} == {c for _, _, c in brute_components(rows, 5, 80)}
    four = mix(spark, three, sf)
    takes = {r.doc_id: r.copies for r in mixing.mix(three).collect() if r.copies}
    assert four.columns == names and Counter(r.doc_id for r in four.collect()) == takes
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in out) == takes and all(r.lossless for r in out)


def test_stages_on_odd_rows(spark, odd, empty, sf):
    for docs in (odd, empty):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            nxt = stage(spark, docs, sf)
            at = stage(spark, at, sf)
            assert nxt.count() is not None and at.count() <= 2 * docs.count(), name
