"""Near-duplicates, passages, personal data, toxicity and SentencePiece against brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from regesta.llm import near_dedup, pii, sentencepiece_codec, substring_dedup, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ---- near-duplicates
def brute_components(rows, k, percent):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], doc)
    return {(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_equals_brute_force(spark, sf, k, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    random.seed(8)
    base = [f"b{i}" for i in range(60)]
    for i in range(120):  # chains of small edits
        base = list(base)
        base[random.randrange(len(base))] = f"e{i}"
        rows.append((10_000 + i, " ".join(base)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {tuple(r) for r in got} == brute_components(rows, k, percent)


def test_near_edges(spark, odd, empty):
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_groups(odd, 3, 85).collect()}
    assert rows[2, 0] == 2 and rows[3, 0] == 3 and rows[8, 0] == 8
    assert rows[1, 2] == rows[4, 2] == rows[None, 2] == 1 and rows[10, 119] == 9
    assert near_dedup.near_groups(empty, 3, 85).count() == 0
    kept = near_dedup.keep_one(odd, 3, 85)
    assert kept.columns == odd.columns and {r[0] for r in kept.collect()} == {1, 2, 3, 7, 8, 9, 11, 12, None}


def test_rows_without_id_are_linked(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(9, a), (None, a + " end"), (11, a + " tail"), (None, "x y z q"), (None, "x y z q"), (3, "lone text here now")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (-1, 9), (3, 3), (9, 9), (11, 9)]


# ---- passages
def test_passages_are_found(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9)))
    text = lambda n: [word() for _ in range(n)]
    shared, rows = [text(60) for _ in range(20)], []
    for i in range(100):
        a, b = text(random.randint(5, 300)), text(random.randint(5, 300))
        rows.append((i, " ".join(a + (shared[i // 2] if i < 40 else []) + b)))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(40))
    assert all(min(r.first_ids) == r.doc_id // 2 * 2 for r in found)
    texts = dict(rows)
    assert all(texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode() in " ".join(shared[r.doc_id // 2]) for r in found)


def test_passage_edges(odd, empty):
    table = substring_dedup.chunk_table(odd).collect()
    assert {r.doc_id for r in table} == {1, 4, None, 7, 9, 10, 11, 12}
    for doc in (7, 11):  # chunks hold all of a text
        assert sum(r.words for r in table if r.doc_id == doc) >= (30_000 if doc == 7 else 50_000 // substring_dedup.LETTERS)
    assert {r.doc_id for r in substring_dedup.repeated_passages(odd).collect()} == {9, 10}
    assert substring_dedup.repeated_passages(empty).count() == 0


def brute_passages(rows, min_words):
    """Chunks by the definition, shared ones by counting, runs by walking; runs without blanks aside."""
    texts = {}
    for doc, text in rows:
        raw = text.encode()
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        gear = [sum(int(substring_dedup.GEAR[x]) << k for k, x in enumerate(reversed((b"\0" * 32 + raw[:a])[-32:]))) % 2**32 for a, _ in spans]
        r = substring_dedup.REACH
        first = [i for i in range(len(spans)) if i == 0 or (r <= i < len(spans) - r and all(gear[i] < gear[i - d] and gear[i] <= gear[i + d] for d in range(1, r + 1)))]
        texts[doc] = [(spans[i][0], spans[j - 1][1], j - i, raw[spans[i][0] : spans[j - 1][1]]) for i, j in zip(first, [*first[1:], len(spans)])]
    holders = defaultdict(set)
    for doc, parts in texts.items():
        for x in parts:
            holders[x[3]].add(doc)
    out = set()
    for doc, parts in texts.items():
        run = []
        for x in [*parts, None]:
            if x and len(holders[x[3]]) > 1:
                run.append(x)
            elif run:
                if (words := sum(y[2] for y in run)) >= min_words:
                    kept = sum(y[2] for y in run if min(holders[y[3]]) == doc)
                    out.add((doc, run[0][0], run[-1][1], words, kept, max(len(holders[y[3]]) for y in run), tuple(sorted({min(holders[y[3]]) for y in run}))))
                run = []
    return out


def test_passages_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 6_000 and not re.search(r"\S{257}", r.text or "")]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_byte, r.end_byte, r.n_words, r.kept_words, r.n_holders, tuple(r.first_ids)) for r in got} == brute_passages(rows, 16)


def test_runs_without_blanks_are_cut_by_content():
    random.seed(2)
    line = lambda n: "".join(random.choice("abcdefé漢") for _ in range(n))
    shared = line(1500)
    one, two = ({c[3] for c in substring_dedup.chunks(line(n) + shared + line(300))} for n in (700, 1001))
    words = sum(c[2] for c in substring_dedup.chunks(shared) if c[3] in one & two)
    assert len(one & two) >= 1 and words >= substring_dedup.MIN_WORDS


def test_repeats_are_taken_out(spark, odd, empty):
    random.seed(9)
    text = lambda n: [random.choice("abcdefghij") + str(random.randint(0, 10**6)) for _ in range(n)]
    shared = text(80)
    rows = [(i, " ".join(text(50) + (shared if i % 2 else []) + text(50)), f"x{i}") for i in range(20)] + [(None, " ".join(text(20) + shared + text(20)), "n"), (30, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string")
    got = {r[2]: r[1] for r in substring_dedup.without_repeats(docs).collect()}
    assert len(got) == 22 and got["x1"] == rows[1][1] and got["z"] is None
    for doc, whole, mark in rows[:21]:
        inside = len(set(shared) & set(got[mark].split()))
        assert inside == 80 if mark == "x1" else inside < 40 or doc is not None and doc % 2 == 0
        assert not set(whole.split()) - set(shared) - set(got[mark].split()) or mark != "x0"
        assert mark not in {f"x{i}" for i in range(0, 20, 2)} or got[mark] == whole
    assert substring_dedup.without_repeats(odd).columns == odd.columns and substring_dedup.without_repeats(empty).count() == 0


def test_an_insertion_moves_near_cuts_only():
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(500))
    one, two = ({c[3] for c in substring_dedup.chunks(t)} for t in (text, text[:1000] + " new words here " + text[1000:]))
    assert len(one - two) <= 4


# ---- personal data
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")


def brute_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_patterns(spark, sf):
    random.seed(3)
    parts = ["1", "255", "256", ".", "@", "a", "x-y", "+", " ", "-", "(", ")", "4111 1111 1111 1111", "a.b@c.de", "10.0.0.1", "é", "+41 44 668 18 00", "\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(5000)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_added_spans(spark, odd, empty):
    rows = [(1, "please call (724) 555-7058 today"), (2, "mail john[at]example.com soon"), (3, "In 1999 there were 24 of 1,250 things on 2024-01-31."), (4, "a.b@c.de and 10.0.0.1"), (5, None)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == "phone:12:26" and got[2].spans.startswith("email:5:") and got[3].spans == "" and got[5].spans == ""
    assert got[4].spans == "email:0:8,ip:13:21" and got[4].base_sha256 == hashlib.sha256(b"email:0:8,ip:13:21").hexdigest()
    assert got[1].n_phone == 0 and got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(odd).count() == 13 and pii.personal_data(empty).count() == 0


def test_recall_on_held_out_forms(spark, sf):
    """Numbers and addresses of the table's kinds with other digits, letters and groupings, in other sentences."""
    rng = random.Random(12)
    d = lambda form: "".join(str(rng.randint(1, 9)) if c == "#" else c for c in form)
    name = lambda n: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(n))
    forms = {
        "phone": lambda: d(rng.choice(["(###) ###-####", "0## ### ## ##", "0041 ## ### ## ##", "0044 ## #### ####", "###-###-####", "0#### ######", "0### ## ## ##"])),
        "email": lambda: rng.choice([f"{name(5)}[at]{name(6)}.org", f"{name(4)} [at] {name(6)} [dot] com", f"{name(6)} (at) {name(5)}.net", f"{name(3)}.{name(4)}(at){name(5)}.example"]),
        "card": lambda: d(rng.choice(["####.####.####.####", "####_####_####_####"])),
        "ip": lambda: f"2001:db8:{rng.randint(0, 9999)}::{rng.randint(1, 9)}:{rng.randint(10, 9999)}",
    }
    words = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in r.text.split() if w.isalpha()]
    found = {k: 0 for k in forms}
    for kind, form in forms.items():
        for _ in range(150):
            left, right = (" ".join(rng.choices(words, k=6)) for _ in range(2))
            span = form()
            text = f"{left} {span}{rng.choice(['', '', '.', ','])} {right}"
            got = pii.added_spans([text], [pii.base_spans(text)], pii.trained())[0]
            found[kind] += (kind, len(left) + 1, len(left) + 1 + len(span)) in got
    print(found)
    assert min(found.values()) >= 0.9 * 150, found
    plain = [(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wrong = sum(map(len, pii.added_spans(plain, [pii.base_spans(x) for x in plain], pii.trained())))
    assert wrong <= len(plain) // 100, wrong


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(4)
    n = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(4, n)), rng.normal(size=(n, n)))
    scores = rng.normal(size=(20, 3, n))
    lengths = rng.integers(1, 4, 20)
    got = field.viterbi(scores, lengths)
    for s, m, y in zip(scores, lengths, got):
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) + sum(field.move[a, b] for a, b in zip((0, *p), (*p, 0)))
        assert tuple(y[:m]) == max(product(range(n), repeat=int(m)), key=value)


# ---- toxicity
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op7_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    # 120 toxic rows: measured 84 of 113 predicted and 84 of 120 toxic (recall varies by some 0.08 with the training order)
    assert hits / sum(r.predicted for r in rows) > 0.6 and hits / sum(r.toxic for r in rows) > 0.6
    assert docs.count() == toxicity.scored(docs, None).count()


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 4, 7, 9, 10, 11, 12)] + [(1, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(empty, model).count() == 0
    assert toxicity.train(odd, labels.where("toxic = 1")) is None and toxicity.train(empty, labels) is None


def test_toxic_by_phrase_alone(spark):
    """Toxic documents hold fixed phrases of words that ordinary documents have as often."""
    random.seed(5)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(3, 8))) for _ in range(300)]
    phrases = [[random.choice(words) for _ in range(6)] for _ in range(12)]
    rows, labels = [], []
    for i in range(600):
        parts = [list(random.choice(phrases)) if random.random() < 0.5 else random.choices(words, k=6) for _ in range(15)]
        flat = sum(parts, [])
        if i % 3:
            random.shuffle(flat)
        rows.append((i, " ".join(flat)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs.where("doc_id < 450"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    new = [(r.doc_id % 3 == 0, r.score) for r in toxicity.scored(docs.where("doc_id >= 450"), model).collect()]
    right = sum(a > b for x, a in new if x for y, b in new if not y)
    assert right > 0.95 * sum(x for x, _ in new) * sum(not x for x, _ in new)


def test_training_reads_whole_texts(spark):
    """Toxic words stand after 30,000 characters of ordinary ones."""
    random.seed(7)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8))) for _ in range(400)]
    rows = [(i, " ".join(random.choices(words, k=5_000) + ["zyxwvu", "qqvvzz"] * 5 * (i % 2) + random.choices(words, k=50))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    assert all(len(t) > 30_000 for _, t in rows)
    model = toxicity.train(docs, labels)
    got = toxicity.scored(spark.createDataFrame([(1, rows[0][1]), (2, rows[0][1] + " zyxwvu qqvvzz" * 5)], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.score >= 0.5 for r in got} == {1: False, 2: True}


# ---- SentencePiece
def test_without_dropout_equals_the_library(spark, sf):
    tool = sentencepiece_codec.Codec(PIECES, 0.0)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["", " ", "  a ", "a  b", "x▁y", "\x01 q", "\x00", "é😀漢", "x" * 100, " \x01"]
    got = tool.encode([(None, t) for t in texts])
    assert all(x.tolist() == tool.sp.encode(t) for x, t in zip(got, texts) if "▁" not in t)
    assert tool.decode(got) == texts == [tool.sp.decode(x.tolist()) for x in got]


def test_dropout_varies_and_is_lossless(spark, sf, odd, empty):
    tool = sentencepiece_codec.Codec(PIECES, 0.2)
    text = "the international conference on information processing and understanding " * 5
    a, b, c = (tool.encode([(k, text)])[0].tolist() for k in (1, 2, 1))
    assert a == c != b and a != tool.sp.encode(text)
    words = ["▁international", "▁straße", "a" * 40, "▁x😀y"]
    for v in range(4):  # all words at once, or one by one with an agenda
        assert tool.direct(words, np.full(len(words), v, np.uint64)) == [tool.as_ids(tool.alone(w, v)) for w in words]
    rows = sentencepiece_codec.encoded(odd, PIECES, with_ids=True).collect()
    texts = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in odd.collect())
    assert all(r.lossless and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert sorted(r.decoded_sha256 for r in rows) == texts
    assert sentencepiece_codec.encoded(empty, PIECES).count() == 0
    one, two = (sentencepiece_codec.encoded(spark.read.parquet(f"{sf}/documents.parquet").repartition(n), PIECES).orderBy("doc_id").collect() for n in (1, 5))
    assert one == two


def plain_dropout(tool, word, draw):
    """Segmentation by the definition: of all pairs that may be joined and weren't skipped, the best score, leftmost first."""
    n = len(tool.score) - 1
    parts, met = [(i, tool.symbols[c]) for i, c in enumerate(word)], {}

    def may(i):
        (place, a), (_, b) = parts[i], parts[i + 1]
        got = tool.pair_map.get(a * tool.size + b)
        if got is not None and (place, a, b) not in met:
            x = (draw + (place << 40) + (a * tool.size + b) * 0x9E3779B97F4A7C15) % 2**64
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
            met[place, a, b] = x ^ (x >> 31) < int(tool.limit)
        return got is not None and not met[place, a, b]

    while found := [(-tool.score[tool.pair_map[parts[i][1] * tool.size + parts[i + 1][1]]], i) for i in range(len(parts) - 1) if may(i)]:
        i = min(found)[1]
        parts[i : i + 2] = [(parts[i][0], tool.pair_map[parts[i][1] * tool.size + parts[i + 1][1]])]
    assert all(s < n for _, s in parts)
    return [s for _, s in parts]


def test_trees_only_save_work(monkeypatch):
    """The trees' outcomes are those of the definition, also when trees are given up on the way."""
    rng = random.Random(3)
    words = ["the", "international", "understanding", "a", "processing", "nationality", "une", "straße"] + ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    for nodes in (1_800_000, 60):
        monkeypatch.setattr(sentencepiece_codec, "NODES", nodes)
        tool = sentencepiece_codec.Codec(PIECES, 0.3)
        for doc in range(12):
            picked = [rng.choice(words) for _ in range(150)]
            draws = tool.draws([doc], [len(picked)])
            ids, lengths = tool.cut(picked, draws)
            ends = np.cumsum(lengths).tolist()
            want = [plain_dropout(tool, "▁" + w, d) for w, d in zip(picked, draws.tolist())]
            assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == want
        assert tool.n_nodes > 20


def test_each_occurrence_is_cut_for_itself():
    tool = sentencepiece_codec.Codec(PIECES, 0.1)
    for text in ("international " * 3000, "▁" + "international " * 3000):
        ids = tool.encode([(1, text)])[0].tolist()
        cuts = re.split("▁+", "|".join(tool.sp.id_to_piece(ids)))
        assert len(set(cuts)) > 8 and tool.decode([np.array(ids)]) == [text]
