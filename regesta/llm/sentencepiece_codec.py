"""Operator 9: SentencePiece encoding with seeded merge-dropout, and decoding.

Merge-type segmentation takes the adjacent pair of best score from an agenda, joins it, and goes on. With dropout,
each candidate that enters the agenda is skipped if a keyed hash of (seed, draw, word, place, pair) falls below
alpha; without (alpha 0) the ids are those of the library. A word occurrence has its own draw, a 64-bit hash of (seed,
doc_id, place of the word), so reruns agree while each occurrence is cut for itself. Blanks only begin pieces in this
vocabulary (checked), so text falls apart into words; they are cut together, one agenda step for all words of a length
class at a time, by numpy. Words of more than WIDTH characters go through an ordinary agenda (a heap).

What is kept between words is a tree for each word met twice: a node is the outcome of some skips, with the candidates
that the agenda meets after the last of them; its children are the outcomes of one skip more. An occurrence hashes the
candidates of a node with its own draw and goes on at the child of the first one skipped. So the tree only saves runs of
the agenda: every draw decides for itself, and outcomes not in the tree are worked out. Its size is bounded; a full tree
is given up. That a word was met once is a mark at its hash; a mark that another word set only plants a tree early. Beside
the trees a task holds the words of a slice of texts, of a mebibyte or one text.

Characters outside the vocabulary, and the blank sign itself, become byte pieces, so decoding gives every text back.

Nulls: a null text is empty and has no ids; a null doc_id counts as 0 in the hash. Rows that share id and text are
encoded alike. Other columns are ignored in the query and kept in the stage. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked

ALPHA, SEED, WIDTH = 0.1, 9, 48
BLOCK = 1 << 14  # words hashed at a time: their candidates stay in the processor's cache
#: Bounds of the kept trees: words, nodes, candidates and ids; marks of words met once.
WORDS, NODES, CANDIDATES, IDS, MARKS = 300_000, 700_000, 5_000_000, 2_500_000, 1 << 22
#: Texts are encoded in slices of so many rows and bytes (one text at least), words in runs of so many.
ROWS, BYTES, RUN = 1024, 1 << 20, 1 << 16
SPACE = "▁"
SPLIT = re.compile(" *[^ ]+| +")
NONE = np.int64(-1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Codec:
    def __init__(self, path: str, alpha: float = ALPHA, seed: int = SEED):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alpha, self.seed = alpha, seed
        n = sp.get_piece_size()
        ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece goes on after a blank; words can't be cut apart")
        if sp.normalize(" a  b ﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b ﬁ{SPACE}":
            raise ValueError("the model changes texts before it cuts them")
        self.byte = [sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        self.symbols = dict(ids)
        for p in ids:
            for c in p:
                self.symbols.setdefault(c, n + len(self.symbols))
        self.sign = {i: c for c, i in self.symbols.items() if i >= n}
        self.size = max(self.symbols.values()) + 1
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.pair_map = pairs
        self.score = np.array([sp.get_score(i) for i in range(n)] + [-np.inf], np.float64)  # the last stands for NONE
        # Ranks of the ids' scores, equal ones alike, from 0 on; the last is that of NONE.
        self.rank = np.append(np.unique(self.score[:-1], return_inverse=True)[1], NONE).astype(np.int32)
        self.pair_keys, self.pair_ids = hash_table(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        self.chars = {c: i for c, i in self.symbols.items() if len(c) == 1 and c != "\x00"}
        self.char_table = -2 - np.arange(0x110000, dtype=np.int32)  # characters outside the vocabulary stand for themselves
        for c, i in self.chars.items():
            self.char_table[ord(c)] = i
        shown = [bytes([self.byte.index(i)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.shown, self.shown_n = np.frombuffer(b"".join(shown), np.uint8), np.array(list(map(len, shown)))
        self.shown_at = np.cumsum(self.shown_n) - self.shown_n
        self.limit = np.uint64(min(2**64 - 1, int(alpha * 2**64)))
        self.cand, self.child = np.empty(CANDIDATES, np.uint64), np.empty(CANDIDATES, np.int32)
        self.ids = np.empty(IDS, np.uint16)
        # Of each node: where its candidates begin, how many, where its ids begin, how many, its parent, the skip that leads here.
        self.c0, self.cn, self.i0, self.ni = (np.empty(NODES, np.int32) for _ in range(4))
        self.parent, self.via = np.empty(NODES, np.int32), np.empty(NODES, np.uint64)
        self.reset()

    # -- agenda steps ----------------------------------------------------------------------------------------------
    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs, NONE where there is none."""
        keys = left * self.size + right
        keys[(left < 0) | (right < 0)] = NONE
        at = slots(keys, len(self.pair_keys))
        held = self.pair_keys.take(at)
        out = np.where(held == keys, self.pair_ids.take(at), np.int32(NONE))
        open_ = np.flatnonzero((held != keys) & (held != NONE))
        while len(open_):  # another key has the slot
            at[open_] = (at[open_] + 1) % len(self.pair_keys)
            held = self.pair_keys.take(at[open_])
            same = held == keys[open_]
            out[open_[same]] = self.pair_ids.take(at[open_[same]])
            open_ = open_[~same & (held != NONE)]
        return out

    def codes(self, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A number for each candidate, told apart within a word; a draw is added to it and the sum hashed."""
        return (place.astype(np.uint64) << np.uint64(40)) + (left * self.size + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def skipped(self, draws: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return mixed(draws + codes) < self.limit

    def together(self, words: list[str], draws: np.ndarray | None = None, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, bytes], np.ndarray, np.ndarray]:
        """(symbols of all words, how many each has, ids of words whose symbols aren't all ids, candidates, how many each
        has) for words of at most WIDTH characters, a step of every word's agenda at a time. What is skipped is told by
        each word's draw, or by barred, a row of candidates a word; only then the candidates are returned, in the order
        in which the agenda met them."""
        n, seen_rows, seen_codes = len(words), [], []
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        wide = width + 1  # the last place of a row stays empty
        sym = np.full(n * wide, NONE, np.int32)
        sym[(np.arange(wide)[None] < lengths[:, None]).ravel()] = self.char_table[codes]
        after = np.broadcast_to(np.minimum(np.arange(1, wide + 1, dtype=np.int32), width), (n, wide)).ravel().copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, wide)).ravel().copy()

        def candidates(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Ids of the joined symbols at i and j, NONE for those that don't join or are skipped."""
            left, right = sym.take(rows * wide + i).astype(np.int64), sym.take(rows * wide + j).astype(np.int64)
            got = self.lookup(left, right)
            there = np.flatnonzero(got >= 0)
            code, who = self.codes(i.take(there), left.take(there), right.take(there)), rows.take(there)
            if barred is None:
                out = self.skipped(draws.take(who), code)
            else:
                seen_rows.append(who)
                seen_codes.append(code)
                out = (barred.take(who, 0) == code[:, None]).any(1)
            got[there[out]] = NONE
            return got

        rows, i = np.nonzero(sym.reshape(n, wide)[:, 1:] != NONE)
        value = np.full((n, wide), NONE, np.int32)
        join = np.full(n * wide, NONE, np.int32)
        join[rows * wide + i] = got = candidates(rows, i, i + 1)
        value[rows, i] = self.rank.take(got)
        rows = np.arange(n)
        while len(rows):
            best = value.argmax(1)
            if not (going := value.ravel().take(np.arange(len(rows)) * wide + best) >= 0).all():
                value, rows, best = value[going], rows[going], best[going]
                if not len(rows):
                    break
            flat, at = value.ravel(), np.arange(len(rows)) * wide
            base = rows * wide
            right = after.take(base + best)
            beyond, ahead = after.take(base + right), before.take(base + best)
            sym[base + best], sym[base + right] = join.take(base + best), NONE
            after[base + best], before[base + beyond] = beyond, best
            flat[at + right] = flat[at + best] = NONE
            k = np.flatnonzero(ahead >= 0)
            join[base[k] + ahead[k]] = got = candidates(rows[k], ahead[k], best[k])
            flat[at[k] + ahead[k]] = self.rank.take(got)
            k = np.flatnonzero(sym.take(base + beyond) != NONE)
            join[base[k] + best[k]] = got = candidates(rows[k], best[k], beyond[k])
            flat[at[k] + best[k]] = self.rank.take(got)
        done = sym.reshape(n, wide)
        there = done != NONE
        plain = (done < len(self.score) - 1).all(1) & (done >= NONE).all(1)
        odd = {i: self.as_ids([x for x in done[i].tolist() if x != NONE]) for i in np.flatnonzero(~plain).tolist()}
        if barred is None:
            return done[there], there.sum(1), odd, np.empty(0, np.uint64), np.empty(0, np.int64)
        who, code = np.concatenate(seen_rows), np.concatenate(seen_codes)
        return done[there], there.sum(1), odd, code[np.argsort(who, kind="stable")], np.bincount(who, minlength=n)

    def alone(self, word: str, draw: int) -> list[int]:
        """The same for one word by an agenda proper, for words of any length."""
        key = np.array([draw], np.uint64)
        n = len(word)
        sym = [self.chars.get(c, -2 - ord(c)) for c in word]
        after, before, live, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, []

        def add(i: int) -> None:
            j = after[i]
            if j >= n or sym[i] < 0 or sym[j] < 0:
                return
            got = self.pair_map.get(sym[i] * self.size + sym[j])
            if got is not None and not (self.alpha > 0 and self.skipped(key, self.codes(np.array([i]), np.array([sym[i]]), np.array([sym[j]])))[0]):
                heapq.heappush(agenda, (-self.score[got], i, j, sym[i], sym[j], got))

        for i in range(n):
            add(i)
        while agenda:
            _, i, j, a, b, got = heapq.heappop(agenda)
            if not (live[i] and j < n and live[j] and after[i] == j and sym[i] == a and sym[j] == b):
                continue
            sym[i], live[j] = got, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                add(before[i])
            add(i)
        return [s for s, ok in zip(sym, live) if ok]

    def as_ids(self, symbols: list[int]) -> bytes:
        n, out = len(self.score) - 1, []
        for s in symbols:
            if 0 <= s < n:
                out.append(s)
            else:
                out += [self.byte[b] for b in (chr(-2 - s) if s < 0 else self.sign[s]).encode()]
        return np.array(out, "<u2").tobytes()

    def direct(self, words: list[str], draws: np.ndarray) -> list[bytes]:
        """Ids of spelled-out words (blanks written as SPACE), each cut by its own draw."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list[bytes] = [b""] * len(words)
        for part in classes(lengths):
            if lengths[part[0]] > WIDTH:
                out[part[0]] = self.as_ids(self.alone(words[part[0]], int(draws[part[0]])))
                continue
            at = part.tolist()
            symbols, counts, odd, _, _ = self.together([words[k] for k in at], draws[part])
            raw, ends = symbols.astype("<u2").tobytes(), (2 * np.cumsum(counts)).tolist()
            for k, x, y in zip(at, [0, *ends], ends):
                out[k] = raw[x:y]
            for i, ids in odd.items():
                out[at[i]] = ids
        return out

    # -- trees of outcomes -----------------------------------------------------------------------------------------
    def reset(self) -> None:
        self.root: dict[str, int] = {}  # -1: can't be kept
        self.met, self.n_met = bytearray(MARKS), 0
        self.n_nodes = self.n_cand = self.n_ids = 0
        self.word_of: dict[int, str] = {}

    def grow(self, words: list[str], parents: np.ndarray | None = None, vias: np.ndarray | None = None) -> np.ndarray:
        """New nodes: roots of words, or children of parents by one skip more. NONE for words that aren't kept: with
        signs outside the vocabulary, or when the tree is full."""
        if parents is None:
            parents, vias = np.full(len(words), NONE, np.int32), np.zeros(len(words), np.uint64)
            columns = [vias]
        else:
            columns, p = [vias], parents
            while (up := self.parent[p] >= 0).any():
                columns.append(np.where(up, self.via[p], np.uint64(0)))
                p = np.where(up, self.parent[p], p)
            words = [self.word_of[x] for x in p.tolist()]
        barred = np.stack(columns, 1)
        spelled = [SPACE + w.replace(" ", SPACE) for w in words]
        made = np.full(len(words), NONE, np.int32)
        for part in classes(np.fromiter(map(len, spelled), np.int64, len(spelled))):
            symbols, ni, odd, codes, nc = self.together([spelled[i] for i in part.tolist()], barred=barred[part])
            last, k = np.cumsum(nc), len(part)
            begin = last - nc
            if parents[part[0]] >= 0:  # what comes after the last skip
                begin = np.flatnonzero(codes == np.repeat(vias[part], nc)) + 1
            left = last - begin
            if self.n_nodes + k > NODES or self.n_cand + left.sum() > CANDIDATES or self.n_ids + ni.sum() > IDS:
                break
            nodes = slice(self.n_nodes, self.n_nodes + k)
            ends = np.cumsum(left)
            self.c0[nodes], self.cn[nodes] = self.n_cand + ends - left, left
            self.i0[nodes], self.ni[nodes] = self.n_ids + np.cumsum(ni) - ni, ni
            self.parent[nodes], self.via[nodes] = parents[part], vias[part]
            there = slice(self.n_cand, self.n_cand + int(ends[-1]))
            self.cand[there], self.child[there] = codes[np.repeat(begin - (ends - left), left) + np.arange(ends[-1])], NONE
            self.ids[self.n_ids : self.n_ids + len(symbols)] = symbols
            if parents[part[0]] < 0:
                self.word_of.update(zip(range(nodes.start, nodes.stop), [words[i] for i in part.tolist()]))
            made[part] = np.arange(nodes.start, nodes.stop)
            made[part[list(odd)]] = NONE
            self.n_nodes, self.n_cand, self.n_ids = nodes.stop, there.stop, self.n_ids + len(symbols)
        return made

    def cut(self, words: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has); a word is written without the blank before it."""
        if self.n_nodes > 0.9 * NODES or self.n_cand > 0.9 * CANDIDATES or self.n_ids > 0.9 * IDS:
            self.reset()
        if len(self.root) > WORDS:
            self.reset()
        if self.n_met > MARKS // 4:
            self.met, self.n_met = bytearray(MARKS), 0
        root, get, met = self.root, self.root.get, self.met
        node = np.fromiter(map(get, words, repeat(-2)), np.int32, len(words))
        twice = {}
        for i in np.flatnonzero(node < 0).tolist():
            w = words[i]
            if len(w) < WIDTH and w not in root and w not in twice:
                mark = hash(w) & (MARKS - 1)
                if met[mark]:
                    twice[w] = -1
                else:  # met once: cut by itself
                    met[mark] = 1
                    self.n_met += 1
        if twice:
            root.update(zip(twice, self.grow(list(twice)).tolist()))
            fresh = np.flatnonzero(node < 0)
            node[fresh] = [get(words[i], -1) for i in fresh.tolist()]
        self.walk(node, draws)
        lone = np.flatnonzero(node < 0)
        found = self.direct([SPACE + words[i].replace(" ", SPACE) for i in lone.tolist()], draws[lone])
        lengths, starts = self.ni[np.maximum(node, 0)].astype(np.int64), self.i0[np.maximum(node, 0)].astype(np.int64)
        lengths[lone] = [len(x) // 2 for x in found]
        starts[lone] = self.n_ids + np.cumsum(lengths[lone]) - lengths[lone]
        ends = np.cumsum(lengths)
        pool = np.concatenate([self.ids[: self.n_ids], np.frombuffer(b"".join(found), "<u2")])
        return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths

    def first_skips(self, node: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a candidate that its draw skips, and where the first of these is."""
        n = self.cn[node]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat(self.c0[node] - (ends - n), n)
        at += np.arange(ends[-1], dtype=np.int32)
        own = np.repeat(np.arange(len(node), dtype=np.int32), n)
        hit = np.flatnonzero(self.skipped(draws.take(own), self.cand.take(at)))
        who = own.take(hit)
        first = np.ones(len(who), bool)
        first[1:] = who[1:] != who[:-1]
        return who[first], at[hit[first]]

    def walk(self, node: np.ndarray, draws: np.ndarray) -> None:
        """Moves each occurrence from its word's root to its outcome; NONE where that isn't in the tree."""
        active = np.flatnonzero(node >= 0)
        while len(active):
            hits = [self.first_skips(node[part], draws[part]) for part in np.split(active, range(BLOCK, len(active), BLOCK))]
            active = active[np.concatenate([who + k * BLOCK for k, (who, _) in enumerate(hits)])]
            at = np.concatenate([x for _, x in hits])
            below = self.child[at]
            if (open_ := below < 0).any():
                places, index, many = np.unique(at[open_], return_index=True, return_counts=True)
                build = (many > 1) | (self.child[places] == -2)
                self.child[places[~build]] = -2  # asked for once
                if build.any():
                    self.child[places[build]] = self.grow([], node[active[open_]][index[build]], self.cand[places[build]])
                below = self.child[at]
            node[active] = np.maximum(below, NONE)
            active = active[below >= 0]

    # -- texts -----------------------------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """The words of a text without the sign, each without the blank before it."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] for w in SPLIT.findall(" " + text)]

    def draws(self, docs: list[int | None], counts: list[int]) -> np.ndarray:
        """A 64-bit draw for each of the word places 0..counts - 1 of each document."""
        start = np.array([((doc or 0) * 0x9E3779B97F4A7C15 + self.seed * 0xD1B54A32D192ED03) % 2**64 for doc in docs], np.uint64)
        n = np.array(counts, np.int64)
        places = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        return mixed(np.repeat(start, n) + places * np.uint64(0xA0761D6478BD642F))

    def encode(self, docs: list[tuple[int | None, str]]) -> list[np.ndarray]:
        split = [[] if SPACE in t else self.words(t) for _, t in docs]
        counts = [len(x) for x in split]
        flat, draws = [w for x in split for w in x], self.draws([doc for doc, _ in docs], counts)
        runs = [self.cut(flat[k : k + RUN], draws[k : k + RUN]) for k in range(0, max(len(flat), 1), RUN)]
        ids, lengths = (np.concatenate(x) for x in zip(*runs))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *counts])].tolist()
        return [self.around_sign(doc, text) if SPACE in text else ids[a:b] for (doc, text), a, b in zip(docs, ends, ends[1:])]

    def around_sign(self, doc: int | None, text: str) -> np.ndarray:
        """A text with the blank sign in it: the parts between are encoded, the signs become bytes."""
        sign = np.array([self.byte[b] for b in SPACE.encode()], "<u2").tobytes()
        parts = []
        for k, part in enumerate(text.split(SPACE)):
            spelled = [SPACE + w for w in self.words(part)] or [SPACE] if k == 0 else SPLIT.findall(part)
            parts.append([w.replace(" ", SPACE) for w in spelled])
        flat = [w for x in parts for w in x]
        got = iter(self.direct(flat, self.draws([doc], [len(flat)])))
        return np.frombuffer(sign.join(b"".join(next(got) for _ in x) for x in parts), "<u2")

    def decode_bytes(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts' UTF-8: what the ids' pieces stand for, without the blank that begins every text."""
        flat = np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64)
        n = self.shown_n.take(flat)
        ends = np.cumsum(n)
        raw = self.shown.take(np.repeat(self.shown_at.take(flat) - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)).tobytes()
        edges = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b] if a < b else b"" for a, b in zip(edges, edges[1:])]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [x.decode("utf-8", "replace") for x in self.decode_bytes(ids)]


def slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Places of keys in a table of size (a power of two) slots."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values by slot, NONE in free ones; a taken slot sends a key to the next."""
    size = 1 << (8 * len(keys)).bit_length()
    held, kept = np.full(size, NONE, np.int64), np.full(size, NONE, np.int32)
    at = slots(keys, size)
    left = np.arange(len(keys))
    while len(left):
        _, first = np.unique(at[left], return_index=True)
        takes = left[first][held[at[left[first]]] == NONE]
        held[at[takes]], kept[at[takes]] = keys[takes], values[takes]
        left = left[held[at[left]] != keys[left]]
        at[left] = (at[left] + 1) % size
    return held, kept


def classes(lengths: np.ndarray, many: int = 4096) -> Iterator[np.ndarray]:
    """Places of words of like length, at most many at a time; words beyond WIDTH one by one."""
    order = np.argsort(lengths, kind="stable")
    long, at = lengths[order], 0
    while at < len(order):
        least = int(long[at])
        top = least if least > WIDTH else min(WIDTH, least + 2 + least // 4)
        stop = at + 1 if least > WIDTH else min(at + many, int(np.searchsorted(long, top, "right")))
        yield order[at:stop]
        at = stop


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, how many) of runs of at most ROWS rows and BYTES bytes, one row at least."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        begin = ends[at] - sizes[at]
        stop = min(at + ROWS, max(at + 1, int(np.searchsorted(ends, begin + BYTES, "right"))))
        yield at, stop - at
        at = stop


_codecs: dict[tuple, Codec] = {}


def codec(*how) -> Codec:
    if how not in _codecs:
        _codecs[how] = Codec(*how)
    return _codecs[how]


def encoded(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit), decoded_sha256, lossless (decoded text equals
    text), and ids (array of int) if asked for, for each row."""
    base = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, alpha, seed)
        for whole in batches:
            for k, n in slices(pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False)):
                keys, texts = whole.column(0).slice(k, n).to_pylist(), whole.column(1).slice(k, n)
                ids = tool.encode(list(zip(keys, texts.to_pylist())))
                back = tool.decode_bytes(ids)
                cols = [pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                cols += [pa.array([hashlib.sha256(x).hexdigest() for x in back]), pc.equal(pa.array(back, pa.binary()), texts.cast(pa.binary()))]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return base.mapInArrow(work, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
