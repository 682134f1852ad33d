"""Names into persons: merges within a dossier, runs with bare names attached, merges across dossiers.

The rules look at earlier decisions, so a group (a dossier, a name within it, a key) is folded in one task. Groups are
independent, dealt by their key and sorted, and a task folds all of its groups in one pass over its Arrow batches: a call
a group would cost more than the rules where groups are small. Only the columns the rules need travel.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.similar import like_token

LIFE, SILENCE = 80, 15


def folded(rows: DataFrame, keys: list[str], name: str, kind: T.DataType, fold: Callable[..., list], args: list[str]) -> DataFrame:
    """rows with a column name: fold takes the lists of args of a group and gives its values. rows: dealt by keys and
    sorted by them, then in the order the fold wants."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def close(pieces: list[pa.RecordBatch], cuts: list[int]) -> pa.RecordBatch:
        table = pa.Table.from_batches(pieces).combine_chunks()
        lists, out = [table.column(c).to_pylist() for c in args], []
        for lo, hi in zip([0, *cuts], [*cuts, table.num_rows]):
            out += fold(*[x[lo:hi] for x in lists])
        batch = table.to_batches()[0]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, to_arrow_type(kind))], [*batch.schema.names, name])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None  # the batches of the group that is still open
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            if held and groups[0] != key:
                yield close(held, [])
                held = []
            key = groups[-1]
            cuts = [i for i in range(1, len(groups)) if groups[i] != groups[i - 1]]
            if cuts:
                before = sum(b.num_rows for b in held)
                yield close([*held, batch.slice(0, cuts[-1])], [before + i for i in cuts[:-1]])
                held, batch = [], batch.slice(cuts[-1])
            held.append(batch)
        if held:
            yield close(held, [])

    return rows.mapInArrow(run, f"{fields}, `{name}` {kind.simpleString()}")


@lru_cache(200_000)
def words(name: str) -> list[str]:
    return [w for w in "".join(x if x.isalnum() or x == " " else "" for x in name.lower()).split() if len(w) > 1 and w != "unk"]


def merge(names: list[str], lo: list[int | None], hi: list[int | None], life: int) -> list[str]:
    """What each name of a dossier (distinct ones) is merged into."""
    if len(names) == 1:
        return names
    mine, into, place = [words(n) for n in names], list(range(len(names))), range(len(names))

    def root(i: int) -> int:
        while into[i] != i:
            i = into[i]
        return i

    for i in sorted(place, key=lambda i: (-len(mine[i]), names[i])):
        fuller = []
        for j in place if mine[i] else ():
            if j != i and all(any(like_token(t, u) for u in mine[j]) for t in mine[i]):
                fuller.append(j)
                if len(fuller) > 1:
                    break
        if len(fuller) == 1:
            known = [y for j in (i, fuller[0]) for y in (lo[j], hi[j]) if y is not None]
            if not known or max(known) - min(known) <= life:
                a, b = root(i), root(fuller[0])
                into[a] = b
    return [names[root(i)] for i in place]


def merged_names(rows: DataFrame, life: int = LIFE) -> DataFrame:
    """dossier, name, merged: a name joins a fuller one if it is the only one of the dossier that has all its words, and
    both names' years lie within a life. rows: dossier, name, year."""
    named = rows.where("name is not null").select("dossier", "name", "year").repartition("dossier")
    years = named.groupBy("dossier", "name").agg(F.min("year").alias("lo"), F.max("year").alias("hi")).sortWithinPartitions("dossier", "name")
    return folded(years, ["dossier"], "merged", T.StringType(), lambda n, lo, hi: merge(n, lo, hi, life), ["name", "lo", "hi"]).select("dossier", "name", "merged")


def attach(years: list[int | None], bare: list[bool], life: int, silence: int) -> list[str]:
    """The run of each row of a group in order of years, the unknown ones last."""

    def cut(at: list[int], gap: int | None) -> list[int]:
        out, run, start, last = [], 0, None, None
        for i in at:
            y = years[i]
            if start is None or y - start > life or (gap is not None and y - last >= gap):
                run, start = run + 1, y
            out.append(run)
            last = y
        return out

    run = ["b0" if b else "f0" for b in bare]
    full = [i for i, y in enumerate(years) if y is not None and not bare[i]]
    anchors: list[list[int]] = []  # the years of each run, ascending, and so are the runs
    for i, k in zip(full, cut(full, None)):
        run[i] = f"f{k}"
        if k > len(anchors):
            anchors.append([])
        anchors[-1].append(years[i])
    first, last = [v[0] for v in anchors], [v[-1] for v in anchors]
    span, left = [[v[0], v[-1]] for v in anchors], []
    for i, y in enumerate(years):
        if y is None or not bare[i]:
            continue
        best = None
        for k in range(bisect_right(last, y - silence), bisect_left(first, y + silence)):  # runs with years that may be near
            at = bisect_left(anchors[k], y)
            far = min(abs(y - a) for a in anchors[k][max(at - 1, 0) : at + 1])
            if far < silence and max(span[k][1], y) - min(span[k][0], y) <= life and (best is None or far < best[0]):
                best = far, k
        if best is None:
            left.append(i)
        else:
            k = best[1]
            run[i], span[k] = f"f{k + 1}", [min(span[k][0], y), max(span[k][1], y)]
    for i, k in zip(left, cut(left, silence)):
        run[i] = f"b{k}"
    return run


def attached_runs(rows: DataFrame, keys: list[str], life: int = LIFE, silence: int = SILENCE) -> DataFrame:
    """rows (keys, id, year, bare) with run. Full names form runs of a life at most, counted from a run's start; a bare
    name joins the run with the nearest full name under silence years away if the run stays within a life; the others
    form runs of their own, cut also at silences. Rows without a year are run 0 of their kind."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("year"), F.asc_nulls_last("id"))
    return folded(dealt, keys, "run", T.StringType(), lambda y, b: attach(y, b, life, silence), ["year", "bare"])


def across(ids: list, y0: list[int], y1: list[int], dead: list[int | None], living: list[list[int]], life: int) -> list:
    """The person of each entry of a key, in order."""
    who, first, lo, hi, death, alive = [], None, None, None, None, None
    for i, a, b, d, years in zip(ids, y0, y1, dead, living):
        lives = max(years) if years else None
        if first is not None:
            late = death is not None and lives is not None and lives > death
            early = d is not None and alive is not None and alive > d
            known = [y for y in (lo, hi, a, b) if y is not None]
            if (known and max(known) - min(known) > life) or late or early:
                who.append(i)
                continue
        first = i if first is None else first
        lo, hi = min((y for y in (lo, a) if y is not None), default=None), max((y for y in (hi, b) if y is not None), default=None)
        death = d if death is None else death if d is None else min(death, d)
        alive = lives if alive is None else alive if lives is None else max(alive, lives)
        who.append(first)
    return who


def across_dossiers(entries: DataFrame, life: int = LIFE) -> DataFrame:
    """key, id, person: entries of a key in order of first year and death; each joins the key's person unless the years
    would pass a life, or a living mention would follow a death on either side. One refused stays alone for good.
    entries: key, id, y0, y1, dead (first year named dead), living (array of years)."""
    needed = entries.select("key", "id", "y0", "y1", "dead", "living")
    dealt = needed.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("y0"), F.coalesce("dead", F.lit(9999)), F.asc_nulls_last("id"))
    return folded(dealt, ["key"], "person", entries.schema["id"].dataType, lambda *x: across(*x, life), ["id", "y0", "y1", "dead", "living"]).select("key", "id", "person")
