"""Likeness of names: sound codes as Column expressions, matching-block ratios as Arrow-batched functions."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import strip_accents


def sound_code(name: Column) -> Column:
    """Cologne phonetics: a digit for each letter by its neighbours, runs of a digit once, zeros only at the start."""
    letters = F.filter(F.split(F.regexp_replace(strip_accents(name), "[^a-z]", ""), ""), lambda x: x != "")

    def digits(seq: Column) -> Column:
        def digit(x: Column, i: Column) -> Column:
            after, before = F.coalesce(F.get(seq, i + 1), F.lit("~")), F.coalesce(F.get(seq, i - 1), F.lit("~"))
            hard = F.when(i == 0, after.isin(*"ahkloqrux")).when(before.isin("s", "z"), F.lit(False)).otherwise(after.isin(*"ahkoqux"))
            return (
                F.when(x.isin(*"aeijouy"), "0").when(x == "b", "1").when(x == "p", F.when(after == "h", "3").otherwise("1"))
                .when(x.isin("d", "t"), F.when(after.isin(*"csz"), "8").otherwise("2")).when(x.isin(*"fvw"), "3").when(x.isin(*"gkq"), "4")
                .when(x == "c", F.when(hard, "4").otherwise("8")).when(x == "x", F.when(before.isin(*"ckq"), "8").otherwise("48"))
                .when(x == "l", "5").when(x.isin("m", "n"), "6").when(x == "r", "7").when(x.isin("s", "z"), "8").otherwise("")
            )

        return F.regexp_replace(F.array_join(F.transform(seq, digit), ""), r"(.)\1+", "$1")

    code = F.transform(F.array(letters), digits)[0]
    return F.concat(F.substring(code, 1, 1), F.replace(F.substring(code, 2, 1_000_000), F.lit("0"), F.lit("")))


@lru_cache(200_000)
def ratio_of(a: str, b: str) -> float:
    """1 for equal names, 0 for empty ones or other first letters, else the share of matching blocks."""
    if a == b:
        return 1.0
    return SequenceMatcher(None, a, b).ratio() if a and b and a[0] == b[0] else 0.0


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio_of(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def like_token(a: str, b: str, least: float = 0.82) -> bool:
    return a == b or bool(a and b) and abs(len(a) - len(b)) <= 3 and ratio_of(a, b) >= least


@F.pandas_udf(T.DoubleType())
def given_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of the given names that both lists (words joined by blanks) have a place for; 0 without any."""

    def one(x: str | None, y: str | None) -> float:
        pairs = list(zip((x or "").split(), (y or "").split()))
        return sum(ratio_of(p, q) for p, q in pairs) / len(pairs) if pairs else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def article_given_ratio(article: Column, register: Column) -> Column:
    """0 if the register has more given names than the article."""
    words = lambda x: F.size(F.filter(F.split(F.coalesce(x, F.lit("")), " "), lambda w: w != ""))
    return F.when(words(register) > words(article), F.lit(0.0)).otherwise(given_ratio(article, register))


def years_align(a0: Column, a1: Column, b0: Column, b1: Column, gap: int) -> Column:
    """Whether two spans lie at most gap years apart; NULL if one is unknown."""
    return F.when(a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull(), (a0 <= b1 + gap) & (b0 <= a1 + gap))
