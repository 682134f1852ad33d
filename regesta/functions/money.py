"""Money in free text: number-unit pairs, and a parse of the first pair of each part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR = r"(\d+(?:\.\d+)?) (pound|shilling|penny)"
RATES = {"pound": 20.0, "shilling": 1.0, "penny": 1 / 12}


def rate(unit: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])[unit]


def total(text: Column) -> Column:
    """Sum of all pairs in shillings, NULL without a pair."""
    amounts = F.regexp_extract_all(text, F.lit(PAIR), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(PAIR), F.lit(2))
    parts = F.zip_with(amounts, units, lambda a, u: a.cast("double") * rate(u))
    return F.when(F.size(amounts) > 0, F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x))


def first_of_parts(text: Column) -> Column:
    """Sum over the |-parts of the first pair of each."""
    one = lambda p: F.coalesce(F.regexp_extract(p, PAIR, 1).try_cast("double") * rate(F.regexp_extract(p, PAIR, 2)), F.lit(0.0))
    return F.aggregate(F.transform(F.split(text, r"\|"), one), F.lit(0.0), lambda acc, x: acc + x)
