"""Life dates: bounds, conflicts of mentions, relation of a life to a span of mentions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADULT, NAMED_AFTER, POST_MORTEM, TOLERANCE = 14, 15, 60, 1
LONGEST, BEFORE_BIRTH, AFTER_DEATH, DEFAULT_LIFE = 95, 5, 15, 90


def bounds(birth: Column, death: Column) -> Column:
    """struct(blo, bhi, dlo, dhi); a missing date is bounded by the other one."""
    return F.struct(
        F.coalesce(birth, death - 100).alias("blo"),
        F.coalesce(birth, death - ADULT).alias("bhi"),
        F.coalesce(death, birth + ADULT).alias("dlo"),
        F.coalesce(death, birth + LONGEST).alias("dhi"),
    )


def conflict(life: Column, year: Column, late: Column, strong: Column, past: Column | None = None) -> Column:
    """The first rule that a mention breaks, NULL if none. late: called deceased; strong: acts in person; past: named
    in a role of the past, which doesn't count as living."""
    b, d = life["blo"], life["dhi"]
    living = ~late if past is None else ~late & ~past
    return (
        F.when(year < b, "before_birth")
        .when(strong & ~late & (year < b + ADULT), "child")
        .when(late & (year < life["dlo"] - TOLERANCE), "dead_early")
        .when(year > d + POST_MORTEM, "beyond")
        .when(strong & ~late & (year > d + TOLERANCE), "after_death")
        .when(living & (year > d + NAMED_AFTER), "late_naming")
    )


def relation(birth: Column, death: Column, first: Column, last: Column) -> Column:
    """overlap, postmortem or NULL for a life against first..last."""
    b = F.coalesce(birth, death - DEFAULT_LIFE)
    d = F.coalesce(death, birth + DEFAULT_LIFE)
    return F.when((first <= d + AFTER_DEATH) & (last >= b - BEFORE_BIRTH), "overlap").when((first > d) & (first <= d + POST_MORTEM), "postmortem")


def year_of(text: Column) -> Column:
    """The first run of three or four digits that no digit or X follows."""
    return F.regexp_extract(text, r"(?<!\d)(\d{3,4})(?![\dXx])", 1).try_cast("int")
