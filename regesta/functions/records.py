"""Predicates, cleaners and keys of records as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kin words -> (type, direction); the order tells widows from wives.
KIN = (("widow", "spouse", "of"), ("wife", "spouse", "both"), ("son", "child", "of"), ("father", "child", "from"), ("brother", "sibling", "both"), ("guardian", "ward", "from"))


def is_name_like(text: Column, stop: list[str]) -> Column:
    """Two letters or more once signs at the ends are gone, and no stop word as a whole."""
    bare = F.lower(F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return (F.length(bare) >= 2) & ~bare.isin(stop)


def kin(trigger: Column) -> Column:
    """type:direction of the first kin word in a trigger, NULL without one."""
    out = None
    for word, kind, way in KIN:
        value = F.lit(f"{kind}:{way}")
        out = F.when(F.contains(F.lower(trigger), F.lit(word)), value) if out is None else out.when(F.contains(F.lower(trigger), F.lit(word)), value)
    return out


def split_name(name: Column, particles: list[str]) -> Column:
    """struct(given, surname): the last word is the surname, particles belong to none."""
    words = F.filter(F.split(F.trim(name), " +"), lambda w: ~F.lower(w).isin(particles))
    return F.struct(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("given"), F.element_at(words, -1).alias("surname"))


def surname_key(surname: Column, canon: dict[str, str]) -> Column:
    """Lower case, spelling variants to one, a genitive s dropped from words of five letters or more."""
    low = F.regexp_replace(F.regexp_replace(F.lower(surname), "[^a-z]", ""), "(ck|kk)", "k")
    low = F.when((F.length(low) >= 5) & low.endswith("s"), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in canon.items() for x in kv])[low], low)


def bio_years(birth: Column, death: Column, other_birth: Column, other_death: Column, least: int = 15) -> Column:
    """struct(b, d): reversed years swapped; a life under least years is replaced by the other source's, if it has one."""
    b = F.when(birth > death, death).otherwise(birth)
    d = F.when(birth > death, birth).otherwise(death)
    short = F.coalesce((d - b) < least, F.lit(False)) & (other_birth.isNotNull() | other_death.isNotNull())
    return F.struct(F.when(short, other_birth).otherwise(b).alias("b"), F.when(short, other_death).otherwise(d).alias("d"))


def year_range(text: Column) -> Column:
    """struct(first, last) of the first range of years; a short end year takes the century of the first, or the next."""
    first = F.regexp_extract(text, r"([0-9]{4})[-/]([0-9]{2,4})", 1).try_cast("int")
    tail = F.regexp_extract(text, r"([0-9]{4})[-/]([0-9]{2,4})", 2)
    short = tail.try_cast("int")
    scale = F.pow(F.lit(10), F.length(tail)).cast("int")
    full = F.when(F.length(tail) == 4, short).otherwise(F.floor(first / scale).cast("int") * scale + short)
    last = F.when(full < first, full + scale).otherwise(full)
    return F.struct(F.when(last - first <= 110, first).alias("first"), F.when(last - first <= 110, last).alias("last"))


def fits(first: Column, last: Column, birth: Column, death: Column, before: int = 5, after: int = 15) -> Column:
    """Whether mentions of first..last fit a life; open ends fit."""
    return F.coalesce(first >= birth - before, F.lit(True)) & F.coalesce(last <= death + after, F.lit(True))


def extra(first: Column, last: Column, birth: Column, death: Column) -> Column:
    """Years by which the mentions reach beyond the life."""
    return F.coalesce(F.greatest(birth - first, F.lit(0)), F.lit(0)) + F.coalesce(F.greatest(last - death, F.lit(0)), F.lit(0))


def lv95_to_wgs84(east: Column, north: Column) -> Column:
    """struct(lat, lon) by the approximation polynomial that the Swiss survey office publishes."""
    y, x = (east - 2600000) / 1000000, (north - 1200000) / 1000000
    # fixed values: the coefficients of the published formula
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return F.struct((lat * 100 / 36).alias("lat"), (lon * 100 / 36).alias("lon"))


def first_with_source(*named: tuple[str, Column]) -> Column:
    """struct(value, source): the first value that isn't empty and where it came from."""
    value = source = None
    for label, column in named:
        there = F.coalesce(column.cast("string"), F.lit("")) != ""
        value = F.when(there, column) if value is None else value.when(there, column)
        source = F.when(there, F.lit(label)) if source is None else source.when(there, F.lit(label))
    return F.struct(value.alias("value"), source.alias("source"))


def relevance(term: str, head: Column, *rest: Column) -> Column:
    """0 equal, 1 begins with, 2 holds the term, 3 another field holds it, NULL no hit."""
    low = F.lower(head)
    out = F.when(low == term, 0).when(low.startswith(term), 1).when(low.contains(term), 2)
    for x in rest:
        out = out.when(F.lower(x).contains(term), 3)
    return out
