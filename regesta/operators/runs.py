"""Runs of years: by gap, and with a cap counted from the run's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_runs(df: DataFrame, keys: list[str], year: str, gap: int, order: list[str]) -> DataFrame:
    """df with run: a new one begins after a gap of gap years or more. NULL years are a run of their own (0)."""
    by = W.partitionBy(*keys).orderBy(F.col(year).asc_nulls_last(), *order)
    step = F.col(year) - F.lag(year).over(by)
    marked = df.withColumn("new_", F.when(step.isNull() | (step >= gap), 1).otherwise(0))
    return marked.withColumn("run", F.when(F.col(year).isNull(), 0).otherwise(F.sum("new_").over(by.rowsBetween(W.unboundedPreceding, 0)))).drop("new_")


def anchored_runs(years: Column, cap: int, gap: int | None = None) -> Column:
    """Starts of the runs of an ascending array: a run ends when a year lies more than cap after its start, or gap or
    more after the year before. A fold over the array, inside the row."""
    far = lambda acc, y: (y - acc["start"] > cap) | (F.lit(False) if gap is None else y - acc["last"] >= gap)
    zero = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, y: F.when(
        acc["start"].isNull() | far(acc, y), F.struct(y.alias("start"), y.alias("last"), F.concat(acc["starts"], F.array(y)).alias("starts"))
    ).otherwise(F.struct(acc["start"].alias("start"), y.alias("last"), acc["starts"].alias("starts")))
    return F.aggregate(years, zero, step, lambda acc: acc["starts"])


def death_split(df: DataFrame, keys: list[str], year: str, dead: str) -> DataFrame:
    """df with part: 1 for living mentions strictly after the first deceased one of their keys, else 0."""
    first = F.min(F.when(F.col(dead), F.col(year))).over(W.partitionBy(*keys))
    return df.withColumn("part", F.when(~F.col(dead) & (F.col(year) > first), 1).otherwise(0))
