"""How good a solution is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_means(df: DataFrame, factors: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Weighted mean of a column by every level of every factor, in one pass."""
    w: Column = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    cols = [F.col(f"`{f}`") for f in factors]
    sums = df.groupingSets([[c] for c in cols], *cols).agg(F.sum(w * F.col(f"`{value}`")).alias("__s"), F.sum(w).alias("__w"))
    return sums.select(*cols, (F.col("__s") / F.col("__w")).alias("mean"))


def max_abs_group_mean(df: DataFrame, factors: list[str], value: str = "demeaned", weight: str | None = None) -> DataFrame:
    """The largest mean, in absolute value, that a factor leaves."""
    return group_means(df, factors, value, weight).agg(F.max(F.abs("mean")).alias("max_abs_group_mean"))


def pivot_table(df: DataFrame, row: str, config: str, value: str) -> DataFrame:
    """One row for each problem, one column for each configuration."""
    return df.groupBy(row).pivot(config).agg(F.first(value))
