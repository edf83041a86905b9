"""Filters that must hold, and checks that raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.scalars import rounded


def precision_guard(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose tag is allowed; the filter itself is the assertion that none leaks, since null tags fail it too."""
    return df.where(F.col(column).isin(*allowed))


def feature_guard(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """df, if it holds none of the forbidden columns."""
    if found := sorted(set(df.columns) & set(forbidden)):
        raise ValueError(f"forbidden columns: {', '.join(found)}")
    return df


def period(year: str, month: str):
    """Months since year 0."""
    return F.col(year) * 12 + F.col(month) - 1


def train_window(df: DataFrame, year: str, month: str, end: int) -> DataFrame:
    """Rows up to the last month that may be learned from."""
    return df.where(period(year, month) <= end)


def min_support(df: DataFrame, by: Sequence[str], least: int, into: str = "n") -> DataFrame:
    """Counts of the groups with at least `least` rows."""
    return df.groupBy(*by).agg(F.count("*").alias(into)).where(F.col(into) >= least)


def leak_threshold(df: DataFrame, label: str, suspect: str, cut: float) -> DataFrame:
    """Mean of a suspect feature for each label, flagged above the cut."""
    return df.groupBy(label).agg(F.avg(suspect).alias("m")).select(label, rounded(F.col("m")).alias("mean"), (F.col("m") > cut).alias("leaks"))
