"""Joins in which a few keys may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of all rows, so there are no more hot keys than its inverse.
HOT_SHARE, LEAST_HOT = 0.001, 1000


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys that hold more than a thousandth of the rows, and at least LEAST_HOT: a thousand keys at most. df is read twice, so it should be settled."""
    n = df.count()
    if n <= LEAST_HOT:
        return []
    least = max(LEAST_HOT, int(n * HOT_SHARE))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_times")).where(F.col("_times") > least)
    return [r[0] for r in counts.select(key).collect()]


def spread_join(df: DataFrame, facts: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """df joined with facts, which has one row for each key, inner or left. Rows of hot keys stay where they are and meet their facts by
    a broadcast, whose rows are as few as the hot keys; the others are shuffled by key."""
    if not hot:
        return df.join(facts, key, how)
    of_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return df.where(of_hot).join(F.broadcast(facts.where(F.col(key).isin(hot))), key, how).unionByName(df.where(~of_hot).join(facts, key, how))
