"""Correlation, rank tests, errors and verdicts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.scalars import rounded
from fieldbook.operators.joins import rank_window
from fieldbook.operators.ranking import topk_overlap


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz recurrence."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_two_sided(r: float | None, n: int | None) -> float | None:
    """Two-sided p of a correlation r of n pairs, by the t distribution with n - 2 degrees of freedom."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    x = 1 - r * r  # df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a if 0 < x else 0.0
    return 1 - front * _beta_fraction(b, a, 1 - x) / b if x < 1 else 1.0


def with_p(df: DataFrame, r: str, n: str, into: str = "p") -> DataFrame:
    """Adds p to a small table of correlations."""
    from fieldbook.session import ship

    ship(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(parts):
        for pdf in parts:
            yield pdf.assign(**{into: pd.Series([t_two_sided(None if pd.isna(a) else float(a), int(b)) for a, b in zip(pdf[r], pdf[n], strict=True)], dtype=float)})

    return df.mapInPandas(run, f"{kinds}, `{into}` double")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, r, t and two-sided p, significant below 0.05."""
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    got = kept.agg(F.count("*").alias("n"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("_r"))
    t = F.col("_r") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - F.col("_r") * F.col("_r")))
    out = with_p(got.withColumns({"r": rounded(F.col("_r"), 6), "t": rounded(t)}), "_r", "n").drop("_r")
    return out.withColumn("significant", F.col("p") < 0.05)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n and the Pearson correlation of average ranks."""
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = rank_window(rank_window(kept, "_x", "rx"), "_y", "ry")
    return ranked.agg(F.count("*").alias("n"), rounded(F.corr("rx", "ry"), 6).alias("rho"))


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Correlation of x and y with z held fixed."""
    c = lambda a, b: F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
    got = df.agg(c(x, y).alias("xy"), c(x, z).alias("xz"), c(y, z).alias("yz"))
    return got.select(rounded(F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))), 6).alias("partial_r"))


def corr_table(df: DataFrame, target: str, indicators: Sequence[str], protected: Sequence[str]) -> DataFrame:
    """Per indicator: n, r, strength, direction and whether it is protected, for all indicators in one pass."""
    pair = F.explode(F.array(*(F.struct(F.lit(i).alias("indicator"), F.col(i).cast("double").alias("x")) for i in indicators)))
    long = df.select(F.col(target).cast("double").alias("y"), pair.alias("p")).select("y", "p.*").where("x is not null and y is not null")
    got = long.groupBy("indicator").agg(F.count("*").alias("n"), rounded(F.corr("x", "y"), 6).alias("r"))
    a = F.abs("r")
    strength = F.when(a >= 0.7, "strong").when(a >= 0.5, "moderate").when(a >= 0.3, "weak").otherwise("negligible")
    return got.select("indicator", "n", "r", strength.alias("strength"), F.when(F.col("r") < 0, "negative").otherwise("positive").alias("direction"), F.col("indicator").isin(*protected).alias("is_protected"))


def split_share(df: DataFrame, key: str, split: str, part: str, value: str) -> DataFrame:
    """Share of a key's value in the rows with one split value."""
    return df.groupBy(key).agg(F.coalesce(rounded(F.try_divide(F.sum(F.when(F.col(split) == part, F.col(value)).otherwise(0)).cast("double"), F.sum(value).cast("double"))), F.lit(0.0)).alias("share"))


def mape(actual: Column, forecast: Column) -> Column:
    """Aggregate: mean absolute percentage error where the actual is above 0."""
    return F.avg(F.when(actual > 0, F.abs(actual - forecast) / actual))


def verdict(ours: Column, baseline: Column, tolerance: float, higher_is_better: bool = True) -> Column:
    gain = (ours - baseline) if higher_is_better else (baseline - ours)
    return F.when(gain > tolerance, "beats").when(gain >= -tolerance, "matches").otherwise("below")


def rank_validation(ranking: DataFrame, actual: DataFrame, naive: DataFrame, key: str, k: int = 5, tolerance: float = 0.01) -> DataFrame:
    """rho and top-k overlap of a ranking and of a naive one against what happened; each table has (key, value)."""

    def against(df: DataFrame, name: str) -> DataFrame:
        j = df.select(key, F.col("value").alias("x")).join(actual.select(key, F.col("value").alias("y")), key)
        top = topk_overlap(df.select(key, "value"), actual.select(key, "value"), key, "value", k)
        return spearman(j, "x", "y").crossJoin(top).select(F.lit(name).alias("ranking"), "n", "rho", "shared")

    both = settled_pair(against(ranking, "ours"), against(naive, "naive"))
    return both.withColumn("verdict", verdict(F.col("rho"), F.col("naive_rho"), tolerance))


def settled_pair(ours: DataFrame, naive: DataFrame) -> DataFrame:
    """Two one-row results side by side."""
    return ours.select("n", "rho", "shared").crossJoin(naive.select(F.col("rho").alias("naive_rho"), F.col("shared").alias("naive_shared")))


def average_rank_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """n, positives, AUC by average ranks, accuracy and F1 at 0.5."""
    ranked = rank_window(df.select(F.col(label).cast("int").alias("_l"), F.col(score).cast("double").alias("_s")).where("_l is not null and _s is not null"), "_s", "_rank")
    hit = (F.col("_s") >= 0.5).cast("int")
    got = ranked.agg(F.count("*").alias("n"), F.sum("_l").alias("n_positive"), F.sum(F.when(F.col("_l") == 1, F.col("_rank"))).alias("_r"), F.sum(F.when(F.col("_l") == hit, 1).otherwise(0)).alias("_hits"), F.sum(hit).alias("_said"), F.sum(hit * F.col("_l")).alias("_tp"))
    pos, neg = F.col("n_positive").cast("double"), (F.col("n") - F.col("n_positive")).cast("double")
    auc = F.try_divide(F.col("_r") - pos * (pos + 1) / 2, pos * neg)
    return got.select("n", "n_positive", rounded(auc, 6).alias("auc"), rounded(F.try_divide(F.col("_hits").cast("double"), F.col("n").cast("double")), 6).alias("accuracy"), F.coalesce(rounded(F.try_divide(2.0 * F.col("_tp"), (F.col("_said") + F.col("n_positive")).cast("double")), 6), F.lit(0.0)).alias("f1"))


def convergence(signals: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Groups by how many of their signals agree. Each table has (key, n, and for `tier`: tier_value).

    Signals are high tier, at least one red alert, at least one anomaly; priority = 100 * signals + 10 * tier + min(red, 9).
    """
    tier, red, odd = (signals[k] for k in ("tier", "red", "anomaly"))
    j = tier.select(key, F.col("n").alias("tier")).join(red.select(key, F.col("n").alias("n_red")), key, "full").join(odd.select(key, F.col("n").alias("n_anomalies")), key, "full")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("tier", "n_red", "n_anomalies")}
    j = j.withColumns(zero)
    one = lambda c: c.cast("int")
    n = one(F.col("tier") >= 2) + one(F.col("n_red") >= 1) + one(F.col("n_anomalies") >= 1)
    return j.withColumn("n_signals", n).withColumn("priority", (100 * F.col("n_signals") + 10 * F.col("tier") + F.least("n_red", F.lit(9))).cast("bigint")).withColumn("shortlisted", F.col("n_signals") == 3)
