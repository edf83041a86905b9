"""Ranking, top lists, modes, bands and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import rounded
from fieldbook.session import settled


def dense_index(df: DataFrame, order: Sequence[str | Column], into: str, parts: int | None = None) -> DataFrame:
    """Numbers the rows from 0 in a total order, without one task that sorts them all.

    Rows are dealt by range, numbered within their range, and shifted by the sizes of the ranges before. The range of a row is
    settled before it is counted, since range bounds come from a sample.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_i", F.row_number().over(within) - 1).join(F.broadcast(bases), "_part").withColumn(into, (F.col("_base") + F.col("_i")).cast("bigint")).drop("_part", "_i", "_base")


def running_total(df: DataFrame, order: Sequence[str], amount: str, into: str, small: int = 50_000) -> DataFrame:
    """Adds the sum of `amount` over the rows before, in a total order.

    Up to `small` rows, which is checked, one window does; beyond, rows are dealt by range, summed within their range, and shifted by
    the sums of the ranges before.
    """
    held = settled(df)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if held.count() <= small:
        return held.withColumn(into, before(Window.partitionBy(F.lit(0)).orderBy(*order), amount))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(held.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    bases = sums.select("_part", before(Window.partitionBy(F.lit(0)).orderBy("_part"), "_sum").alias("_base"))  # as many rows as partitions
    within = dealt.withColumn("_i", before(Window.partitionBy("_part").orderBy(*order), amount))
    return within.join(F.broadcast(bases), "_part").withColumn(into, F.col("_base") + F.col("_i")).drop("_part", "_i", "_base")


def quantiles(df: DataFrame, value: str, cuts: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """(group, edges): exact quantiles of each group (all rows without one), interpolated between neighbours; nulls don't count.

    Equal values are counted first, and their places follow from a running total, so no task holds a whole column.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_total(sizes, [*group, "_v"], "_n", "_before")
    ends = placed.groupBy(*group).agg(F.min("_before").alias("_first"), F.sum("_n").alias("_all"))
    wanted = ends.select(*group, F.posexplode(F.array(*map(F.lit, cuts))).alias("_k", "_cut"), "_first", "_all").withColumn("_at", F.col("_cut") * (F.col("_all") - 1))
    met = placed.join(wanted, list(group)) if group else placed.crossJoin(F.broadcast(wanted))
    place = F.col("_before") - F.col("_first")
    holds = lambda at: (place <= at) & (at < place + F.col("_n"))
    low, high = F.floor("_at"), F.ceil("_at")
    ends = met.where(holds(low) | holds(high)).groupBy(*group, "_k", "_at").agg(F.max(F.when(holds(low), F.col("_v"))).alias("_l"), F.max(F.when(holds(high), F.col("_v"))).alias("_h"))
    edge = F.when(F.ceil("_at") == F.floor("_at"), F.col("_l")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_l") + (F.col("_at") - F.floor("_at")) * F.col("_h"))
    own = ends.select(*group, F.struct("_k", edge.alias("e")).alias("_x"))
    return own.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["e"]).alias("edges"))  # an entry for each cut


def surrogate_ids(df: DataFrame, key: Sequence[str], into: str, template: str) -> DataFrame:
    """Dense ids from 1 in the order of the key, rendered by a template."""
    return dense_index(df, key, "_id").withColumn(into, F.format_string(template, F.col("_id") + 1)).drop("_id")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties to the smaller."""
    return df.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(n).select(column)


def topn_bucket(df: DataFrame, column: str, n: int, other: str = "OTHER", into: str | None = None) -> DataFrame:
    """Keeps the n most frequent values, the rest become `other`. The kept list has n rows, so it is broadcast."""
    kept = top_values(df, column, n).withColumn("_kept", F.lit(True))
    return df.join(F.broadcast(kept), column, "left").withColumn(into or column, F.when(F.col("_kept"), F.col(column)).otherwise(other)).drop("_kept")


def topk_per_group(df: DataFrame, group: Sequence[str], value: str, by: str, k: int) -> DataFrame:
    """The k values with the largest totals in each group, ties to the smaller value; adds total and rank."""
    total = df.groupBy(*group, value).agg(F.sum(by).alias("total"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("total"), value))).where(F.col("rank") <= k)


def argmax_per_group(df: DataFrame, group: Sequence[str], value: str, by: str) -> DataFrame:
    """The value with the largest total in each group, ties to the smaller value."""
    total = df.groupBy(*group, value).agg(F.sum(by).alias("total"))
    # The smallest of (-total, value) is one aggregate, without a sort.
    return total.groupBy(*group).agg(F.min(F.struct((-F.col("total")).alias("t"), F.col(value).alias("v"))).alias("m")).select(*group, F.col("m.v").alias(value), (-F.col("m.t")).alias("total"))


def mode_per_group(df: DataFrame, group: Sequence[str], value: str, stop: Sequence[str] = (), none: str | None = None) -> DataFrame:
    """Most frequent value of each group but those on the stop list, ties to the smaller; `none` where nothing is left."""
    kept = df.where(~F.col(value).isin(*stop)) if stop else df
    counts = kept.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    mode = counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(*group, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))
    if none is None:
        return mode
    return df.select(*group).distinct().join(mode, list(group), "left").select(*group, F.coalesce(value, F.lit(none)).alias(value), F.coalesce("n", F.lit(0)).alias("n"))


def purity(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the rows of each group that have the group's mode."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(rounded(F.max("n").cast("double") / F.sum("n")).alias("purity"))


def quantile_breaks(df: DataFrame, value: str, classes: int) -> DataFrame:
    """One row with `breaks`: the values at floor(i / classes * rows) of the sorted column, i from 1."""
    numbered = dense_index(df.select(F.col(value).alias("_v")).where("_v is not null"), ["_v"], "_at")
    n = numbered.agg(F.count("*").alias("_all"))
    wanted = n.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(classes - 1)), lambda i: F.floor(i / classes * F.col("_all")))).alias("_at"))
    return numbered.join(F.broadcast(wanted), "_at").agg(F.array_sort(F.collect_list("_v")).alias("breaks"))


def quantile_class(df: DataFrame, value: str, classes: int, into: str) -> DataFrame:
    """Number of breaks below the value."""
    breaks = quantile_breaks(df, value, classes)
    return df.crossJoin(F.broadcast(breaks)).withColumn(into, F.size(F.filter("breaks", lambda b: b < F.col(value)))).drop("breaks")


def tiers(df: DataFrame, value: str, cuts: Sequence[float], names: Sequence[str], into: str) -> DataFrame:
    """Bands by exact quantiles, right-closed, the lowest value included."""
    edges = quantiles(df, value, cuts)
    band = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        band = F.when(F.col(value) <= F.get("edges", F.lit(i)), names[i]).otherwise(band)
    return df.crossJoin(F.broadcast(edges)).withColumn(into, band).drop("edges")


def log_index(df: DataFrame, value: str, into: str, low: float = 8.0, span: float = 92.0, flat: float = 54.0) -> DataFrame:
    """low + span * position of log1p(value) between the smallest and the largest; `flat` if they are equal."""
    ends = df.agg(F.log1p(F.min(value).cast("double")).alias("_lo"), F.log1p(F.max(value).cast("double")).alias("_hi"))
    place = F.when(F.col("_hi") == F.col("_lo"), flat).otherwise(low + span * (F.log1p(F.col(value).cast("double")) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(F.broadcast(ends)).withColumn(into, place).drop("_lo", "_hi")


def rank_of(df: DataFrame, entity: str, metric: str, wanted: str) -> DataFrame:
    """1-based rank of one entity: one more than the rows that come before it, ties by entity. No sort at all."""
    one = df.where(F.col(entity) == wanted).select(F.col(metric).alias("_m")).limit(1)
    ahead = df.crossJoin(F.broadcast(one)).where((F.col(metric) > F.col("_m")) | ((F.col(metric) == F.col("_m")) & (F.col(entity) < wanted)))
    return ahead.agg((F.count("*") + 1).alias("rank")).select(F.lit(wanted).alias(entity), "rank")


def sort_page(df: DataFrame, sort: str, allowed: Sequence[str], tie: str, limit: object, offset: int = 0, most: int = 500, default: int = 50) -> DataFrame:
    """A page in descending order of a whitelisted key (the first if it isn't one); the limit is clamped to 1 to `most`."""
    key = sort if sort in allowed else allowed[0]
    return df.orderBy(F.desc(key), tie).offset(max(0, offset)).limit(clamp(limit, most, default))


def clamp(limit: object, most: int, default: int) -> int:
    try:
        n = int(float(limit))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return default
    return max(1, min(most, n))


def topn_cap(df: DataFrame, by: str, tie: Sequence[str], cap: int) -> DataFrame:
    """The largest `cap` rows; `capped` tells whether there were more."""
    total = df.agg((F.count("*") > cap).alias("capped"))
    return df.orderBy(F.desc(by), *tie).limit(cap).crossJoin(F.broadcast(total))


def topk_overlap(a: DataFrame, b: DataFrame, key: str, by: str, k: int = 5) -> DataFrame:
    """How many keys two top-k lists share."""
    top = lambda df: df.orderBy(F.desc(by), key).limit(k).select(key)
    return top(a).join(top(b), key).agg(F.count("*").alias("shared"))


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same rows on every run and layout."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *key)).orderBy("_h", *key).limit(n).drop("_h")


def _hash_rank(df: DataFrame, label: str, key: Sequence[str], seed: int, into: str) -> DataFrame:
    """Place of each row in its label by hash order, from 0. A label may hold most rows, so it is counted in slices of the hash."""
    h = df.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_s", F.shiftright("_h", 58).cast("int"))  # 64 slices
    sizes = h.groupBy(label, "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows a label
    bases = sizes.select(label, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(label, "_s").orderBy("_h", *key)
    return h.withColumn("_i", F.row_number().over(within) - 1).join(bases, [label, "_s"]).withColumn(into, F.col("_base") + F.col("_i")).drop("_h", "_s", "_i", "_base")


def stratified_sample(df: DataFrame, label: str, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """max(1, round(n * size of the label / all)) rows of each label, exactly, by hash order."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    total = df.agg(F.count("*").alias("_all"))
    want = sizes.crossJoin(F.broadcast(total)).select(label, F.greatest(F.lit(1), F.round(F.lit(n) * F.col("_size") / F.col("_all"))).alias("_want"))
    return _hash_rank(df, label, key, seed, "_at").join(want, label).where("_at < _want").drop("_at", "_want")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], folds: int, seed: int = 42, into: str = "fold") -> DataFrame:
    """Fold numbers that deal every label evenly."""
    return _hash_rank(df, label, key, seed, "_at").withColumn(into, (F.col("_at") % folds).cast("int")).drop("_at")


def grid_peak(df: DataFrame, row: str, rows: int, column: str, columns: int, value: str) -> DataFrame:
    """The full rows x columns grid (from 0 and from 1), zero-filled, and which cell, row and column are largest; the first of equals wins."""
    spark = df.sparkSession
    spine = spark.range(rows).select(F.col("id").cast("int").alias(row)).crossJoin(spark.range(1, columns + 1).select(F.col("id").cast("int").alias(column)))
    got = df.groupBy(row, column).agg(F.sum(value).alias("n"))
    full = spine.join(got, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = lambda by: F.min(F.struct((-F.col("n")).alias("n"), *by))
    cell = full.agg(first([row, column]).alias("c")).select(F.col(f"c.{row}").alias(f"peak_{row}"), F.col(f"c.{column}").alias(f"peak_{column}"), (-F.col("c.n")).alias("peak_n"))
    one = full.groupBy(row).agg(F.sum("n").alias("n")).agg(first([row]).alias("c")).select(F.col(f"c.{row}").alias(f"top_{row}"))
    two = full.groupBy(column).agg(F.sum("n").alias("n")).agg(first([column]).alias("c")).select(F.col(f"c.{column}").alias(f"top_{column}"))
    return full.crossJoin(F.broadcast(cell)).crossJoin(F.broadcast(one)).crossJoin(F.broadcast(two))
