"""Joins in time and subtotals. Additions of this library; the surveyed product has none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.operators.ranking import running_total
from fieldbook.session import written


def whole_number(df: DataFrame, column: str) -> Column:
    """A time as a whole number: microseconds of a timestamp, days of a date, integers as they are."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(column))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    return (F.unix_date(column) if isinstance(kind, T.DateType) else F.col(column)).cast("bigint")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, take: Mapping[str, str], within: Column | None = None) -> DataFrame:
    """Each row of left with the last row of right that has its key and isn't later; `take` names right's columns and what they become.

    Both sides are dealt by ranges of (key, time), so a key may hold any part of the rows; the last value is carried over the border of a range by a
    table of one row for each range. Of right rows at one time the one with the greatest taken columns counts. Rows of left without a key, a time
    or an earlier row stay, with nulls; null keys match nothing. `within` (an interval) drops matches that are older. Rows of left that are alike in
    key and time are dealt by a hash of their columns. Taken columns must be orderable (no maps); left's must be hashable.
    """
    taken = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(take)))
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)))
    known = F.lit(True)
    for c in (*by, time):
        known = known & F.col(c).isNotNull()
    kind = taken_type(right, take)
    rows = left.select(key.alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_r"), F.struct(*left.columns).alias("_l"), F.xxhash64(*left.columns).alias("_h"), known.alias("_known"))
    facts = right.where(known).select(key.alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_side"), taken.alias("_r"), F.lit(None).cast(left.schema).alias("_l"), F.lit(0).cast("bigint").alias("_h"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = facts.unionByName(rows.where("_known").drop("_known"))
    # Bounds of ranges come from a sample, so the number of a row's range is written down before anything is built on it.
    dealt = written(both.repartitionByRange(parts, "_k", "_t", "_side", "_h").withColumn("_part", F.spark_partition_id()))
    fact = F.when(F.col("_side") == 0, F.struct("_k", "_t", "_r"))
    ends = dealt.groupBy("_part").agg(F.max(fact).alias("_top"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    carried = ends.select("_part", F.max("_top").over(before).alias("_b"))
    order = Window.partitionBy("_part", "_k").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.withColumn("_c", F.last(fact, ignorenulls=True).over(order)).where("_side = 1").join(F.broadcast(carried), "_part")
    found = F.coalesce("_c", F.when(F.col("_b._k") == F.col("_k"), F.col("_b")))
    met = met.select("_l", "_t", found.alias("_f"))
    if within is not None:
        met = met.withColumn("_f", F.when(F.col("_f._t") >= F.col("_t") - within, F.col("_f")))
    alone = rows.where(~F.col("_known")).select("_l", F.col("_r"))
    out = met.select("_l", F.col("_f._r").alias("_r")).unionByName(alone)
    return out.select("_l.*", *(F.col(f"_r.c{i}").alias(c) for i, c in enumerate(take.values())))


def taken_type(df: DataFrame, take: Mapping[str, str]) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(take)])


def _placed(df: DataFrame, by: Sequence[str], ends: tuple[str, str], payload: Column) -> DataFrame:
    """Start, last moment and level of each interval that holds a moment and has a key."""
    out = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), whole_number(df, ends[0]).alias("_s"), (whole_number(df, ends[1]) - 1).alias("_e"), payload.alias("_row")).where("_s <= _e")
    # The bits of length - 1, rounded up to an even number: intervals of a level are no longer than its bins, which are 4^i wide.
    bits = F.when(F.col("_e") == F.col("_s"), 0).otherwise(F.length(F.bin(F.col("_e") - F.col("_s"))))
    return out.withColumn("_level", (F.ceil(bits / 2) * 2).cast("int"))


def _binned(df: DataFrame, levels: Sequence[int]) -> DataFrame:
    """A row for each bin that the interval touches on its own and every higher level: two at most on each."""
    higher = F.filter(F.array(*(F.lit(v) for v in levels)), lambda v: v >= F.col("_level"))
    out = df.withColumn("_v", F.explode(higher))
    return out.withColumn("_bin", F.explode(F.expr("sequence(shiftright(_s, _v), shiftright(_e, _v))")))


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ends: tuple[str, str], right_ends: tuple[str, str], take: Mapping[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose half-open intervals overlap, each once; left's columns and the taken ones of right under their new names.

    An interval lies in bins about as wide as it is long, whatever its length, so a long one isn't cut into many pieces and a short one meets no
    crowd: a pair is found on the level of the longer one, in the bin where the later of the two starts. Work follows the overlaps of bins, which are
    at most some times the true ones where starts are spread evenly; crowded bins are an ordinary skewed equality join, which AQE splits.
    Intervals that are empty, reversed or lack an end, and rows without a key, match nothing. The levels that occur (32 at most) are read first.
    """
    a = _placed(left, by, left_ends, F.struct(*left.columns))
    b = _placed(right, by, right_ends, F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(take))))
    levels = sorted(r[0] for r in a.select("_level").union(b.select("_level")).distinct().collect())
    keys = [f"_k{i}" for i in range(len(by))]
    a, b = (_binned(df, levels or [0]).select(*keys, "_v", "_bin", *(F.col(c).alias(f"{side}{c}") for c in ("_s", "_e", "_level", "_row"))) for df, side in ((a, "l"), (b, "r")))
    both = a.join(b, [*keys, "_v", "_bin"])
    own = F.col("_v") == F.greatest("l_level", "r_level")
    met = (F.col("l_s") <= F.col("r_e")) & (F.col("r_s") <= F.col("l_e"))
    first = F.expr("_bin = shiftright(greatest(l_s, r_s), _v)")
    return both.where(own & met & first).select("l_row.*", *(F.col(f"r_row.c{i}").alias(c) for i, c in enumerate(take.values())))


def interval_load(left: DataFrame, right: DataFrame, key: Sequence[str], by: Sequence[str], left_ends: tuple[str, str], right_ends: tuple[str, str], into: str = "n") -> DataFrame:
    """(key, n): how many pairs of `interval_join` the rows of each key of left are in, without any pair; keys with none don't appear.

    An interval overlaps those that start before its end, but for those that end by its start. Both numbers are running totals over the moments, so
    the work grows with the rows, however crowded a moment is. Moments of right are counted first; those of left are dealt by a hash of their key too.
    """
    ends = lambda df, names: df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), *(F.col(c).alias(f"_i{i}") for i, c in enumerate(key) if df is left), whole_number(df, names[0]).alias("_s"), whole_number(df, names[1]).alias("_e")).where("_s < _e").dropna(subset=[f"_k{i}" for i in range(len(by))] or ["_s"])
    a, b = ends(left, left_ends), ends(right, right_ends)
    keys, ids = [f"_k{i}" for i in range(len(by))], [f"_i{i}" for i in range(len(key))]
    # Starts are looked up at ends and come after them at one moment; ends are looked up at starts and come before them.
    mark = lambda of, side, t: F.struct(F.lit(of).alias("_of"), F.lit(side).alias("_side"), F.col(t).alias("_t"))
    marks = lambda df, x, y: df.withColumn("_m", F.explode(F.array(x, y))).select("*", "_m.*").drop("_m", "_s", "_e")
    points = marks(b, mark(0, 1, "_s"), mark(1, 0, "_e")).groupBy("_of", *keys, "_t", "_side").agg(F.count("*").alias("_w"))
    probes = marks(a, mark(0, 0, "_e"), mark(1, 1, "_s")).withColumns({"_w": F.lit(0).cast("bigint"), "_h": F.xxhash64(*ids)})
    every = b.agg(F.count("*").alias("_all"))
    held = running_total(points.unionByName(probes, allowMissingColumns=True), ["_of", *keys, "_t", "_side", "_h"], "_w", "_before").where("_h is not null").crossJoin(F.broadcast(every))
    # Every point of right has a start and an end, so keys before cancel out; all starts come before the first end.
    n = F.sum(F.when(F.col("_of") == 0, F.col("_before")).otherwise(F.col("_all") - F.col("_before")))
    return held.groupBy(*ids).agg(n.alias(into)).where(F.col(into) > 0).select(*(F.col(f"_i{i}").alias(c) for i, c in enumerate(key)), into)


def subtotals(df: DataFrame, dims: Sequence[str], sums: Sequence[str], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Counts and sums for each grouping set (all subsets of the dimensions if none are given) with `level`, whose bits tell which dimensions are summed away.

    Rows are grouped by all dimensions first, so only the finest groups are multiplied by the sets, not the rows. A null dimension is a group of its own, told apart
    from a subtotal by `level`.
    """
    fine = df.groupBy(*dims).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
    many = fine.cube(*dims) if sets is None else fine.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in dims))
    return many.agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums), F.grouping_id().cast("bigint").alias("level"))
