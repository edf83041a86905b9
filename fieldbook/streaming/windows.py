"""Windows by event time and alerts from keyed state over a growing folder of Parquet files. Additions of this library; the surveyed product has none."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from fieldbook.operators.temporal import whole_number
from fieldbook.session import ship


def event_windows(spark: SparkSession, path: str, time: str, by: Sequence[str], sums: Sequence[str], state: str, width: str | None = None, gap: str | None = None, delay: str = "1 hour", files: int = 1) -> DataFrame:
    """Counts and sums in tumbling windows of `width`, or in sessions that end after `gap` without a row, for each key, kept up file by file.

    Each micro-batch writes its partial windows under its own number, so a repeated batch overwrites itself; windows of all parts are merged when read, and
    sessions of two parts become one where they touch. So the answer equals a batch job's whatever order the files come in, and no row is too late to count.
    The watermark (largest time of the batches before, less `delay`) only describes: `closed` is true once it has passed the window's end, `n_late` counts
    rows of batches that came after that. Rows without a time are in no window. A key's sessions are merged in one task, as many as its partial sessions.
    """
    if (width is None) == (gap is None):
        raise ValueError("give either width or gap")
    schema = spark.read.parquet(path).schema
    span = F.window(time, width) if width else F.session_window(time, gap)

    def add(batch: DataFrame, number: int) -> None:
        part = batch.where(F.col(time).isNotNull()).groupBy(span.alias("_w"), *by).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums), F.max(time).alias("_latest"))
        part.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, "n", *sums, "_latest").write.mode("overwrite").parquet(f"{state}/parts/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.option("basePath", f"{state}/parts").parquet(f"{state}/parts")
    marks = parts.groupBy("batch").agg((F.max("_latest") - F.expr(f"INTERVAL {delay}")).alias("_m"))
    earlier = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each batch
    marked = parts.join(F.broadcast(marks.select("batch", F.max("_m").over(earlier).alias("_mark"))), "batch")
    last = marks.agg(F.max("_m").alias("_last"))
    marked = marked.withColumn("n_late", F.when(F.col("window_end") <= F.col("_mark"), F.col("n")).otherwise(0))
    total = [F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums), F.sum("n_late").alias("n_late")]
    if width:
        merged = marked.groupBy("window_start", "window_end", *by).agg(*total)
    else:
        # Spells that overlap or touch are one session; Spark's own sessions follow the same rule.
        order = Window.partitionBy(*by).orderBy("window_start", "window_end", "batch")
        reach = F.max("window_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(reach.isNull() | (F.col("window_start") > reach), 1).otherwise(0)
        numbered = marked.withColumn("_opens", opens).withColumn("_s", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        merged = numbered.groupBy(*by, "_s").agg(F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"), *total).drop("_s")
    return merged.crossJoin(F.broadcast(last)).withColumn("closed", F.col("window_end") <= F.col("_last")).drop("_last")


def _combine(key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby([key, "period"], as_index=False, sort=False).agg(n=("n", "sum"), _time=("_time", "max"))

    return combine


def _judge(seconds: int, factor: float, least: int, history: int) -> Callable:
    def judge(key, frames, state):
        last, past, periods, counts = state.get if state.exists else (None, [], [], [])
        waiting = dict(zip(periods, counts))
        if not state.hasTimedOut:
            for frame in frames:
                for p, n in frame.groupby("period")["n"].sum().items():
                    waiting[int(p)] = waiting.get(int(p), 0) + int(n)
        mark, spikes, past = state.getCurrentWatermarkMs(), [], list(past)
        for p in sorted(waiting):
            if (p + 1) * seconds * 1000 > mark:
                break
            n = waiting.pop(p)
            if last is not None and p <= last:
                continue  # its period has been judged
            if last is not None:
                past = (past + [0] * min(p - last - 1, history))[-history:]
            if len(past) == history and n >= least and n * history > factor * sum(past):
                spikes.append((*key, p, n, sum(past)))
            past, last = (past + [n])[-history:], p
        state.update((last, past, list(waiting), list(waiting.values())))
        if waiting:
            # Timers must lie after the watermark; the next period that waits ends there or later.
            state.setTimeoutTimestamp(max((min(waiting) + 1) * seconds * 1000, mark + 1))
        yield pd.DataFrame(spikes, columns=["_key", "period", "n", "before"])

    return judge


def spike_stream(spark: SparkSession, path: str, key: str, time: str, state: str, seconds: int, factor: float, least: int, history: int = 4, delay: str = "1 hour", files: int = 1) -> DataFrame:
    """Periods in which a key has `least` rows or more and over `factor` times the mean of its `history` periods before, each told once.

    A key's state holds its last counts and the periods that aren't over; a timer by event time judges a period when the watermark passes its end, empty periods
    count as none, and a key's first `history` periods are only learned from. State and what was told survive restarts by the checkpoint below `state`. Rows that come
    more than `delay` after later ones may miss their period's judgement (`event_windows` counts them all). Counts are added up in the tasks that read, so a hot key
    sends rows in proportion to its periods. Rows without a key or a time are left out. Columns: key, period (number of periods since 1970), n, before (rows of the history).
    """
    ship(spark)
    schema = spark.read.parquet(path).schema
    kind = schema[key].dataType.simpleString()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    step = seconds * 1_000_000
    rows = stream.select(F.col(key).alias("_key"), whole_number(stream, time).alias("_us")).select("_key", F.expr(f"(_us - pmod(_us, {step})) div {step}").alias("period"), F.lit(1).cast("bigint").alias("n"), F.timestamp_micros("_us").alias("_time"))
    few = rows.mapInPandas(_combine("_key"), f"_key {kind}, period bigint, n bigint, _time timestamp").withWatermark("_time", delay)
    spikes = few.groupBy("_key").applyInPandasWithState(
        _judge(seconds, factor, least, history), f"_key {kind}, period bigint, n bigint, before bigint",
        "last bigint, past array<bigint>, periods array<bigint>, counts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout,
    )
    spikes.writeStream.format("parquet").option("path", f"{state}/spikes").option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"_key {kind}, period bigint, n bigint, before bigint").parquet(f"{state}/spikes").withColumnRenamed("_key", key)
