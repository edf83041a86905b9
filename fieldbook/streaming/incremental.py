"""Aggregates and features kept up file by file, equal to what a batch job gives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental_aggregate(spark: SparkSession, path: str, by: Sequence[str], sums: Sequence[str], state: str, files: int = 1) -> DataFrame:
    """Counts and sums of each group over a folder of Parquet files, maintained across runs.

    Each micro-batch adds its partial sums under its own number in the state folder, so a batch that is repeated after a failure
    overwrites itself and nothing counts twice; the answer sums the parts. New files since the last run are all that is read.
    """
    schema = spark.read.parquet(path).schema

    def add(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
        part.write.mode("overwrite").parquet(f"{state}/parts/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(f"{state}/parts")
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))


def incremental_features(spark: SparkSession, path: str, enrich: Callable[[DataFrame], DataFrame], out: str, files: int = 1) -> DataFrame:
    """Stateless feature rows, appended once each to a Parquet sink with a checkpoint."""
    schema = spark.read.parquet(path).schema
    stream = enrich(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path))
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def incremental_sketches(spark: SparkSession, path: str, by: Sequence[str], distinct: str, value: str, at: Sequence[float], state: str, lg: int = 12, k: int = 200, files: int = 1) -> DataFrame:
    """Distinct values of one column and quantiles of another for each group, kept up file by file in sketches of a fixed size.

    Each micro-batch stores its sketches under its own number; the answer merges the parts, so it doesn't read rows again. The count's standard error is
    1.04 / sqrt(2 ** lg), 1.6 % by default, and exact for a few hundred; a quantile's rank is off by at most 1.7 % with k = 200, in 99 of 100 cases. Nulls don't count; a group
    without values has null quantiles. Columns: n, n_distinct, quantiles.
    """
    schema = spark.read.parquet(path).schema

    def add(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, lg).alias("_d"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("_q"))
        part.write.mode("overwrite").parquet(f"{state}/parts/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start().awaitTermination()
    merged = spark.read.parquet(f"{state}/parts").groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("_d").alias("_d"), F.kll_merge_agg_double("_q", k).alias("_q"))
    known = F.kll_sketch_get_n_double("_q") > 0
    cuts = F.when(known, F.array(*(F.kll_sketch_get_quantile_double("_q", F.lit(float(q))) for q in at)))
    return merged.select(*by, "n", F.hll_sketch_estimate("_d").alias("n_distinct"), cuts.alias("quantiles"))
