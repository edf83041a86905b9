"""Sources and sinks: messy CSV, gazetteers, GeoJSON, KML, SpreadsheetML, typed loads and inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.functions.scalars import rounded


def header_name(raw: str) -> str:
    """A header without byte-order mark, tabs, line ends and runs of spaces."""
    return " ".join(raw.replace("﻿", "").split())


def read_raw_csv(spark: SparkSession, path: str, header: Mapping[str, str], separator: str = ",") -> DataFrame:
    """All-string CSV under new names. A header that the map lacks, or the other way round, raises; blanks stay empty strings."""
    df = spark.read.csv(path, header=True, sep=separator, encoding="UTF-8", multiLine=True, escape='"', inferSchema=False)
    names = [header_name(c) for c in df.columns]
    if unknown := sorted(set(names) ^ set(header)):
        raise ValueError(f"header drift: {', '.join(unknown)}")
    return df.toDF(*(header[n] for n in names)).na.fill("")


def read_gazetteer(spark: SparkSession, path: str, columns: Sequence[str], keep: Column, name: str, other: str, lat: str, lon: str) -> DataFrame:
    """(name, lat, lon) of a TSV without header: rows that pass, a row for each of two name variants, distinct."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, sep="\t", schema=schema, quote="").where(keep)
    names = F.explode(F.array_distinct(F.filter(F.array(F.upper(F.trim(name)), F.upper(F.trim(other))), lambda n: n.isNotNull() & (n != ""))))
    return df.select(names.alias("name"), F.col(lat).try_cast("double").alias("lat"), F.col(lon).try_cast("double").alias("lon")).where("lat is not null and lon is not null").distinct()


def read_polygons(spark: SparkSession, path: str, code: str) -> DataFrame:
    """(code, ring, lat, lon): outer rings of GeoJSON features as arrays of structs, and the middle of each ring's box."""
    point = "array<double>"
    schema = f"features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<{point}>>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    got = f.where("f.geometry.type = 'Polygon'").select(F.col("f.properties")[code].alias("code"), ring.alias("ring"))
    middle = lambda c: (F.array_min(F.transform("ring", lambda p: p[c])) + F.array_max(F.transform("ring", lambda p: p[c]))) / 2
    return got.withColumns({"lat": middle("lat"), "lon": middle("lon")})


def read_station_points(spark: SparkSession, path: str, code_from: int, code_length: int) -> DataFrame:
    """(name, code, lat, lon) of KML placemarks; those without valid coordinates are dropped."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("Point", T.StructType([T.StructField("coordinates", T.StringType())]))])
    df = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    parts = F.split(F.trim("Point.coordinates"), ",")
    got = df.select(F.trim("name").alias("name"), F.substring(F.trim("name"), code_from, code_length).alias("code"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("lat"), F.try_element_at(parts, F.lit(1)).try_cast("double").alias("lon"))
    return got.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def read_spreadsheet_xml(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of SpreadsheetML as strings; a cell's Index skips to its column, gaps are empty."""
    cell = T.StructType([T.StructField("_Index", T.IntegerType()), T.StructField("Data", T.StringType())])
    df = spark.read.format("xml").option("rowTag", "Row").schema(T.StructType([T.StructField("Cell", T.ArrayType(cell))])).load(path)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(map() as map<int,string>)").alias("held"))

    def put(state: Column, c: Column) -> Column:
        at = F.coalesce(c["_Index"], state["at"] + 1)
        return F.struct(at.alias("at"), F.map_concat(state["held"], F.create_map(at, F.coalesce(c["Data"], F.lit("")))).alias("held"))

    held = F.aggregate("Cell", start, put)["held"]
    return df.select(held.alias("h")).select(*(F.coalesce(F.try_element_at("h", F.lit(i + 1)), F.lit("")).alias(c) for i, c in enumerate(columns)))


def read_census(spark: SparkSession, path: str, keep: Column, key: str, numbers: Sequence[str]) -> DataFrame:
    """Rows of a census CSV that pass, numbers parsed; rows with a number that doesn't parse are skipped."""
    df = spark.read.csv(path, header=True, inferSchema=False).where(keep)
    parsed = df.select(key, *(F.regexp_replace(c, ",", "").try_cast("bigint").alias(c) for c in numbers))
    return parsed.dropna(subset=list(numbers))


def external_totals(df: DataFrame, name: str, measures: Sequence[str], aliases: Mapping[str, str], headers: Sequence[str], parents: DataFrame, member: str, parent: str) -> DataFrame:
    """(parent, total) of an independent table: header rows dropped, names aliased, thousands commas stripped, measures added up."""
    n = F.trim(F.col(name))
    alias = F.lit(None).cast("string")
    for old, new in aliases.items():
        alias = F.when(n == old, new).otherwise(alias)
    number = lambda c: F.coalesce(F.regexp_replace(c, ",", "").try_cast("bigint"), F.lit(0))
    rows = df.where(~n.isin(*headers)).select(F.coalesce(alias, n).alias("_n"), reduce(lambda a, b: a + b, map(number, measures)).alias("_t"))
    return rows.join(parents, rows["_n"] == parents[member]).groupBy(parent).agg(F.sum("_t").alias("total"))


def typed(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """String columns as their declared types; blanks and what doesn't parse are null; whole numbers may be written with a point."""

    def cast(c: str, kind: str) -> Column:
        x = F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
        if kind in ("bigint", "int"):
            return F.coalesce(x.try_cast(kind), x.try_cast("double").try_cast(kind))
        if kind == "boolean":
            return F.when(F.lower(x) == "true", True).when(F.lower(x) == "false", False)
        return x if kind == "string" else x.try_cast(kind)

    return df.select(*(cast(c, k).alias(c) for c, k in kinds.items()))


def load_typed(df: DataFrame, kinds: Mapping[str, str], path: str) -> DataFrame:
    """Truncate and insert: running it again leaves the same table."""
    typed(df, kinds).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_features(df: DataFrame, kinds: Mapping[str, str], path: str) -> None:
    """Fixed-schema Parquet, zstd."""
    df.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_sorted_table(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Writes the table in the order of its keys, in range-partitioned files, and returns its row count as read back."""
    df.orderBy(*keys).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).agg(F.count("*").alias("n_rows"))


def file_order(spark: SparkSession, path: str, into: str = "place") -> DataFrame:
    """The rows of a folder of Parquet files with their places (from 1) in the order in which they lie there: files by name, then rows. Offsets come from a count of each file."""
    rows = spark.read.parquet(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = [(r["_file"], r["n"]) for r in rows.groupBy("_file").agg(F.count("*").alias("n")).orderBy("_file").collect()]  # a row for each file
    starts = dict(zip((f for f, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    before = spark.createDataFrame(list(starts.items()), "_file string, _before bigint")
    return rows.join(F.broadcast(before), "_file").withColumn(into, F.col("_before") + F.col("_at") + 1).drop("_file", "_at", "_before")


def profile_widths(df: DataFrame, headroom: float = 1.5, buckets: Sequence[int] = (255, 500, 1000, 2000)) -> DataFrame:
    """(column, longest, bucket): longest string of every string column in one pass, and the bucket that holds it with headroom."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    row = df.agg(*(F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in names))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("longest")) for c in names))).alias("x")).select("x.*")
    bucket = F.lit(buckets[-1])
    for b in reversed(buckets[:-1]):
        bucket = F.when(F.col("longest") * headroom <= b, b).otherwise(bucket)
    return long.withColumn("bucket", bucket)


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_columns)."""
    rows = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def read_with_fallback(spark: SparkSession, primary: str, secondary: str) -> DataFrame:
    """The primary store, or the secondary if that fails or is empty; `served_from` says which."""
    try:
        df = spark.read.parquet(primary)
        if not df.isEmpty():
            return df.withColumn("served_from", F.lit("primary"))
    except Exception:  # noqa: BLE001  whatever a store may raise
        pass
    return spark.read.parquet(secondary).withColumn("served_from", F.lit("secondary"))


def reconcile_rows(df: DataFrame, expected: int, located: Column, known: Column, strict: bool = False) -> DataFrame:
    """One row: rows, whether they are as many as expected, located share and rows with unknown keys; raises if strict and they aren't."""
    got = df.agg(F.count("*").alias("n_rows"), rounded(F.count_if(located).cast("double") / F.count("*")).alias("located_share"), F.count_if(~known).alias("unknown_keys"))
    got = got.withColumn("matches", F.col("n_rows") == expected)
    if strict and not got.first()["matches"]:
        raise ValueError("row counts differ")
    return got
