"""Queries of the sources, sinks and incremental jobs: given tables are written in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldbook.functions import scalars as S
from fieldbook.operators import aggregates as A
from fieldbook.plans.bindings import CASES, cases
from fieldbook.plans.join_queries import dim
from fieldbook.plans.registry import query, rounded_sql
from fieldbook.session import checkpoint_folder, table
from fieldbook.sources import readers as R
from fieldbook.streaming import incremental as I


def _new(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS name, c_mktsegment AS segment FROM customer")
def read_raw_csv(spark, d):
    out = _new(spark, "raw")
    name = F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_name"))
    table(spark, d, "customer").select(F.col("c_custkey").alias("﻿Cust Key"), name.alias("Full\tName"), F.col("c_mktsegment").alias("Segment")).write.csv(out, header=True)
    return R.read_raw_csv(spark, out, {"Cust Key": "id", "Full Name": "name", "Segment": "segment"})


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def smoke_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(100)


@query("SELECT p_partkey, p_brand FROM part")
def read_columns(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand")


@query("SELECT DISTINCT upper(n) AS name, CAST(s_suppkey % 90 AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon FROM (SELECT s_suppkey, unnest([s_name, 'Site ' || s_suppkey]) AS n FROM supplier WHERE s_nationkey % 2 = 0)")
def read_gazetteer(spark, d):
    out = _new(spark, "gazetteer")
    s = table(spark, d, "supplier")
    s.select("s_name", F.concat(F.lit("Site "), "s_suppkey"), (F.col("s_suppkey") % 90).cast("string"), (F.col("s_suppkey") % 180).cast("string"), (F.col("s_nationkey") % 2).cast("string")).write.csv(out, sep="\t")
    return R.read_gazetteer(spark, out, ["name", "other", "lat", "lon", "kind"], F.col("kind") == "0", "name", "other", "lat", "lon")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, CAST(5 AS INT) AS points, CAST(10.5 + n_nationkey AS DOUBLE) AS lat, CAST(70.5 + n_nationkey AS DOUBLE) AS lon FROM nation")
def read_polygons(spark, d):
    out = _new(spark, "polygons")
    k = F.col("n_nationkey").cast("double")
    corner = lambda x, y: F.array(70.0 + k + x, 10.0 + k + y)
    ring = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("code"), F.col("n_nationkey").cast("string")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    # A dimension of 25 rows in one document.
    table(spark, d, "nation").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(out)
    return R.read_polygons(spark, out, "code").select("code", F.size("ring").alias("points"), "lat", "lon")


@query("SELECT 'ST' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS name, substr(lpad(CAST(s_suppkey AS VARCHAR), 5, '0'), 1, 3) AS code, CAST(s_suppkey % 80 AS DOUBLE) AS lat, CAST(s_suppkey % 170 AS DOUBLE) AS lon FROM supplier WHERE s_suppkey % 9 <> 0")
def read_station_points(spark, d):
    out = _new(spark, "stations")
    k = F.col("s_suppkey")
    coordinates = F.when(k % 9 == 0, "x,y").otherwise(F.concat_ws(",", (k % 170).cast("string"), (k % 80).cast("string"), F.lit("0")))
    marks = table(spark, d, "supplier").select(F.format_string("ST%05d", k).alias("name"), F.struct(coordinates.alias("coordinates")).alias("Point"))
    marks.write.format("xml").option("rootTag", "kml").option("rowTag", "Placemark").save(out)
    return R.read_station_points(spark, out, 3, 3)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS a, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE '' END AS b, r_name AS c FROM region")
def read_spreadsheet_xml(spark, d):
    out = _new(spark, "sheet")
    cell = lambda x, at=None: F.struct(F.lit(at).cast("int").alias("_Index"), x.alias("Data"))
    name, number = F.col("r_name"), F.col("r_regionkey").cast("string")
    cells = F.when(F.col("r_regionkey") % 2 == 0, F.array(cell(number), cell(name), cell(name))).otherwise(F.array(cell(number), cell(name, 3)))
    table(spark, d, "region").select(cells.alias("Cell")).write.format("xml").option("rootTag", "Table").option("rowTag", "Row").save(out)
    return R.read_spreadsheet_xml(spark, out, ["a", "b", "c"])


@query("SELECT c_name, c_custkey * 1000 AS people FROM customer WHERE c_nationkey < 12 AND c_custkey % 7 <> 0")
def read_census(spark, d):
    out = _new(spark, "census")
    people = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.format_number(F.col("c_custkey") * 1000, 0))
    table(spark, d, "customer").select("c_name", F.when(F.col("c_nationkey") < 12, "district").otherwise("state").alias("level"), people.alias("people")).write.csv(out, header=True)
    return R.read_census(spark, out, F.col("level") == "district", "c_name", ["people"])


@query("SELECT r_name AS parent, CAST(sum(n_nationkey * 1000 + 7) AS BIGINT) AS total FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def read_external_totals(spark, d):
    own = dim(spark, d)
    k = F.col("n_nationkey")
    rows = own.select(F.when(k == 3, "Third").otherwise(F.concat(F.lit(" "), "member")).alias("name"), F.format_number(k * 1000, 0).alias("a"), F.lit("7").alias("b"))
    rows = rows.unionByName(own.limit(1).select(F.lit("TOTAL").alias("name"), F.lit("1").alias("a"), F.lit("1").alias("b")))
    third = own.where("n_nationkey = 3").select("member").first()
    return R.external_totals(rows, "name", ["a", "b"], {"Third": third[0] if third else ""}, ["TOTAL"], own.select("member", "parent"), "member", "parent")


@query(f"WITH {CASES} SELECT CAST(year AS SMALLINT) AS year, CAST(month AS TINYINT) AS month, grp, category, CAST(amount AS DOUBLE) AS amount FROM cases")
def write_features(spark, d):
    out = _new(spark, "features")
    R.write_features(cases(spark, d), {"year": "smallint", "month": "tinyint", "grp": "string", "category": "string", "amount": "double"}, out)
    return spark.read.parquet(out)


@query(f"WITH {CASES}, g AS (SELECT grp, year, count(*) AS n FROM cases GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY grp, year) AS place FROM g")
def write_sorted_table(spark, d):
    """Rows as they are read back, with their places in the files."""
    out = _new(spark, "sorted")
    R.write_sorted_table(A.count_by(cases(spark, d), ["grp", "year"]), ["grp", "year"], out)
    return R.file_order(spark, out)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS nation, c_acctbal AS balance, c_custkey % 2 = 0 AS even FROM customer")
def load_typed(spark, d):
    k = F.col("c_custkey")
    nation = F.when(k % 3 == 0, " ").otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")))
    raw = table(spark, d, "customer").select(k.cast("string").alias("id"), nation.alias("nation"), F.col("c_acctbal").cast("string").alias("balance"), F.when(k % 2 == 0, "True").otherwise("false").alias("even"))
    out, kinds = _new(spark, "typed"), {"id": "bigint", "nation": "bigint", "balance": "double", "even": "boolean"}
    R.load_typed(raw, kinds, out)
    return R.load_typed(raw, kinds, out)


def _widths_sql(columns) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(max(length({c})) AS INT) AS longest, CAST(CASE WHEN max(length({c})) * 1.5 <= 255 THEN 255 WHEN max(length({c})) * 1.5 <= 500 THEN 500 WHEN max(length({c})) * 1.5 <= 1000 THEN 1000 ELSE 2000 END AS INT) AS bucket FROM documents" for c in columns)


@query(_widths_sql(["text", "lang", "source"]))
def profile_widths(spark, d):
    return R.profile_widths(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS INT) AS n_columns FROM {t}" for t in TABLES))
def table_inventory(spark, d):
    return R.table_inventory({t: table(spark, d, t) for t in TABLES})


@query("SELECT 'secondary' AS served_from, n_name FROM nation UNION ALL SELECT 'primary', r_name FROM region")
def read_with_fallback(spark, d):
    empty = _new(spark, "empty")
    table(spark, d, "nation").limit(0).write.parquet(empty)
    a = R.read_with_fallback(spark, empty, f"{d}/nation.parquet").select("served_from", "n_name")
    return a.union(R.read_with_fallback(spark, f"{d}/region.parquet", f"{d}/nation.parquet").select("served_from", "r_name"))


@query(f"WITH {CASES} SELECT count(*) AS n_rows, {rounded_sql('CAST(count(lat) AS DOUBLE) / count(*)')} AS located_share, count(*) FILTER (grp = 'NATION_7') AS unknown_keys, TRUE AS matches FROM cases")
def reconcile_rows(spark, d):
    c = cases(spark, d)
    return R.reconcile_rows(c, table(spark, d, "orders").count(), F.col("lat").isNotNull(), F.col("grp") != "NATION_7", strict=True)


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type")
def incremental_aggregate(spark, d):
    out = _new(spark, "stream")
    e = table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    e.repartition(3).write.parquet(f"{out}/in")
    I.incremental_aggregate(spark, f"{out}/in", ["event_type"], ["cents"], f"{out}/state")
    return I.incremental_aggregate(spark, f"{out}/in", ["event_type"], ["cents"], f"{out}/state")


@query("SELECT event_id, event_type, CAST(isodow(ts) - 1 AS INT) AS dow, CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' ELSE 'Other' END AS season FROM events")
def incremental_features(spark, d):
    out = _new(spark, "stream")
    table(spark, d, "events").repartition(3).write.parquet(f"{out}/in")
    season = F.when(S.season(F.month("ts")) == "Winter", "Winter").otherwise("Other")
    enrich = lambda df: df.select("event_id", "event_type", S.day_of_week(F.col("ts").cast("date")).alias("dow"), season.alias("season"))
    return I.incremental_features(spark, f"{out}/in", enrich, f"{out}/out")
