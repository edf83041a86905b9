"""The given tables in the roles that the operators expect, and the same roles as SQL.

cases: one row for each order, with a group (nation), a parent (region), a category (priority), a status, a date, an amount and
raw coordinates that are derived from the customer's key, some of them missing, zero or swapped.
lines: one row for each line of a case, with an item (brand) and a kind (type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.scalars import valid_coord
from fieldbook.session import table

#: The box that coordinates must lie in.
BOX = (11.0, 19.0, 73.0, 79.0)
#: The last full period; later months are partial.
TRAIN_END_YEAR = 2000


def cases(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    # Nations and regions are fixed dimensions of 25 and 5 rows.
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    key = F.col("c_custkey")
    lat, lon = F.lit(11.4) + (key * 7919 % 7300).cast("double") / 1000, F.lit(73.8) + (key * 104729 % 5100).cast("double") / 1000
    flaw = key % 10
    units = customer.join(F.broadcast(places), customer.c_nationkey == places.n_nationkey).select(
        key.alias("unit_id"), F.col("n_name").alias("grp"), F.col("r_name").alias("parent"), F.col("c_mktsegment").alias("segment"),
        F.when(flaw == 0, 0.0).when(flaw == 1, lon).when(flaw != 2, lat).alias("raw_lat"), F.when(flaw == 0, 0.0).when(flaw == 1, lat).when(flaw != 2, lon).alias("raw_lon"),
    )
    place = valid_coord("raw_lat", "raw_lon", BOX)
    units = units.withColumn("place", place).select("*", F.col("place.lat").alias("lat"), F.col("place.lon").alias("lon")).drop("place")
    day = F.col("o_orderdate").cast("date")
    own = orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("unit_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"), day.alias("day"), F.year(day).alias("year"), F.month(day).alias("month"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return own.join(units, "unit_id")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("item"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    own = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_partkey", F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"))
    return own.join(part, own.l_partkey == part.p_partkey).select("case_id", "item", "kind", "size", "quantity", "flag", "state")


_LAT, _LON = "(11.4 + CAST(c_custkey * 7919 % 7300 AS DOUBLE) / 1000)", "(73.8 + CAST(c_custkey * 104729 % 5100 AS DOUBLE) / 1000)"
CASES = f"""units AS (
  SELECT c_custkey AS unit_id, n_name AS grp, r_name AS parent, c_mktsegment AS segment,
    CASE WHEN c_custkey % 10 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 10 = 1 THEN {_LON} WHEN c_custkey % 10 <> 2 THEN {_LAT} END AS raw_lat,
    CASE WHEN c_custkey % 10 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 10 = 1 THEN {_LAT} WHEN c_custkey % 10 <> 2 THEN {_LON} END AS raw_lon,
    CASE WHEN c_custkey % 10 NOT IN (0, 2) THEN {_LAT} END AS lat, CASE WHEN c_custkey % 10 NOT IN (0, 2) THEN {_LON} END AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cases AS (
  SELECT o_orderkey AS case_id, o_orderpriority AS category, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INT) AS year,
    CAST(month(o_orderdate) AS INT) AS month, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, units.*
  FROM orders JOIN units ON o_custkey = unit_id)"""
LINES = """lines AS (
  SELECT l_orderkey AS case_id, p_brand AS item, p_type AS kind, p_size AS size, CAST(l_quantity AS INT) AS quantity, l_returnflag AS flag, l_linestatus AS state
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
