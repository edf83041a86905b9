"""Merged sketches within their errors, and the table function on odd rows."""

import pytest
from pyspark.sql import functions as F

from fieldbook.functions.tables import register_tables
from fieldbook.streaming.incremental import incremental_sketches


def test_merged_sketches_keep_their_errors(spark, tmp_path):
    n = 120_000
    df = spark.range(n).select(F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("k"), (F.col("id") % 30_000).alias("user"), ((F.col("id") * 7919) % n).alias("v"))
    df = df.unionByName(spark.createDataFrame([("c", None, None)], "k string, user bigint, v bigint"))
    df.repartition(3, "user").write.parquet(f"{tmp_path}/in")
    cuts = [0.05, 0.5, 0.99]
    for _ in range(2):  # a second run reads nothing and changes nothing
        got = {r["k"]: r for r in incremental_sketches(spark, f"{tmp_path}/in", ["k"], "user", "v", cuts, f"{tmp_path}/state").collect()}
        assert (got["c"]["n"], got["c"]["n_distinct"], got["c"]["quantiles"]) == (1, 0, None)
        for k, users, rows in (("a", 22_500, 90_000), ("b", 7_500, 30_000)):
            assert got[k]["n"] == rows and abs(got[k]["n_distinct"] - users) <= 0.05 * users
            ranks = df.where(F.col("k") == k).agg(*(F.avg((F.col("v") <= q).cast("int")) for q in got[k]["quantiles"])).first()
            assert all(abs(rank - q) <= 0.02 for rank, q in zip(ranks, cuts))


def test_sessions_from_sql(spark):
    register_tables(spark)
    rows = [("a", 1), ("a", 5), ("a", 5), ("a", 11), ("b", None), (None, 3), ("c", -4)]
    spark.createDataFrame(rows, "key string, at bigint").createOrReplaceTempView("some_rows")
    got = sorted((tuple(r) for r in spark.sql("SELECT * FROM sessions(TABLE(some_rows), 5)").collect()), key=repr)
    assert got == sorted([("a", 1, 5, 3), ("a", 11, 11, 1), (None, 3, 3, 1), ("c", -4, -4, 1)], key=repr)
    assert spark.sql("SELECT * FROM sessions(TABLE(SELECT * FROM some_rows WHERE false), 5)").count() == 0
    with pytest.raises(Exception, match="columns key and at"):
        spark.sql("SELECT * FROM sessions(TABLE(SELECT key FROM some_rows), 5)").collect()
