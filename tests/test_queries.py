"""Every query with an oracle gives the oracle's rows on the smallest tables; the others run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

OWN = {k: v for k, v in entry._plans.QUERIES.items()}
SQL = entry._plans.SQL


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return ""
        if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int64", "float64", "bool_"):
            return f"{float(v):.9g}"
        return str(v)[:10] if "date" in type(v).__name__.lower() or "Timestamp" in type(v).__name__ else str(v)

    names = sorted(df.columns)
    return sorted(tuple(value(v) for v in row) for row in df[names].itertuples(index=False))


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, data, name):
    ours, theirs = OWN[name](spark, data).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_borders_of_polygons(spark, duck, data, tmp_path):
    """Units on the border of a diamond, where the last bit of a coordinate decides."""
    lat, lon = "(11400 + k * 7919 % 7300)", "(73800 + k * 104729 % 5100)"
    on = f"SELECT DISTINCT k FROM range(100000) t(k), range(5) r(i) WHERE k % 10 NOT IN (0, 1, 2) AND abs({lat} - 12500 - i * 1200) + abs({lon} - 74500 - i * 800) = 900"
    con = duck.cursor()
    made = {"customer": f"SELECT k AS c_custkey, 'c' AS c_name, 1 AS c_nationkey, 0.0::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment FROM ({on})", "nation": "SELECT * FROM nation", "region": "SELECT * FROM region"}
    made["orders"] = f"SELECT k AS o_orderkey, k AS o_custkey, 'F' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, TIMESTAMP '1999-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM ({on})"
    for name, sql in made.items():
        con.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    own = duckdb.connect()
    for name in made:
        own.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    ours, theirs = OWN["point_in_polygon"](spark, str(tmp_path)).toPandas(), own.sql(SQL["point_in_polygon"]).df()
    assert 0 < len(ours) < own.sql("select k.c from (select count(*) c from customer) k").df()["c"][0]
    assert plain(ours) == plain(theirs)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_shortlist_is_the_same_everywhere(spark, data):
    short = {r["grp"] for r in OWN["signal_convergence"](spark, data).where("shortlisted").collect()}
    briefed = {r["item"] for r in OWN["briefing_data"](spark, data).where("section = 'shortlist'").collect()}
    assert short == briefed


def test_rules_have_lift(spark, data):
    assert OWN["association_rules"](spark, data).where("lift <= 1").count() == 0
