"""Queries of the monthly series: spines, forecasts, alerts and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import scalars as S
from fieldbook.operators import aggregates as A
from fieldbook.operators import timeseries as T
from fieldbook.plans.aggregate_queries import MONTHLY, SERIES, series
from fieldbook.plans.bindings import CASES, cases
from fieldbook.plans.registry import query, rounded_sql

END = 2000 * 12 + 11
KEYS = ["level", "key", "category"]

DENSE = f"""{SERIES}, firsts AS (SELECT level, key, category, min(t) AS f FROM series WHERE t <= {END} GROUP BY ALL),
dense AS (SELECT p.level, p.key, p.category, CAST(p.t AS INT) AS t, CAST(coalesce(s.n, 0) AS BIGINT) AS y FROM (SELECT level, key, category, unnest(range(f, {END + 1})) AS t FROM firsts) p
  LEFT JOIN series s ON s.level = p.level AND s.key = p.key AND s.category = p.category AND s.t = p.t)"""


def dense(spark, d):
    return T.densify(series(spark, d), KEYS, "t", "n", END)


@query(f"WITH {DENSE} SELECT * FROM dense")
def densify_series(spark, d):
    return dense(spark, d)


def _naive(source: str, last: int, horizon: int, name: str) -> str:
    return f"""{name}_lag AS (SELECT *, y - lag(y, 12) OVER (PARTITION BY level, key, category ORDER BY t) AS dd FROM {source}),
{name}_stats AS (SELECT level, key, category, count(*) AS n, avg(y) AS m, stddev_pop(y) AS s1, stddev_pop(dd) AS s2 FROM {name}_lag GROUP BY ALL),
{name} AS (SELECT s.level, s.key, s.category, CAST({last} + h AS INT) AS t, CASE WHEN s.n > 12 THEN CAST(p.y AS DOUBLE) ELSE m END AS yhat, CASE WHEN s.n > 12 THEN s2 ELSE s1 END AS sigma, CAST(h AS INT) AS h
  FROM {name}_stats s CROSS JOIN range(1, {horizon + 1}) r(h) LEFT JOIN {source} p ON p.level = s.level AND p.key = s.key AND p.category = s.category AND p.t = {last} - 11 + (h - 1) % 12)"""


NAIVE = f"{DENSE}, {_naive('dense', END, 18, 'naive')}"


def _rounded(df, *columns):
    return df.withColumns({c: S.rounded(F.col(c)) for c in columns})


@query(f"WITH {NAIVE} SELECT level, key, category, t, h, {rounded_sql('yhat')} AS yhat, {rounded_sql('sigma')} AS sigma FROM naive")
def seasonal_naive(spark, d):
    return _rounded(T.seasonal_naive(dense(spark, d), KEYS, "t", 18), "yhat", "sigma")


BAND = f"{NAIVE}, band AS (SELECT *, greatest(yhat - 1.96 * sigma * sqrt(h), 0) AS lower, greatest(yhat + 1.96 * sigma * sqrt(h), 0) AS upper FROM naive)"


def band(spark, d):
    return T.forecast_band(T.seasonal_naive(dense(spark, d), KEYS, "t", 18))


@query(f"WITH {BAND} SELECT level, key, category, t, h, {rounded_sql('yhat')} AS yhat, {rounded_sql('sigma')} AS sigma, {rounded_sql('lower')} AS lower, {rounded_sql('upper')} AS upper FROM band")
def forecast_band(spark, d):
    return _rounded(band(spark, d), "yhat", "sigma", "lower", "upper")


HISTORY = f"""{BAND}, history AS (SELECT level, key, category, t, CAST(y AS DOUBLE) AS y_actual, NULL::DOUBLE AS yhat, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, 0 AS is_forecast, 'history' AS method FROM dense
  UNION ALL SELECT level, key, category, t, NULL, {rounded_sql('yhat')}, {rounded_sql('lower')}, {rounded_sql('upper')}, 1, 'naive' FROM band)"""


def history(spark, d):
    return _rounded(T.history_plus_forecast(dense(spark, d), band(spark, d), KEYS, "t", "naive"), "yhat", "lower", "upper")


@query(f"WITH {HISTORY} SELECT level, key, category, t, y_actual, yhat, lower, upper, CAST(is_forecast AS INT) AS is_forecast, method FROM history")
def history_plus_forecast(spark, d):
    return history(spark, d)


BACK = f"""{DENSE}, long AS (SELECT level, key, category FROM dense GROUP BY ALL HAVING count(*) >= 30), kept AS (SELECT dense.* FROM dense JOIN long USING (level, key, category)),
train AS (SELECT * FROM kept WHERE t <= {END - 12}), {_naive('train', END - 12, 12, 'back')},
errors AS (SELECT k.level, k.key, k.category, {rounded_sql('avg(CASE WHEN k.y > 0 THEN abs(k.y - b.yhat) / k.y END)')} AS mape, {rounded_sql('sqrt(avg((k.y - b.yhat) * (k.y - b.yhat)))')} AS rmse
  FROM kept k JOIN back b ON k.level = b.level AND k.key = b.key AND k.category = b.category AND k.t = b.t WHERE k.t > {END - 12} GROUP BY ALL)"""


@query(f"WITH {BACK} SELECT * FROM errors")
def backtest(spark, d):
    return T.backtest(dense(spark, d), KEYS, "t", END, T.seasonal_naive)


@query()
def forecast_ets(spark, d):
    return _rounded(T.forecast_ets(dense(spark, d), KEYS, "t", 18), "yhat", "sigma")


@query(
    f"""WITH {NAIVE}, able AS (SELECT level, key, category, count(*) >= 30 AND count(*) FILTER (y <> 0) >= 60 AS fits FROM dense GROUP BY ALL)
SELECT level, key, category, t, h, CASE WHEN fits THEN 'ets' ELSE 'naive' END AS method, CASE WHEN NOT fits THEN {rounded_sql('yhat')} END AS naive_yhat, CASE WHEN NOT fits THEN {rounded_sql('sigma')} END AS naive_sigma
FROM naive JOIN able USING (level, key, category)"""
)
def forecast_ets_fallback(spark, d):
    """Which series are fitted and which fall back, with the fallback's figures: the part of `forecast_ets` that SQL can follow. Sixty months with cases are asked for, so that both occur."""
    got = _rounded(T.forecast_ets(dense(spark, d), KEYS, "t", 18, least_nonzero=60), "yhat", "sigma")
    fell = F.col("method") == "naive"
    return got.select(*KEYS, "t", "h", "method", F.when(fell, F.col("yhat")).alias("naive_yhat"), F.when(fell, F.col("sigma")).alias("naive_sigma"))


@query()
def backtest_ets(spark, d):
    return T.backtest(dense(spark, d), KEYS, "t", END, T.forecast_ets)


ALERTS = f"""{CASES}, yearly AS (SELECT grp, category, year, count(*) AS n FROM cases WHERE year IN (1998, 1999, 2000) GROUP BY ALL),
base AS (SELECT grp, category, {rounded_sql('avg(n)', 2)} AS baseline FROM yearly WHERE year < 2000 GROUP BY ALL),
scored AS (SELECT b.grp, b.category, baseline, CAST(coalesce(y.n, 0) AS BIGINT) AS actual, coalesce({rounded_sql('100.0 * (coalesce(y.n, 0) - baseline) / nullif(baseline, 0)', 2)}, 0) AS deviation_pct FROM base b LEFT JOIN yearly y ON y.grp = b.grp AND y.category = b.category AND y.year = 2000),
alerts AS (SELECT *, CASE WHEN deviation_pct >= 40 THEN 'red' ELSE 'amber' END AS severity FROM scored WHERE baseline >= 10 AND actual - baseline >= 3 AND deviation_pct >= 20)"""


def alerts(spark, d, min_baseline: float = 10, min_increase: float = 3, every: bool = False):
    yearly = A.count_by(cases(spark, d), ["grp", "category", "year"])
    return T.spike_alerts(yearly, ["grp", "category"], "year", "n", [1998, 1999], 2000, min_baseline, min_increase, every=every)


@query(f"WITH {ALERTS} SELECT * FROM alerts")
def spike_alerts(spark, d):
    return alerts(spark, d)


def _scored(spark, d):
    return T.seasonal_expectation(A.count_by(cases(spark, d).where("year <= 2000"), ["grp", "year", "month"]), ["grp"], "month", "n")


ANOMALIES = f"{MONTHLY}, anomalies AS (SELECT grp, year, month, n, {rounded_sql('expected')} AS expected, {rounded_sql('(n - expected) / (std + 1e-6)')} AS z FROM sx WHERE expected >= 5 AND n > expected AND ((n - expected) / (std + 1e-6) >= 1.8 OR n / greatest(expected, 1) >= 1.6))"


def anomalies(spark, d):
    flagged = _scored(spark, d).where(T.anomaly_rule("n", "expected", "residual", "z", z_cut=1.8, ratio_cut=1.6))
    return _rounded(flagged.select("grp", "year", "month", "n", "expected", "z"), "expected", "z")


@query(f"WITH {ANOMALIES} SELECT * FROM anomalies")
def anomaly_flags(spark, d):
    return anomalies(spark, d)


@query()
def isolation_forest(spark, d):
    return _rounded(T.isolation_scores(_scored(spark, d).select("grp", "year", "month", "z", "log_ratio"), ["grp", "year", "month"], ["z", "log_ratio"]), "z", "log_ratio", "score")


@query(f"""WITH {MONTHLY}, hashed AS (SELECT grp, month, n, CAST('0x' || substr(md5(concat_ws('|', '42', grp, CAST(year * 12 + month - 1 AS VARCHAR))), 1, 8) AS BIGINT) AS h FROM gm),
changed AS (SELECT grp, month, n >= 5 AND h % 20 = 0 AS picked, CASE WHEN n >= 5 AND h % 20 = 0 THEN (n * (300 + (h // 65536) % 301) + 50) // 100 ELSE n END AS n FROM hashed),
again AS (SELECT *, avg(n) OVER w AS expected, coalesce(stddev_samp(n) OVER w, 0) AS std FROM changed WINDOW w AS (PARTITION BY grp, month)),
found AS (SELECT expected >= 5 AND n > expected AND ((n - expected) / (std + 1e-6) >= 2.0 OR n / greatest(expected, 1) >= 1.8) AS found FROM again WHERE picked)
SELECT count(*) AS n_injected, count(*) FILTER (found) AS n_found, coalesce({rounded_sql('avg(CASE WHEN found THEN 1.0 ELSE 0.0 END)')}, 0) AS recall FROM found""")
def injected_recall(spark, d):
    monthly = A.count_by(cases(spark, d).where("year <= 2000").withColumn("t", F.col("year") * 12 + F.col("month") - 1), ["grp", "t", "month"])
    return T.injected_recall(monthly, ["grp"], "t", "month", "n", least=5)


PANEL = f"""{CASES}, py AS (SELECT grp, year, count(*) AS n FROM cases GROUP BY ALL), pf AS (SELECT g.grp, CAST(y AS INT) AS year, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT grp FROM cases) g CROSS JOIN range(1995, 2002) r(y) LEFT JOIN py ON py.grp = g.grp AND py.year = y),
pl AS (SELECT *, coalesce(lag(n, 1) OVER w, 0) AS lag1, coalesce(lag(n, 2) OVER w, 0) AS lag2, coalesce(lag(n, 3) OVER w, 0) AS lag3 FROM pf WINDOW w AS (PARTITION BY grp ORDER BY year)),
panel AS (SELECT grp, year, CASE WHEN year <> 2001 THEN n END AS target, lag1, lag2, {rounded_sql('(lag1 + lag2 + lag3) / 3.0::DOUBLE')} AS avg3, (lag1 - lag3) / 2.0::DOUBLE AS slope, coalesce({rounded_sql('CAST(lag1 - lag2 AS DOUBLE) / nullif(lag2, 0)')}, 0) AS yoy FROM pl)"""


def panel(spark, d):
    return T.lag_panel(A.count_by(cases(spark, d), ["grp", "year"]), "grp", "year", "n", 1995, 2001, 2001)


@query(f"WITH {PANEL} SELECT grp, year, CAST(target AS DOUBLE) AS target, lag1, lag2, avg3, slope, yoy FROM panel")
def lag_panel(spark, d):
    return panel(spark, d).withColumn("target", F.col("target").cast("double"))
