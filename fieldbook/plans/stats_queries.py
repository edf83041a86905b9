"""Queries of the statistics and validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import scalars as S
from fieldbook.operators import aggregates as A
from fieldbook.operators import stats as X
from fieldbook.plans.bindings import CASES, cases
from fieldbook.plans.registry import query, rounded_sql
from fieldbook.plans.series_queries import ALERTS, END, KEYS, alerts, band, dense
from fieldbook.plans.series_queries import NAIVE as NAIVE_SQL
from fieldbook.operators import timeseries as T
from fieldbook.session import table

INDICATORS = f"""{CASES}, ind AS (SELECT n_name AS grp, count(*) AS people, avg(c_acctbal) AS balance, CAST(count(*) FILTER (c_acctbal > 5000) AS DOUBLE) / count(*) AS rich, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS DOUBLE) / count(*) AS building FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
target AS (SELECT grp, count(*) AS n FROM cases GROUP BY grp), both_t AS (SELECT * FROM ind JOIN target USING (grp))"""


def indicators(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    share = lambda cond: F.count_if(cond).cast("double") / F.count("*")
    ind = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("grp")).agg(F.count("*").alias("people"), F.avg("c_acctbal").alias("balance"), share(F.col("c_acctbal") > 5000).alias("rich"), share(F.col("c_mktsegment") == "BUILDING").alias("building"))
    return ind.join(A.count_by(cases(spark, d), ["grp"]), "grp")


@query(f"WITH {INDICATORS}, r AS (SELECT count(*) AS n, corr(people, n) AS r FROM both_t) SELECT n, {rounded_sql('r', 6)} AS r, {rounded_sql('r * sqrt((n - 2) / (1 - r * r))')} AS t FROM r")
def pearson(spark, d):
    return X.pearson(indicators(spark, d), "people", "n").select("n", "r", "t")


@query()
def pearson_p(spark, d):
    return X.pearson(indicators(spark, d), "balance", "n").withColumn("p", S.rounded(F.col("p"), 6))


SPEARMAN = "(SELECT corr(rx, ry) FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM {t}))"


@query(f"WITH {INDICATORS} SELECT (SELECT count(*) FROM both_t) AS n, {rounded_sql(SPEARMAN.format(x='people', y='n', t='both_t'), 6)} AS rho")
def spearman(spark, d):
    return X.spearman(indicators(spark, d), "people", "n")


@query(f"WITH {INDICATORS}, c AS (SELECT corr(balance, n) AS xy, corr(balance, people) AS xz, corr(n, people) AS yz FROM both_t) SELECT {rounded_sql('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))', 6)} AS partial_r FROM c")
def partial_corr(spark, d):
    return X.partial_corr(indicators(spark, d), "balance", "n", "people")


CORR = f"""{INDICATORS}, long_t AS (SELECT 'people' AS indicator, CAST(people AS DOUBLE) AS x, n FROM both_t UNION ALL SELECT 'balance', balance, n FROM both_t UNION ALL SELECT 'rich', rich, n FROM both_t UNION ALL SELECT 'building', building, n FROM both_t),
ct AS (SELECT indicator, count(*) AS n, {rounded_sql('corr(x, n)', 6)} AS r FROM long_t GROUP BY indicator),
corrs AS (SELECT *, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'negligible' END AS strength, CASE WHEN r < 0 THEN 'negative' ELSE 'positive' END AS direction, indicator = 'rich' AS is_protected FROM ct)"""


def correlations(spark, d):
    return X.corr_table(indicators(spark, d), "n", ["people", "balance", "rich", "building"], ["rich"])


@query(f"WITH {CORR} SELECT * FROM corrs")
def corr_table(spark, d):
    return correlations(spark, d)


@query(f"WITH {CASES} SELECT grp, coalesce({rounded_sql('CAST(sum(CASE WHEN segment = ' + repr('BUILDING') + ' THEN k ELSE 0 END) AS DOUBLE) / nullif(sum(k), 0)')}, 0) AS share FROM (SELECT grp, segment, count(*) AS k FROM cases GROUP BY ALL) GROUP BY grp")
def urban_share(spark, d):
    return X.split_share(A.count_by(cases(spark, d), ["grp", "segment"], "k"), "grp", "segment", "BUILDING", "k")


VALIDATION = f"""{NAIVE_SQL}, actual AS (SELECT level, key, category, CAST(t AS INT) AS t, n AS y FROM series WHERE t > {END} AND t <= {END + 7}),
val AS (SELECT a.level, a.key, a.category, a.t, a.y, n.yhat, greatest(n.yhat - 1.96 * n.sigma * sqrt(n.h), 0) AS lower, greatest(n.yhat + 1.96 * n.sigma * sqrt(n.h), 0) AS upper, p.y AS same_month FROM actual a JOIN naive n USING (level, key, category, t) LEFT JOIN dense p ON p.level = a.level AND p.key = a.key AND p.category = a.category AND p.t = a.t - 12)"""


def validated(spark, d):
    """Forecasts against the complete months that no forecast saw, beside the same month a year before."""
    from fieldbook.plans.aggregate_queries import series

    actual = series(spark, d).where((F.col("t") > END) & (F.col("t") <= END + 7)).select(*KEYS, "t", F.col("n").alias("y"))
    before = dense(spark, d).select(*KEYS, (F.col("t") + 12).alias("t"), F.col("y").alias("same_month"))
    return actual.join(band(spark, d), [*KEYS, "t"]).join(before, [*KEYS, "t"], "left")


@query(f"WITH {VALIDATION} SELECT level, key, category, coalesce({rounded_sql('avg(CASE WHEN y > 0 THEN abs(y - yhat) / y END)')}, 0) AS mape FROM val GROUP BY ALL")
def mape(spark, d):
    return validated(spark, d).groupBy(*KEYS).agg(F.coalesce(S.rounded(X.mape(F.col("y"), F.col("yhat"))), F.lit(0.0)).alias("mape"))


@query(f"WITH {VALIDATION}, m AS (SELECT level, count(*) AS n, {rounded_sql('avg(CASE WHEN y > 0 THEN abs(y - yhat) / y END)')} AS ours, {rounded_sql('avg(CASE WHEN y > 0 THEN abs(y - same_month) / y END)')} AS naive, {rounded_sql('avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END)')} AS inside FROM val GROUP BY level) SELECT *, CASE WHEN naive - ours > 0.01 THEN 'beats' WHEN naive - ours >= -0.01 THEN 'matches' ELSE 'below' END AS verdict FROM m")
def forecast_validation(spark, d):
    v = validated(spark, d)
    inside = F.col("y").between(F.col("lower"), F.col("upper")).cast("double")
    m = v.groupBy("level").agg(F.count("*").alias("n"), S.rounded(X.mape(F.col("y"), F.col("yhat"))).alias("ours"), S.rounded(X.mape(F.col("y"), F.col("same_month"))).alias("naive"), S.rounded(F.avg(inside)).alias("inside"))
    return m.withColumn("verdict", X.verdict(F.col("ours"), F.col("naive"), 0.01, higher_is_better=False))


@query(f"""WITH {CASES}, m AS (SELECT grp, count(*) FILTER (year = 1999) AS prior, count(*) FILTER (year = 2000) AS actual, count(*) AS every FROM cases GROUP BY grp), r AS (SELECT abs(actual - prior) AS ours, abs(actual - every / 6.0) AS base, grp FROM m)
SELECT grp, CASE WHEN base - ours > 2 THEN 'beats' WHEN base - ours >= -2 THEN 'matches' ELSE 'below' END AS verdict FROM r""")
def verdict(spark, d):
    m = cases(spark, d).groupBy("grp").agg(F.count_if(F.col("year") == 1999).alias("prior"), F.count_if(F.col("year") == 2000).alias("actual"), F.count("*").alias("every"))
    return m.select("grp", X.verdict(F.abs(F.col("actual") - F.col("prior")), F.abs(F.col("actual") - F.col("every") / 6.0), 2, higher_is_better=False).alias("verdict"))


def _overlap(a: str, b: str) -> str:
    return f"(SELECT count(*) FROM (SELECT grp FROM rk ORDER BY {a} DESC, grp LIMIT 5) JOIN (SELECT grp FROM rk ORDER BY {b} DESC, grp LIMIT 5) USING (grp))"


@query(f"""WITH {CASES}, rk AS (SELECT grp, count(*) FILTER (year BETWEEN 1998 AND 1999) / 2.0 AS ours, count(*) FILTER (year = 1999) AS naive, count(*) FILTER (year = 2000) AS actual FROM cases GROUP BY grp),
s AS (SELECT (SELECT count(*) FROM rk) AS n, {rounded_sql(SPEARMAN.format(x='ours', y='actual', t='rk'), 6)} AS rho, {_overlap('ours', 'actual')} AS shared, {rounded_sql(SPEARMAN.format(x='naive', y='actual', t='rk'), 6)} AS naive_rho, {_overlap('naive', 'actual')} AS naive_shared)
SELECT *, CASE WHEN rho - naive_rho > 0.01 THEN 'beats' WHEN rho - naive_rho >= -0.01 THEN 'matches' ELSE 'below' END AS verdict FROM s""")
def rank_validation(spark, d):
    m = cases(spark, d).groupBy("grp").agg((F.count_if(F.col("year").between(1998, 1999)) / 2.0).alias("ours"), F.count_if(F.col("year") == 1999).alias("naive"), F.count_if(F.col("year") == 2000).alias("actual"))
    one = lambda c: m.select("grp", F.col(c).cast("double").alias("value"))
    return X.rank_validation(one("ours"), one("actual"), one("naive"), "grp")


SIGNALS = f"""{ALERTS}, tq AS (SELECT grp, count(*) AS n FROM cases WHERE year = 2000 GROUP BY grp), te AS (SELECT quantile_cont(n, [0.35, 0.6, 0.8]) AS e FROM tq), tiers AS (SELECT grp, CASE WHEN n <= e[1] THEN 0 WHEN n <= e[2] THEN 1 WHEN n <= e[3] THEN 2 ELSE 3 END AS tier FROM tq, te),
reds AS (SELECT grp, count(*) FILTER (severity = 'red') AS n_red FROM alerts GROUP BY grp), gm AS (SELECT grp, year, month, count(*) AS n FROM cases WHERE year <= 2000 GROUP BY ALL),
sx AS (SELECT *, avg(n) OVER w AS expected, coalesce(stddev_samp(n) OVER w, 0) AS std FROM gm WINDOW w AS (PARTITION BY grp, month)), odd AS (SELECT grp, count(*) AS n_anomalies FROM sx WHERE year = 2000 AND expected >= 5 AND n > expected AND ((n - expected) / (std + 1e-6) >= 1.8 OR n / greatest(expected, 1) >= 1.6) GROUP BY grp),
sig AS (SELECT coalesce(t.grp, r.grp, o.grp) AS grp, CAST(coalesce(tier, 0) AS BIGINT) AS tier, coalesce(n_red, 0) AS n_red, coalesce(n_anomalies, 0) AS n_anomalies FROM tiers t FULL JOIN reds r ON t.grp = r.grp FULL JOIN odd o ON o.grp = coalesce(t.grp, r.grp)),
conv AS (SELECT *, CAST(CAST(tier >= 2 AS INT) + CAST(n_red >= 1 AS INT) + CAST(n_anomalies >= 1 AS INT) AS INT) AS n_signals FROM sig),
hub AS (SELECT *, CAST(100 * n_signals + 10 * tier + least(n_red, 9) AS BIGINT) AS priority, n_signals = 3 AS shortlisted FROM conv)"""


def hub(spark, d):
    from fieldbook.operators.ranking import tiers
    from fieldbook.plans.series_queries import anomalies

    year = A.count_by(cases(spark, d).where("year = 2000"), ["grp"])
    tier = tiers(year, "n", [0.35, 0.6, 0.8], ["0", "1", "2", "3"], "t").select("grp", F.col("t").cast("bigint").alias("n"))
    red = alerts(spark, d).groupBy("grp").agg(F.count_if(F.col("severity") == "red").alias("n"))
    return X.convergence({"tier": tier, "red": red, "anomaly": A.count_by(anomalies(spark, d).where("year = 2000"), ["grp"])}, "grp")


@query(f"WITH {SIGNALS} SELECT * FROM hub")
def signal_convergence(spark, d):
    return hub(spark, d)


@query(f"""WITH {NAIVE_SQL}, f AS (SELECT level, key, category, sum(yhat) AS total, arg_min(t, struct_pack(a := -yhat, b := t)) AS peak_t FROM naive WHERE h <= 12 GROUP BY ALL), l AS (SELECT level, key, category, sum(y) AS last_year FROM dense WHERE t > {END - 12} GROUP BY ALL)
SELECT level, key, category, {rounded_sql('total', 2)} AS forecast_total, CAST(last_year AS BIGINT) AS last_year, coalesce({rounded_sql('100.0 * (total - last_year) / nullif(last_year, 0)', 2)}, 0) AS change_pct, CASE WHEN total >= last_year THEN 'rising' ELSE 'falling' END AS direction, CAST(peak_t % 12 + 1 AS INT) AS peak_month FROM f JOIN l USING (level, key, category)""")
def forecast_direction(spark, d):
    x = dense(spark, d)
    f = T.seasonal_naive(x, KEYS, "t", 12).groupBy(*KEYS).agg(F.sum("yhat").alias("total"), F.min(F.struct((-F.col("yhat")).alias("a"), "t")).alias("m"))
    last = x.where(F.col("t") > END - 12).groupBy(*KEYS).agg(F.sum("y").alias("last_year"))
    change = F.coalesce(S.rounded(F.try_divide(F.lit(100.0) * (F.col("total") - F.col("last_year")), F.col("last_year").cast("double")), 2), F.lit(0.0))
    return f.join(last, KEYS).select(*KEYS, S.rounded(F.col("total"), 2).alias("forecast_total"), "last_year", change.alias("change_pct"), F.when(F.col("total") >= F.col("last_year"), "rising").otherwise("falling").alias("direction"), (F.col("m.t") % 12 + 1).cast("int").alias("peak_month"))


