"""Queries that a reader of the results asks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import scalars as S
from fieldbook.operators import aggregates as A
from fieldbook.operators import graph as G
from fieldbook.operators import ranking as R
from fieldbook.operators import serve as V
from fieldbook.plans.aggregate_queries import PEAK, TIMED, TIMED_SQL
from fieldbook.plans.bindings import CASES, cases
from fieldbook.plans.graph_queries import COLLAPSED, COMMUNITIES, DEGREES, RULES, collapsed, communities, rules
from fieldbook.plans.join_queries import CONFORMANCE_SQL, DBSCAN, DIM, clusters, conformance, dim
from fieldbook.plans.registry import query, rounded_sql
from fieldbook.plans.scalar_queries import RULES as BUCKET_RULES
from fieldbook.plans.scalar_queries import _rules_sql
from fieldbook.plans.series_queries import ALERTS, ANOMALIES, HISTORY, alerts, anomalies, history
from fieldbook.plans.stats_queries import CORR, SIGNALS, correlations, hub
from fieldbook.session import table

GROUPS = "groups AS (SELECT grp, any_value(parent) AS parent, count(*) AS n, count(*) FILTER (status = 'F') AS flagged FROM cases GROUP BY grp)"


def groups(spark, d):
    return cases(spark, d).groupBy("grp", "parent").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("flagged"))


@query(f"""WITH {CASES}, {DIM}, {GROUPS}, k AS (SELECT * FROM groups WHERE grp IN (SELECT member FROM dim WHERE is_geographic)), t AS (SELECT grp, n FROM k ORDER BY n DESC, grp LIMIT 10)
SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS total, CAST(sum(flagged) AS BIGINT) AS flagged, {rounded_sql('CAST(sum(flagged) AS DOUBLE) / sum(n)')} AS flag_share, (SELECT string_agg(grp, '; ' ORDER BY n DESC, grp) FROM t) AS top FROM k""")
def overview(spark, d):
    return V.overview(groups(spark, d), "grp", dim(spark, d).where("is_geographic").select(F.col("member").alias("grp")), "n", "flagged")


@query(f"""WITH {CASES}, {GROUPS}, p AS (SELECT parent, count(*) * 1000 AS people FROM units GROUP BY parent), u AS (SELECT unit_id, parent, lat, lon, count(*) AS k FROM cases WHERE lat IS NOT NULL GROUP BY ALL),
c AS (SELECT parent, CAST(sum(k) AS BIGINT) AS weight, {rounded_sql('CAST(sum(CAST(lat AS DECIMAL(20,8)) * k) AS DOUBLE) / CAST(sum(k) AS DOUBLE)', 6)} AS lat, {rounded_sql('CAST(sum(CAST(lon AS DECIMAL(20,8)) * k) AS DOUBLE) / CAST(sum(k) AS DOUBLE)', 6)} AS lon FROM u GROUP BY parent)
SELECT g.parent, CAST(sum(n) AS BIGINT) AS n, any_value(people) AS people, any_value(weight) AS weight, any_value(lat) AS lat, any_value(lon) AS lon, {rounded_sql('sum(n) * 100000.0::DOUBLE / any_value(people)', 2)} AS rate_100k FROM groups g LEFT JOIN p ON g.parent = p.parent LEFT JOIN c ON g.parent = c.parent GROUP BY g.parent""")
def groups_list(spark, d):
    from fieldbook.plans.join_queries import _units

    people = _units(spark, d).groupBy("parent").agg((F.count("*") * 1000).alias("people"))
    centre = A.weighted_centroid(A.count_by(cases(spark, d), ["unit_id", "parent", "lat", "lon"], "k"), ["parent"], "lat", "lon", "k")
    return V.group_list(groups(spark, d), "parent", people, centre)


@query(f"""WITH {CASES}, k AS (SELECT * FROM cases WHERE grp = 'EUROPE' OR parent = 'EUROPE'), s AS (SELECT 'year' AS section, CAST(year AS VARCHAR) || CASE WHEN year = 2001 THEN ' (partial)' ELSE '' END AS label, count(*) AS n FROM k GROUP BY ALL
UNION ALL SELECT 'month', printf('%04d-%02d', year, month), count(*) FROM k GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM k GROUP BY ALL
UNION ALL SELECT 'unit', CAST(unit_id AS VARCHAR), count(*) FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, label) AS r FROM s)
SELECT section, label, n FROM r WHERE section NOT IN ('category', 'unit') OR r <= CASE section WHEN 'unit' THEN 10 ELSE 12 END""")
def group_drilldown(spark, d):
    return V.drilldown(cases(spark, d), "grp", "EUROPE", "parent", 2001)


CELL = f"{rounded_sql('lat', 1)} AS cell_lat, {rounded_sql('lon', 1)} AS cell_lon"


@query(f"WITH {CASES}, c AS (SELECT {CELL}, count(*) AS n FROM cases WHERE lat IS NOT NULL AND segment IN ('BUILDING', 'MACHINERY') GROUP BY ALL) SELECT *, (SELECT count(*) > 200 FROM c) AS capped FROM c ORDER BY n DESC, cell_lat, cell_lon LIMIT 200")
def heat_cells(spark, d):
    c = cases(spark, d).where(F.col("segment").isin("BUILDING", "MACHINERY"))
    return V.heat(A.grid(c, "lat", "lon", ["year"], places=1), None, 200)


@query(f"WITH RECURSIVE {DBSCAN} SELECT cluster, count(*) AS n_cells, CAST(sum(w) AS BIGINT) AS total FROM clusters WHERE cluster >= 0 GROUP BY cluster ORDER BY total DESC, cluster LIMIT 20")
def cluster_list(spark, d):
    c = clusters(spark, d).where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n_cells"), F.sum("w").alias("total"))
    return c.orderBy(F.desc("total"), "cluster").limit(R.clamp("20", 500, 50))


@query(f"""WITH {CASES}, b AS (SELECT {CELL}, {TIMED_SQL} AS bucket, count(*) AS n FROM cases WHERE lat IS NOT NULL AND year = 1999 GROUP BY ALL) SELECT cell_lat, cell_lon, bucket, n, CAST(sum(n) OVER (PARTITION BY bucket) AS BIGINT) AS bucket_total FROM b WHERE bucket IS NOT NULL""")
def timed_cells(spark, d):
    c = cases(spark, d).withColumn("bucket", S.observed_bucket("category", TIMED))
    cells = V.only(A.grid(c, "lat", "lon", ["bucket", "year"], places=1, where=F.col("bucket").isNotNull()), year=1999).drop("year")
    return cells.join(cells.groupBy("bucket").agg(F.sum("n").alias("bucket_total")), "bucket")


@query(f"WITH {CASES} SELECT unit_id, parent, {rounded_sql('lat', 3)} AS lat, {rounded_sql('lon', 3)} AS lon, count(*) AS n FROM cases WHERE lat IS NOT NULL AND parent = 'ASIA' GROUP BY ALL")
def unit_points(spark, d):
    c = V.only(cases(spark, d).where("lat is not null"), parent="ASIA").groupBy("unit_id", "parent", "lat", "lon").agg(F.count("*").alias("n"))
    return c.select("unit_id", "parent", S.rounded(F.col("lat"), 3).alias("lat"), S.rounded(F.col("lon"), 3).alias("lon"), "n").orderBy(F.desc("n"), "unit_id")


BUCKETS = ("big", "little", "metal", "coloured", "other")


@query(f"SELECT {_rules_sql('p_name', 1, repr('other'))} AS bucket, {_rules_sql('p_name', 2, repr('none'))} AS method, count(*) AS n, CAST(CASE {_rules_sql('p_name', 1, repr('other'))} " + " ".join(f"WHEN '{b}' THEN {i + 1}" for i, b in enumerate(BUCKETS)) + " END AS INT) AS place FROM part GROUP BY ALL")
def bucket_distribution(spark, d):
    p = table(spark, d, "part").select(S.first_match("p_name", BUCKET_RULES, ("other", "none")).alias("m")).select("m.*")
    return A.count_by(p, ["bucket", "method"]).withColumn("place", V.ordered_values("bucket", BUCKETS).cast("int")).orderBy("place", "method")


@query(f"WITH {HISTORY} SELECT level, key, category, t, y_actual, yhat, lower, upper, CAST(is_forecast AS INT) AS is_forecast, method FROM history WHERE level = 'group' AND key = (SELECT min(key) FROM history WHERE level = 'group')")
def forecast_series(spark, d):
    return V.one_series(history(spark, d), "group", None, None).orderBy("t")


@query(f"WITH {CASES} SELECT DISTINCT grp, category FROM cases")
def forecast_options(spark, d):
    return cases(spark, d).select("grp", "category").distinct().orderBy("grp", "category")


@query(f"WITH {ALERTS} SELECT *, count(*) OVER (PARTITION BY severity) AS severity_count FROM alerts")
def alerts_list(spark, d):
    return V.counted(alerts(spark, d), "severity").orderBy(V.ordered_values("severity", ["red", "amber"]), F.desc("deviation_pct"), "grp", "category")


RISK = f"{CASES}, g AS (SELECT grp, any_value(parent) AS parent, count(*) AS n FROM cases WHERE year = 2000 GROUP BY grp), e AS (SELECT ln(1 + min(n)) AS lo, ln(1 + max(n)) AS hi, quantile_cont(n, [0.35, 0.6, 0.8]) AS e FROM g), risk AS (SELECT grp, parent, n, {rounded_sql('8 + 92 * (ln(1 + n) - lo) / (hi - lo)')} AS score, CASE WHEN n <= e[1] THEN 'Low' WHEN n <= e[2] THEN 'Moderate' WHEN n <= e[3] THEN 'High' ELSE 'Critical' END AS tier FROM g, e)"


def risk(spark, d):
    g = cases(spark, d).where("year = 2000").groupBy("grp", "parent").agg(F.count("*").alias("n"))
    got = R.tiers(R.log_index(g, "n", "score"), "n", [0.35, 0.6, 0.8], ["Low", "Moderate", "High", "Critical"], "tier")
    return got.withColumn("score", S.rounded(F.col("score")))


@query(f"WITH {RISK} SELECT *, count(*) OVER (PARTITION BY tier) AS tier_count FROM risk")
def risk_list(spark, d):
    return V.counted(risk(spark, d), "tier").orderBy(F.desc("score"), "grp")


@query(f"WITH {RISK} SELECT grp, parent, n, score, tier FROM risk WHERE grp = 'NATION_3' OR (parent = 'EUROPE' AND grp = 'NATION_8')")
def risk_one(spark, d):
    both = risk(spark, d)
    return V.one_or_parent(both, "grp", "Bavaria", {"Bavaria": "NATION_3"}).unionByName(V.one_or_parent(both, "grp", "NATION_8", {}))


@query(f"WITH {ANOMALIES}, k AS (SELECT * FROM anomalies WHERE year = 1999) SELECT *, (SELECT count(*) FROM k) AS total_rows FROM k ORDER BY z DESC, grp, month LIMIT 10")
def anomalies_list(spark, d):
    return V.with_total(V.only(anomalies(spark, d), year=1999, grp=None), [F.desc("z"), "grp", "month"], 10, 500)


@query(f"WITH {PEAK} SELECT f.dow, f.month, f.n, CAST(sum(f.n) OVER (PARTITION BY f.dow) AS BIGINT) AS dow_total, CAST(sum(f.n) OVER (PARTITION BY f.month) AS BIGINT) AS month_total, p.peak_dow, p.peak_month FROM f, p")
def temporal_heatmap(spark, d):
    c = A.count_by(cases(spark, d).withColumn("dow", S.day_of_week("day")), ["dow", "month"], "k")
    full = R.grid_peak(c, "dow", 7, "month", 12, "k").select("dow", "month", "n", "peak_dow", "peak_month")
    return full.join(full.groupBy("dow").agg(F.sum("n").alias("dow_total")), "dow").join(full.groupBy("month").agg(F.sum("n").alias("month_total")), "month")


@query(f"""WITH {CASES}, {DIM}, g AS (SELECT grp, count(*) FILTER (status = 'F') AS p, count(*) FILTER (status = 'O') AS q FROM cases WHERE grp IN (SELECT member FROM dim WHERE is_geographic) GROUP BY grp), u AS (SELECT grp, p, q FROM g UNION ALL SELECT 'ALL', CAST(sum(p) AS BIGINT), CAST(sum(q) AS BIGINT) FROM g)
SELECT grp, p AS n_positive, q AS n_negative, coalesce({rounded_sql('CAST(p AS DOUBLE) / nullif(p + q, 0)')}, 0) AS rate FROM u""")
def outcome_list(spark, d):
    keys = dim(spark, d).where("is_geographic").select(F.col("member").alias("grp"))
    g = A.outcome_rates(cases(spark, d).join(keys, "grp", "left_semi"), ["grp"], "status", ["F"], ["O"]).select("grp", "n_positive", "n_negative")
    both = g.unionByName(g.agg(F.sum("n_positive").alias("n_positive"), F.sum("n_negative").alias("n_negative")).withColumn("grp", F.lit("ALL")))
    return both.withColumn("rate", S.safe_rate("n_positive", F.col("n_positive") + F.col("n_negative")))


@query(f"WITH {COLLAPSED}, {DEGREES}, h AS (SELECT *, split_part(node, ':', 1) AS type FROM deg WHERE contains(lower(node), 'brand#2')) SELECT *, count(*) OVER (PARTITION BY type) AS type_count FROM h ORDER BY weighted_degree DESC, node LIMIT 8 OFFSET 1")
def entity_search(spark, d):
    return V.search(G.degrees(collapsed(spark, d)), "BRAND#2", None, "weighted_degree", ["weighted_degree", "degree"], 8, 1)


@query(f"""WITH {COMMUNITIES}, e AS (SELECT x.community AS ca, y.community AS cb, lw AS w FROM col JOIN labels x ON a = x.node JOIN labels y ON b = y.node), ends AS (SELECT ca AS c, w, CASE WHEN ca = cb THEN w ELSE 0 END AS l FROM e UNION ALL SELECT cb, w, 0 FROM e), per AS (SELECT c, sum(w) AS d, sum(l) AS l FROM ends GROUP BY c), m AS (SELECT sum(d) / 2 AS m FROM per)
SELECT communities.*, (SELECT {rounded_sql('sum(l) / any_value(m) - sum(d * d) / (4 * any_value(m) * any_value(m))', 6)} FROM per, m) AS modularity FROM communities""")
def community_list(spark, d):
    from fieldbook.plans.graph_queries import labels

    q = G.modularity(collapsed(spark, d), labels(spark, d)).select("modularity")
    return communities(spark, d).crossJoin(F.broadcast(q)).orderBy(F.desc("total"))


@query(f"WITH {RULES}, k AS (SELECT *, count(*) OVER (PARTITION BY rule_type) AS rule_type_count FROM rules WHERE contains(lower(src), 'brand#1') OR contains(lower(dst), 'brand#1')) SELECT * FROM k ORDER BY lift DESC, cases DESC, src_type, src, dst_type, dst LIMIT 100")
def rule_list(spark, d):
    return V.rule_list(rules(spark, d), None, "Brand#1", "nonsense")


@query(f"""WITH {CASES}, p AS (SELECT unit_id, count(*) AS n, count(DISTINCT status) AS n_groups FROM cases GROUP BY unit_id HAVING count(*) >= 2) SELECT *, (SELECT count(*) FROM p WHERE n_groups > 1) AS n_cross FROM p ORDER BY n_groups DESC, n DESC, unit_id LIMIT 50""")
def entity_profiles(spark, d):
    p = A.entity_profiles(cases(spark, d), "unit_id", "case_id", "status", "category", "year").select("unit_id", "n", "n_groups")
    cross = p.agg(F.count_if(F.col("n_groups") > 1).alias("n_cross"))
    return p.orderBy(F.desc("n_groups"), F.desc("n"), "unit_id").limit(50).crossJoin(F.broadcast(cross))


@query(f"WITH {CORR} SELECT *, CASE WHEN is_protected THEN 'protected' ELSE 'shown' END AS part, CAST(row_number() OVER (PARTITION BY is_protected ORDER BY abs(r) DESC, indicator) AS INT) AS place FROM corrs")
def correlation_view(spark, d):
    from pyspark.sql import Window

    c = correlations(spark, d).withColumn("part", F.when(F.col("is_protected"), "protected").otherwise("shown"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("is_protected").orderBy(F.desc(F.abs("r")), "indicator")))


@query(f"""WITH {CASES}, m AS (SELECT grp, count(*) FILTER (year = 1999) AS prior, count(*) FILTER (year = 2000) AS actual, count(*) AS every FROM cases GROUP BY grp), r AS (SELECT abs(actual - prior) AS ours, abs(actual - every / 6.0) AS base FROM m)
SELECT count(*) AS n, count(*) FILTER (base - ours >= -2) AS at_or_above FROM r""")
def validation_view(spark, d):
    from fieldbook.plans.stats_queries import verdict

    return verdict(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") != "below").alias("at_or_above"))


@query(f"""WITH {SIGNALS}, a AS (SELECT grp, category, deviation_pct FROM alerts ORDER BY severity DESC, deviation_pct DESC, grp, category LIMIT 8) SELECT 'shortlist' AS section, grp AS item, CAST(priority AS DOUBLE) AS value FROM hub WHERE shortlisted
UNION ALL SELECT 'alert', grp || ' / ' || category, deviation_pct FROM a UNION ALL SELECT 'kpi', 'cases', CAST(count(*) AS DOUBLE) FROM cases UNION ALL SELECT 'kpi', 'groups', CAST(count(DISTINCT grp) AS DOUBLE) FROM cases""")
def briefing_data(spark, d):
    short = hub(spark, d).where("shortlisted").select(F.lit("shortlist").alias("section"), F.col("grp").alias("item"), F.col("priority").cast("double").alias("value"))
    top = alerts(spark, d).orderBy(V.ordered_values("severity", ["red", "amber"]), F.desc("deviation_pct"), "grp", "category").limit(8)
    top = top.select(F.lit("alert").alias("section"), F.concat_ws(" / ", "grp", "category").alias("item"), F.col("deviation_pct").alias("value"))
    one = cases(spark, d).agg(F.count("*").alias("cases"), F.countDistinct("grp").alias("groups"))
    kpi = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in ("cases", "groups")))).alias("x")).select(F.lit("kpi").alias("section"), "x.*")
    return short.unionByName(top).unionByName(kpi)


@query(f"WITH {CASES} SELECT 'located' AS measure, {rounded_sql('CAST(count(lat) AS DOUBLE) / count(*)')} AS value FROM cases UNION ALL SELECT 'share ' || segment, {rounded_sql('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM cases)')} FROM cases GROUP BY segment")
def audit_summary(spark, d):
    return V.coverage(cases(spark, d), "lat", "segment")


@query(f"WITH {CONFORMANCE_SQL} SELECT status, blocker, count(*) AS n FROM conf GROUP BY ALL")
def contract_view(spark, d):
    return A.count_by(conformance(spark, d), ["status", "blocker"])
