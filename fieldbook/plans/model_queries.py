"""Queries of the supervised models and the profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldbook.functions import scalars as S
from fieldbook.operators import models as M
from fieldbook.operators import profiles as P
from fieldbook.operators import ranking as R
from fieldbook.operators.density import vector_silhouette
from fieldbook.operators.guards import feature_guard
from fieldbook.operators.stats import average_rank_auc, verdict
from fieldbook.plans.bindings import CASES, LINES, cases, lines
from fieldbook.plans.registry import query, rounded_sql
from fieldbook.plans.series_queries import PANEL, panel
from fieldbook.session import checkpoint_folder, settled, table, written

CATEGORIES, NUMBERS = ["category", "segment", "parent"], ["month", "dow", "n_items"]
MODEL = f"""{CASES}, {LINES}, k AS (SELECT case_id, count(*) AS n_items, min(item) AS first_item FROM lines GROUP BY case_id), mt AS (SELECT case_id, year, month, CAST(isodow(day) - 1 AS INT) AS dow, CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month <= 5 THEN 'Summer' WHEN month <= 9 THEN 'Monsoon' ELSE 'Post-Monsoon' END AS season,
  category, segment, parent, coalesce(n_items, 0) AS n_items, coalesce(first_item, 'NONE') AS first_item, status FROM cases LEFT JOIN k USING (case_id))"""


def features(spark, d):
    """Leakage-safe features of each case, and its label."""
    k = lines(spark, d).groupBy("case_id").agg(F.count("*").alias("n_items"), F.min("item").alias("first_item"))
    c = cases(spark, d).join(k, "case_id", "left")
    got = c.select("case_id", "year", "month", S.day_of_week("day").alias("dow"), S.season("month").alias("season"), "category", "segment", "parent", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("first_item", F.lit("NONE")).alias("first_item"), "status")
    return feature_guard(got, ["amount", "unit_id"])


@query(f"WITH {MODEL} SELECT * FROM mt")
def model_table(spark, d):
    return features(spark, d)


@query(f"WITH {CASES} SELECT case_id, CAST(CASE WHEN status = 'F' THEN 1 WHEN status = 'O' THEN 0 END AS DOUBLE) AS label FROM cases")
def label_map(spark, d):
    return cases(spark, d).select("case_id", M.label_map("status", ["F"], ["O"]).cast("double").alias("label"))


def _labelled(spark, d, f=None):
    """Made from features that are written once, since folds read them twice."""
    got = (written(features(spark, d)) if f is None else f).withColumn("label", M.label_map("status", ["F"], ["O"])).where("label is not null")
    return settled(R.stratified_folds(got, "label", ["case_id"], 3))


@query()
def train_binary(spark, d):
    return M.cross_validated(_labelled(spark, d), "label", "fold", 3, CATEGORIES, NUMBERS)


@query()
def train_multiclass(spark, d):
    f = written(features(spark, d))  # a fit reads its rows once for each category, and more
    return M.train_multiclass(f.where("year < 2000"), f.where("year >= 2000"), "category", ["segment", "parent", "season"], NUMBERS)


@query(f"""WITH {CASES}, g AS (SELECT category, count(*) AS n FROM cases GROUP BY category), t AS (SELECT sum(n) AS n, count(*) AS k FROM g), m AS (SELECT category, n AS top FROM g ORDER BY n DESC, category LIMIT 1)
SELECT CAST(n AS BIGINT) AS n, category AS majority, {rounded_sql('CAST(top AS DOUBLE) / n')} AS accuracy, {rounded_sql('2.0::DOUBLE * top / (top + n) / k')} AS macro_f1 FROM t, m""")
def majority_baseline(spark, d):
    return M.majority_baseline(cases(spark, d), "category")


SCORED = "scored AS (SELECT quality AS l, CAST(round((n_chars % 997) / 997.0, 6) AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM scored), a AS (SELECT count(*) AS n, CAST(sum(l) AS BIGINT) AS n_positive, sum(CASE WHEN l = 1 THEN rk END) AS rs, count(*) FILTER ((s >= 0.5) = (l = 1)) AS hits, count(*) FILTER (s >= 0.5) AS said, count(*) FILTER (s >= 0.5 AND l = 1) AS tp FROM r)
SELECT n, n_positive, {rounded_sql('(rs - n_positive * (n_positive + 1) / 2.0) / (CAST(n_positive AS DOUBLE) * (n - n_positive))', 6)} AS auc, {rounded_sql('CAST(hits AS DOUBLE) / n', 6)} AS accuracy, {rounded_sql('2.0::DOUBLE * tp / (said + n_positive)', 6)} AS f1 FROM a""")
def class_metrics(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality is not null")
    return average_rank_auc(j.select("quality", F.round((F.col("n_chars") % 997) / 997.0, 6).alias("s")), "quality", "s")


@query()
def importances(spark, d):
    model = M.train_binary(_labelled(spark, d), "label", CATEGORIES, NUMBERS)
    return M.importances(spark, model)


@query()
def driver_list(spark, d):
    labels = {"category": "Priority", "segment": "Market", "parent": "Region", "month": "Month", "dow": "Day of week", "n_items": "Lines"}
    names = spark.createDataFrame(list(labels.items()), "feature string, label string")
    return importances(spark, d).join(names, "feature", "left").orderBy(F.desc("share"), "feature")


PANEL_BASE = f"{PANEL}, pb AS (SELECT 'lag1' AS predictor, CAST(target AS DOUBLE) AS y, CAST(lag1 AS DOUBLE) AS x FROM panel WHERE year = 2000 UNION ALL SELECT 'avg3', CAST(target AS DOUBLE), avg3 FROM panel WHERE year = 2000)"


@query(f"WITH {PANEL_BASE} SELECT predictor, count(*) AS n, {rounded_sql('avg(abs(y - x))')} AS mae FROM pb GROUP BY predictor")
def risk_panel_baselines(spark, d):
    return M.regression_baselines(panel(spark, d).where("year = 2000"), "target", ["lag1", "avg3"])


GROWTH_NAMES = {"lag1": "Last year", "lag2": "Year before last", "avg3": "Three-year mean", "slope": "Trend", "yoy": "Latest change"}
GROWTH_NUMBERS = list(GROWTH_NAMES)


def _grown(spark, d):
    return M.growth_model(panel(spark, d), "target", "lag1", GROWTH_NUMBERS, "year", 2000)


@query()
def risk_panel_model(spark, d):
    return M.regression_baselines(_grown(spark, d), "target", ["predicted", "lag1", "avg3"])


@query(f"WITH {PANEL} SELECT {rounded_sql('CAST(sum(avg3) AS DOUBLE) / sum(target)')} AS ratio, {rounded_sql('CAST(sum(avg3) AS DOUBLE) / sum(target)')} BETWEEN 0.6 AND 1.6 AS within FROM panel WHERE year = 2000")
def calibration_guard(spark, d):
    return M.calibration_guard(panel(spark, d).where("year = 2000"), "avg3", "target", strict=True)


@query(f"WITH {PANEL} SELECT grp, CAST(year AS INT) AS year, true AS explained FROM panel WHERE year = 2000")
def row_drivers(spark, d):
    """Of each group's projected growth; SQL holds the row set, since the values are the model's."""
    known = panel(spark, d)
    got = M.row_drivers(M.fit_growth(known, "target", "lag1", GROWTH_NUMBERS, "year", 2000), known.where("year = 2000"), ["grp", "year"], names=GROWTH_NAMES, none="mixed factors")
    return got.select("grp", F.col("year").cast("int").alias("year"), (F.length("drivers") > 0).alias("explained"))


@query()
def growth_drivers(spark, d):
    known = panel(spark, d)
    return M.row_drivers(M.fit_growth(known, "target", "lag1", GROWTH_NUMBERS, "year", 2000), known.where("year = 2000"), ["grp"], names=GROWTH_NAMES, none="mixed factors")


def _saved(spark, d, f=None) -> str:
    path = f"{checkpoint_folder(spark)}/model-{uuid.uuid4().hex}"
    categories = ["category", "first_item", "parent"]
    f = _labelled(spark, d, f)
    contract = M.make_contract(f, categories, NUMBERS, {"first_item": 8})
    model = M.train_binary(M.apply_contract(f, contract), "label", categories, NUMBERS)
    M.save_contract(model, path, f, contract, {"folds": 3.0})
    return path


@query(f"""WITH {MODEL}, known AS (SELECT * FROM mt WHERE status IN ('F', 'O')), top AS (SELECT first_item FROM known GROUP BY first_item ORDER BY count(*) DESC, first_item LIMIT 8)
SELECT status, count(*) AS n, 'category; first_item; parent; month; dow; n_items' AS features, (SELECT count(*) FROM known) AS model_rows, (SELECT string_agg(x, '; ' ORDER BY x) FROM (SELECT first_item AS x FROM top UNION ALL SELECT 'OTHER')) AS levels FROM mt GROUP BY status""")
def save_contract(spark, d):
    f = written(features(spark, d))
    c = M.read_contract(spark, _saved(spark, d, f))
    told = {"features": F.lit("; ".join(c["features"])), "model_rows": F.lit(c["rows"]).cast("bigint"), "levels": F.lit("; ".join(c["levels"]["first_item"]))}
    return f.groupBy("status").agg(F.count("*").alias("n")).withColumns(told)


CONTRACT = {"features": ["item", "kind", "quantity"], "numbers": ["quantity"], "kept": {"item": ["Brand#11", "Brand#12"]}, "levels": {"item": ["Brand#11", "Brand#12", "OTHER"], "kind": ["ECONOMY", "PROMO"]}}


@query(f"WITH {LINES} SELECT CASE WHEN item IN ('Brand#11', 'Brand#12') THEN item ELSE 'OTHER' END AS item, CASE WHEN kind IN ('ECONOMY', 'PROMO') THEN kind END AS kind, count(*) AS n, CAST(sum(CASE WHEN quantity % 5 = 0 THEN 0 ELSE quantity END) AS DOUBLE) AS quantity FROM lines GROUP BY ALL")
def apply_contract(spark, d):
    raw = lines(spark, d).select("item", "kind", F.when(F.col("quantity") % 5 == 0, "bad").otherwise(F.col("quantity").cast("string")).alias("quantity"))
    return M.apply_contract(raw, CONTRACT).groupBy("item", "kind").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query()
def score_batch(spark, d):
    got = M.score_batch(features(spark, d).drop("dow"), spark, _saved(spark, d), {"dow": 0})
    return got.select("case_id", S.rounded(F.col("score"), 6).alias("score"), "is_low")


@query(f"""WITH {CASES}, s AS (SELECT isodow(day) - 1 AS x, isodow(CASE WHEN case_id % 7 = 0 THEN day + 2 ELSE day END) - 1 AS y FROM cases)
SELECT count(*) AS n, count(*) FILTER (x <> y) AS n_differ, CAST(max(abs(x - y)) AS DOUBLE) AS largest_gap, CAST(round(corr(x, y), 6) AS DOUBLE) AS correlation FROM s""")
def skew_check(spark, d):
    """The day of the week as training takes it, and as a second preparation does that parses it from text and is two days off for every seventh case."""
    c = cases(spark, d)
    late = F.when(F.col("case_id") % 7 == 0, F.date_add("day", 2)).otherwise(F.col("day"))
    other = c.select("case_id", F.weekday(F.try_to_date(F.date_format(late, "yyyy-MM-dd"), "yyyy-MM-dd")).alias("dow"))
    return M.skew_check(c.select("case_id", S.day_of_week("day").alias("dow")), other, "case_id", "dow")


@query()
def matched_benchmark(spark, d):
    f = _labelled(spark, d)
    train, held = f.where("fold <> 0"), f.where("fold = 0")
    ours = average_rank_auc(M.scores(M.train_binary(train, "label", CATEGORIES, NUMBERS), held), "label", "score").select(F.lit("boosted").alias("model"), "n", "auc")
    small = settled(average_rank_auc(M.scores(M.train_binary(train, "label", [], NUMBERS), held), "label", "score").select(F.lit("numbers only").alias("model"), "n", "auc"))  # read twice
    both = ours.unionByName(small)
    return both.crossJoin(F.broadcast(small.select(F.col("auc").alias("baseline_auc")))).withColumn("verdict", verdict(F.col("auc"), F.col("baseline_auc"), 0.01))


# Profiles


SIGNED = {"category": 5, "segment": 5, "status": 3, "grp": 12}


def _sigs(spark, d):
    return P.signatures(cases(spark, d).select(*SIGNED), SIGNED)


WEIGHTS = {"category": 3.0, "segment": 2.0, "status": 1.0, "grp": 1.0}


def _kept_sql(c: str, n: int) -> str:
    return f"CASE WHEN {c} IN (SELECT {c} FROM cases GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT {n}) THEN {c} ELSE 'OTHER' END AS {c}"


@query(f"WITH {CASES}, s AS (SELECT {_kept_sql('category', 5)}, {_kept_sql('segment', 5)}, {_kept_sql('status', 3)}, {_kept_sql('grp', 12)} FROM cases) SELECT category, segment, status, grp, count(*) AS w, CAST(5 AS INT) AS size FROM s GROUP BY ALL")
def profile_vectors(spark, d):
    """The components themselves have no sign; the row set, the weights and the sizes are compared."""
    v = P.profile_vectors(_sigs(spark, d), WEIGHTS)
    return v.select("category", "segment", "status", "grp", "w", F.size("vector").alias("size"))


def _clustered(spark, d):
    vectors = settled(P.profile_vectors(settled(_sigs(spark, d)), WEIGHTS))
    return vectors, settled(P.profile_cluster(vectors, "signature", "w", 60, 20))


@query()
def profile_cluster(spark, d):
    return _clustered(spark, d)[1]


@query()
def profile_quality(spark, d):
    """How many clusters there are, the share of rows that is noise, and the mean silhouette in the reduced space."""
    vectors, found = _clustered(spark, d)
    return vector_silhouette(vectors.join(found, "signature"), "signature", "w", "vector", "cluster")


@query()
def profile_assign(spark, d):
    """The cluster of profile_cluster that most rows of each group are in, the groups of each cluster by rows."""
    rows = P.bucketed(cases(spark, d).select(*SIGNED), SIGNED).join(_clustered(spark, d)[1].where("cluster >= 0"), "signature")
    return P.signature_assign(rows, "grp", "cluster")


@query()
def profile_report(spark, d):
    """The clusters that profile_cluster finds, described by their cases."""
    rows = P.bucketed(cases(spark, d).select(*SIGNED), SIGNED).join(_clustered(spark, d)[1], "signature")
    return P.profile_describe(rows, "cluster", "category", ["segment", "status"], "grp")


@query(f"""WITH {CASES}, c AS (SELECT CAST(unit_id % 4 AS INT) - 1 AS cluster, category, segment, status, grp FROM cases), k AS (SELECT * FROM c WHERE cluster >= 0),
h AS (SELECT cluster, category, n FROM (SELECT cluster, category, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, category) AS r FROM k GROUP BY cluster, category) WHERE r = 1),
m AS (SELECT k.* FROM k JOIN h ON k.cluster = h.cluster AND k.category = h.category), s AS (SELECT cluster, segment FROM (SELECT cluster, segment, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, segment) AS r FROM m GROUP BY cluster, segment) WHERE r = 1),
g AS (SELECT cluster, string_agg(grp, '; ' ORDER BY r) AS groups FROM (SELECT cluster, grp, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, grp) AS r FROM k GROUP BY cluster, grp) WHERE r <= 3 GROUP BY cluster), z AS (SELECT cluster, count(*) AS size FROM k GROUP BY cluster)
SELECT z.cluster, size, {rounded_sql('CAST(size AS DOUBLE) / (SELECT count(*) FROM k)')} AS share, h.category, {rounded_sql('CAST(h.n AS DOUBLE) / size')} AS purity, s.segment, g.groups FROM z JOIN h USING (cluster) JOIN s USING (cluster) JOIN g USING (cluster)""")
def profile_describe(spark, d):
    c = cases(spark, d).select(((F.col("unit_id") % 4).cast("int") - 1).alias("cluster"), "category", "segment", "status", "grp")
    return P.profile_describe(c, "cluster", "category", ["segment"], "grp")


ASSIGN = "a AS (SELECT grp, CAST(unit_id % 4 AS INT) AS cluster, count(*) AS n FROM cases GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, cluster) AS r FROM a), assigned AS (SELECT grp, cluster, n FROM b WHERE r = 1)"


def assigned(spark, d):
    return P.signature_assign(cases(spark, d).select("grp", (F.col("unit_id") % 4).cast("int").alias("cluster")), "grp", "cluster")


@query(f"WITH {CASES}, {ASSIGN} SELECT * FROM assigned")
def signature_assign(spark, d):
    return assigned(spark, d)


@query(f"WITH {CASES}, {ASSIGN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, grp) AS INT) AS place FROM assigned) SELECT * FROM r WHERE place <= 8")
def profile_list(spark, d):
    from pyspark.sql import Window

    return assigned(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "grp"))).where("place <= 8")
