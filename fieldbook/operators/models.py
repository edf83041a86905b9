"""Supervised models, always beside their naive baselines."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.scalars import rounded
from fieldbook.operators import boosting
from fieldbook.operators.boosting import Boosted
from fieldbook.operators.ranking import top_values
from fieldbook.operators.stats import average_rank_auc


def label_map(column: str, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """1, 0, or null for labels that are left out."""
    return F.when(F.col(column).isin(*positive), 1).when(F.col(column).isin(*negative), 0)


def train_binary(df: DataFrame, label: str, categories: Sequence[str], numbers: Sequence[str], **options) -> Boosted:
    """Boosted trees on an integer 0/1 label, with the options of boosting.train (300 rounds of 63 leaves unless told otherwise); rows without a label are left out."""
    return boosting.train(df, label, categories, numbers, **options)[-1]


def scores(model: Boosted, df: DataFrame, into: str = "score") -> DataFrame:
    """Adds the probability of label 1."""
    return boosting.predicted(model, df, into)


def cross_validated(df: DataFrame, label: str, fold: str, folds: int, categories: Sequence[str], numbers: Sequence[str], **options) -> DataFrame:
    """(fold, n, auc, accuracy, f1, majority): each fold scored by a model that never saw it, beside the accuracy of the larger class. The models are fitted side by side."""
    models = boosting.train(df, label, categories, numbers, fold=fold, folds=folds, whole=False, **options)
    out = None
    for k in range(folds):
        test = df.where((F.col(fold) == k) & F.col(label).isNotNull())
        got = average_rank_auc(scores(models[k], test), label, "score")
        got = got.withColumn("fold", F.lit(k)).withColumn("majority", F.coalesce(rounded(F.greatest("n_positive", F.col("n") - F.col("n_positive")).cast("double") / F.col("n"), 6), F.lit(0.0)))
        out = got if out is None else out.unionByName(got)
    return out


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    """n, the modal class (ties to the smaller), its accuracy and macro F1."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    got = counts.agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.min(F.struct((-F.col("n")).alias("k"), F.col(label).alias("c"))).alias("m"))
    k = -F.col("m.k")
    return got.select("n", F.col("m.c").alias("majority"), rounded(k.cast("double") / F.col("n")).alias("accuracy"), rounded(2.0 * k / (k + F.col("n")) / F.col("classes")).alias("macro_f1"))


def train_multiclass(train: DataFrame, test: DataFrame, label: str, categories: Sequence[str], numbers: Sequence[str], **options) -> DataFrame:
    """One row: n, accuracy and macro F1 of softmax boosting (a tree for each class in a round) on the test rows, and the accuracy of the modal class there."""
    model = boosting.train(train, label, categories, numbers, objective="multiclass", **options)[-1]
    cells = boosting.predicted(model, test.where(F.col(label).isNotNull()), "_said").groupBy(F.col(label).cast("string").alias("a"), F.col("_said").alias("p")).agg(F.count("*").alias("n"))
    ends = cells.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit(0).alias("side")), F.struct(F.col("p").alias("c"), F.lit(1).alias("side")))).alias("x"), "a", "p", "n")
    per = ends.groupBy("x.c").agg(F.sum(F.when(F.col("x.side") == 0, F.col("n")).otherwise(0)).alias("actual"), F.sum(F.when(F.col("x.side") == 1, F.col("n")).otherwise(0)).alias("said"), F.sum(F.when((F.col("a") == F.col("p")) & (F.col("x.side") == 0), F.col("n")).otherwise(0)).alias("hit"))
    per = per.where("actual > 0")
    return per.agg(F.sum("actual").alias("n"), rounded(F.sum("hit").cast("double") / F.sum("actual")).alias("accuracy"), rounded(F.avg(2.0 * F.col("hit") / (F.col("actual") + F.col("said")))).alias("macro_f1"), rounded(F.max("actual").cast("double") / F.sum("actual")).alias("majority"))


def importances(spark: SparkSession, model: Boosted) -> DataFrame:
    """(feature, share): each feature's share of all gain, in percent; a row for each feature of the model."""
    gains = model.gains()
    total = sum(gains.values()) or 1.0
    return spark.createDataFrame([(n, round(100 * v / total, 4)) for n, v in gains.items()], "feature string, share double")


#: How the growth model is fitted: many rounds of small trees, since a panel has few rows.
GROWTH = {"rounds": 400, "leaves": 15, "least": 5, "rate": 0.03}


def fit_growth(panel: DataFrame, target: str, base: str, numbers: Sequence[str], year: str, holdout: int, low: float = 0.4, high: float = 2.5, **options) -> Boosted:
    """Boosted trees on the clipped ratio target / base of the years before the hold-out. Rows without base or target teach nothing."""
    ratio = F.least(F.greatest(F.col(target) / F.col(base), F.lit(low)), F.lit(high))
    train = panel.where((F.col(year) < holdout) & F.col(target).isNotNull() & (F.col(base) > 0)).withColumn("_label", ratio)
    return boosting.train(train, "_label", [], numbers, objective="regression", **(GROWTH | options))[-1]


def growth_model(panel: DataFrame, target: str, base: str, numbers: Sequence[str], year: str, holdout: int, low: float = 0.4, high: float = 2.5, **options) -> DataFrame:
    """Hold-out rows with predicted = base * predicted growth, clipped; trained on the years before."""
    model = fit_growth(panel, target, base, numbers, year, holdout, low, high, **options)
    got = boosting.predicted(model, panel.where(F.col(year) == holdout), "_growth")
    return got.select(*panel.columns, rounded(F.least(F.greatest(F.col("_growth"), F.lit(low)), F.lit(high)) * F.col(base), 2).alias("predicted"))


def regression_baselines(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(predictor, n, mae) of several predictions of one target."""
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("predictor"), F.col(c).cast("double").alias("x")) for c in columns)))
    long = df.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), pair.alias("p")).select("y", "p.*")
    return long.groupBy("predictor").agg(F.count("*").alias("n"), rounded(F.avg(F.abs(F.col("y") - F.col("x")))).alias("mae"))


def calibration_guard(df: DataFrame, predicted: str, actual: str, low: float = 0.6, high: float = 1.6, strict: bool = False) -> DataFrame:
    """One row: sum of the predictions by that of the last full period, and whether it lies within bounds; raises if strict and it doesn't."""
    got = df.agg(F.coalesce(rounded(F.try_divide(F.sum(predicted).cast("double"), F.sum(actual).cast("double"))), F.lit(0.0)).alias("ratio"))
    got = got.withColumn("within", F.col("ratio").between(low, high))
    if strict and not got.first()["within"]:
        raise ValueError("predictions are out of scale")
    return got


def row_drivers(model: Boosted, df: DataFrame, key: Sequence[str], k: int = 3, names: Mapping[str, str] | None = None, none: str = "") -> DataFrame:
    """(key, drivers): the k features with the largest positive Shapley values of each row, by names; `none` where nothing raises the row."""
    got = boosting.row_contributions(model, df, "_c")
    names = names or {}
    said = F.create_map(*(F.lit(x) for f in model.binning.names for x in (f, names.get(f, f))))
    top = F.slice(F.filter("_c", lambda x: x["value"] > 1e-12), 1, k)
    drivers = F.array_join(F.transform(top, lambda x: F.element_at(said, x["feature"])), "; ")
    return got.select(*key, F.when(F.size(top) > 0, drivers).otherwise(none).alias("drivers"))


#: Levels of a category that isn't bucketed; a contract lists them all, so more of them raise.
MOST_LEVELS = 1000


def make_contract(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], top: Mapping[str, int]) -> dict:
    """What must be done before a model is fitted and before it scores: feature order, kept values of bucketed columns, level order.

    A category that isn't bucketed and has more than MOST_LEVELS values raises ValueError: bucket it.
    """
    kept = {c: [r[0] for r in top_values(df, c, n).collect()] for c, n in top.items()}  # n values at most
    levels = {}
    for c in categories:
        found = kept[c] if c in kept else [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()]
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} values")
        levels[c] = sorted({*map(str, found), *(["OTHER"] if c in kept else [])})
    return {"features": [*categories, *numbers], "numbers": list(numbers), "kept": kept, "levels": levels}


def save_contract(model: Boosted, path: str, df: DataFrame, contract: Mapping, metrics: Mapping[str, float]) -> None:
    """The estimator with the contract it was fitted under, its metrics and its rows. A model must have seen what apply_contract makes."""
    spark = df.sparkSession
    contract = dict(contract) | {"metrics": dict(metrics), "rows": df.count()}
    spark.createDataFrame([(model.dumps(),)], "model string").write.mode("overwrite").text(f"{path}/model")
    spark.createDataFrame([(json.dumps(contract),)], "contract string").write.mode("overwrite").text(f"{path}/contract")


def read_contract(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/contract").first()[0])


def read_model(spark: SparkSession, path: str) -> Boosted:
    return Boosted.loads(spark.read.text(f"{path}/model").first()[0])


def apply_contract(df: DataFrame, contract: Mapping) -> DataFrame:
    """Raw columns as the model takes them: rare values OTHER, unseen levels null, numbers parsed (bad ones 0). A missing feature raises."""
    if missing := [c for c in contract["features"] if c not in df.columns]:
        raise ValueError(f"missing features: {', '.join(missing)}")
    made = {}
    for c in contract["features"]:
        if c in contract["numbers"]:
            made[c] = F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
            continue
        x = F.col(c).cast("string")
        if c in contract["kept"]:
            x = F.when(x.isin(*contract["kept"][c]), x).otherwise("OTHER")
        made[c] = F.when(x.isin(*contract["levels"][c]), x)
    return df.withColumns(made)


def score_batch(df: DataFrame, spark: SparkSession, path: str, defaults: Mapping[str, object], cut: float = 0.5) -> DataFrame:
    """Missing columns filled with defaults, the contract applied, scored, and flagged under the cut."""
    df = df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
    ready = apply_contract(df, read_contract(spark, path))
    return scores(read_model(spark, path), ready).withColumn("is_low", F.col("score") < cut)


def skew_check(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: rows that two preparations share, those that differ, the largest gap and their correlation."""
    j = a.select(key, F.col(value).cast("double").alias("x")).join(b.select(key, F.col(value).cast("double").alias("y")), key)
    return j.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("x") - F.col("y")) > 1e-9).alias("n_differ"), F.coalesce(rounded(F.max(F.abs(F.col("x") - F.col("y"))), 6), F.lit(0.0)).alias("largest_gap"), rounded(F.corr("x", "y"), 6).alias("correlation"))
