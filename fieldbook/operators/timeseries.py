"""Monthly series: dense spines, expectations, forecasts, alerts and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.operators.ranking import quantiles
from fieldbook.session import settled


def seasonal_expectation(df: DataFrame, group: Sequence[str], month: str, value: str) -> DataFrame:
    """Mean over the same calendar month of a group (the row itself included), residual, z and log ratio; absent months are absent."""
    w = Window.partitionBy(*group, month)
    got = df.withColumn("expected", F.avg(value).over(w)).withColumn("_std", F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)))
    got = got.withColumn("residual", F.col(value) - F.col("expected"))
    return got.withColumn("z", F.col("residual") / (F.col("_std") + 1e-6)).withColumn("log_ratio", F.log((F.col(value) + 1) / (F.col("expected") + 1))).drop("_std")


def densify(df: DataFrame, keys: Sequence[str], t: str, value: str, end: int) -> DataFrame:
    """(keys, t, y): every month from the first non-zero one of a series to `end`, zeros where there is no row."""
    own = df.where((F.col(t) <= end) & (F.col(value) > 0)).groupBy(*keys, t).agg(F.sum(value).cast("bigint").alias("y"))
    spine = own.groupBy(*keys).agg(F.min(t).alias("_first")).select(*keys, F.explode(F.sequence(F.col("_first").cast("int"), F.lit(end))).alias(t))
    return spine.join(own, [*keys, t], "left").select(*keys, t, F.coalesce("y", F.lit(0)).cast("bigint").alias("y"))


def seasonal_naive(dense: DataFrame, keys: Sequence[str], t: str, horizon: int, season: int = 12) -> DataFrame:
    """(keys, t, yhat, sigma, h): the last season repeated; sigma is the population deviation of the season-lagged differences.

    Series of at most one season: their mean and the population deviation of their values.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    lagged = dense.withColumn("_d", F.col("y") - F.lag("y", season).over(w))
    stats = lagged.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(t).alias("_last"), F.avg("y").alias("_mean"), F.stddev_pop("y").alias("_own"), F.stddev_pop("_d").alias("_lagged"))
    ahead = stats.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    long = F.col("_n") > season
    from_ = F.col("_last") - (season - 1) + (F.col("h") - 1) % season
    past = dense.select(*keys, F.col(t).alias("_from"), F.col("y").alias("_y"))
    j = ahead.withColumn("_from", from_).join(past, [*keys, "_from"], "left")
    return j.select(*keys, (F.col("_last") + F.col("h")).cast("int").alias(t), F.when(long, F.col("_y").cast("double")).otherwise(F.col("_mean")).alias("yhat"), F.when(long, F.col("_lagged")).otherwise(F.col("_own")).alias("sigma"), "h")


def forecast_band(forecast: DataFrame, z: float = 1.96) -> DataFrame:
    """Adds lower and upper, z * sigma * sqrt(h) around yhat; all of them at least 0."""
    spread = z * F.col("sigma") * F.sqrt(F.col("h").cast("double"))
    floor = lambda c: F.greatest(c, F.lit(0.0))
    return forecast.withColumns({"lower": floor(F.col("yhat") - spread), "upper": floor(F.col("yhat") + spread)}).withColumn("yhat", floor(F.col("yhat")))


def history_plus_forecast(dense: DataFrame, forecast: DataFrame, keys: Sequence[str], t: str, method: str) -> DataFrame:
    """One long table: history rows (y_actual) and forecast rows (yhat, lower, upper), told apart by is_forecast."""
    none = F.lit(None).cast("double")
    past = dense.select(*keys, t, F.col("y").cast("double").alias("y_actual"), none.alias("yhat"), none.alias("lower"), none.alias("upper"), F.lit(0).alias("is_forecast"), F.lit("history").alias("method"))
    ahead = forecast.select(*keys, t, none.alias("y_actual"), "yhat", "lower", "upper", F.lit(1).alias("is_forecast"), F.lit(method).alias("method"))
    return past.unionByName(ahead)


def _holt_winters(y, season: int, horizon: int):
    """Additive damped trend and season by a recursion over time for a whole grid of parameters at once; the best by squared error.

    Returns (forecast, deviation of the one-step errors) or None if nothing finite came out.
    """
    import numpy as np

    def run(grid):
        a, b, c, phi = grid
        level = np.full(a.shape, y[:season].mean())
        slope = np.full(a.shape, (y[season : 2 * season].mean() - y[:season].mean()) / season)
        cycle = np.repeat((y[:season] - y[:season].mean())[:, None], a.size, 1)
        errors = []
        for i, value in enumerate(y):
            k = i % season
            hat = level + phi * slope + cycle[k]
            errors.append(value - hat)
            new = a * (value - cycle[k]) + (1 - a) * (level + phi * slope)
            slope = b * (new - level) + (1 - b) * phi * slope
            cycle[k] = c * (value - new) + (1 - c) * cycle[k]
            level = new
        return np.array(errors), level, slope, cycle

    steps = np.array([0.05, 0.2, 0.4, 0.7])
    grid = [g.ravel() for g in np.meshgrid(steps, steps[:3], steps[:3], np.array([0.8, 0.9, 0.98]))]
    for width in (0.1, 0.04, None):
        errors, level, slope, cycle = run(grid)
        loss = (errors**2).sum(0)
        best = int(np.where(np.isfinite(loss), loss, np.inf).argmin())
        if width is not None:
            near = [np.clip(g[best] + np.array([-width, 0, width]), 0.01, 0.99) for g in grid]
            grid = [g.ravel() for g in np.meshgrid(*near)]
    phi = grid[3][best]
    damp = np.cumsum(phi ** np.arange(1, horizon + 1))
    ahead = level[best] + damp * slope[best] + np.array([cycle[(len(y) + h) % season, best] for h in range(horizon)])
    sigma = float(errors[:, best].std())
    return (np.maximum(ahead, 0), sigma) if np.isfinite(ahead).all() and np.isfinite(sigma) else None


def forecast_ets(dense: DataFrame, keys: Sequence[str], t: str, horizon: int, season: int = 12, least: int = 30, least_nonzero: int = 12) -> DataFrame:
    """(keys, t, yhat, sigma, h, method): damped additive Holt-Winters, a series in each task's group; seasonal naive for the rest.

    A series is fitted if it has `least` points and `least_nonzero` of them aren't 0. A group is one monthly series, so it is small.
    """
    import numpy as np

    from fieldbook.session import ship

    ship(dense.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dense.schema if f.name in keys)
    order = [k for k in dense.columns if k in keys]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        y = pdf["y"].to_numpy(float)
        got = _holt_winters(y, season, horizon) if len(y) >= max(least, 2 * season) and (y != 0).sum() >= least_nonzero else None
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * horizon for k in keys})
        out[t] = (pdf[t].iloc[-1] + np.arange(1, horizon + 1)).astype("int32")
        if got is not None:
            out["yhat"], out["sigma"], out["method"] = got[0], got[1], "ets"
        else:
            long = len(y) > season
            out["yhat"] = np.resize(y[-season:], horizon) if long else y.mean()
            out["sigma"], out["method"] = float((y[season:] - y[:-season]).std() if long else y.std()), "naive"
        out["h"] = np.arange(1, horizon + 1).astype("int32")
        return out[[*order, t, "yhat", "sigma", "h", "method"]]

    return dense.groupBy(*keys).applyInPandas(fit, f"{kinds}, `{t}` int, yhat double, sigma double, h int, method string")


def backtest(dense: DataFrame, keys: Sequence[str], t: str, end: int, forecaster, holdout: int = 12, season: int = 12) -> DataFrame:
    """(keys, mape, rmse) of a forecaster (train, keys, t, horizon) on the last `holdout` months, for series long enough; MAPE where y > 0."""
    from fieldbook.functions.scalars import rounded

    enough = dense.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= season + holdout + 6).select(*keys)
    kept = dense.join(enough, list(keys), "left_semi")
    ahead = forecaster(kept.where(F.col(t) <= end - holdout), keys, t, holdout).select(*keys, t, "yhat")
    j = kept.where(F.col(t) > end - holdout).join(ahead, [*keys, t])
    error = F.col("y") - F.col("yhat")
    return j.groupBy(*keys).agg(rounded(F.avg(F.when(F.col("y") > 0, F.abs(error) / F.col("y")))).alias("mape"), rounded(F.sqrt(F.avg(error * error))).alias("rmse"))


def spike_alerts(df: DataFrame, keys: Sequence[str], year: str, value: str, baseline: Sequence[int], recent: int, min_baseline: float, min_increase: float, amber: float = 20.0, red: float = 40.0, every: bool = False) -> DataFrame:
    """(keys, baseline, actual, deviation_pct, severity): the recent year against the mean of the baseline years that have rows.

    A missing recent year is 0. Only what has a large enough baseline, increase and deviation; with `every`, all keys and a
    null severity where there is no alert.
    """
    from fieldbook.functions.scalars import rounded

    yearly = df.where(F.col(year).isin(*baseline, recent)).groupBy(*keys, year).agg(F.sum(value).alias("n"))
    base = yearly.where(F.col(year).isin(*baseline)).groupBy(*keys).agg(rounded(F.avg("n"), 2).alias("baseline"))
    now = yearly.where(F.col(year) == recent).select(*keys, F.col("n").alias("_now"))
    j = base.join(now, list(keys), "left").withColumn("actual", F.coalesce("_now", F.lit(0)).cast("bigint")).drop("_now")
    j = j.withColumn("deviation_pct", F.coalesce(rounded(F.try_divide(F.lit(100.0) * (F.col("actual") - F.col("baseline")), F.col("baseline")), 2), F.lit(0.0)))
    counts = (F.col("baseline") >= min_baseline) & (F.col("actual") - F.col("baseline") >= min_increase)
    severity = F.when(counts & (F.col("deviation_pct") >= red), "red").when(counts & (F.col("deviation_pct") >= amber), "amber")
    out = j.withColumn("severity", severity)
    return out if every else out.where("severity is not null")


def _path_length(n):
    """Average path length of an unsuccessful search among n points."""
    import numpy as np

    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(df: DataFrame, key: Sequence[str], features: Sequence[str], trees: int = 200, sample: int = 256, share: float = 0.01, seed: int = 42) -> DataFrame:
    """Adds score (0 to 1, scaled) and is_outlier (the top `share`), by isolation trees.

    Each tree is grown in a task of its own from `sample` rows of low hash; the forest (trees * sample numbers at most, whatever the
    data) goes to all tasks, and scoring is vectorised.
    """
    import numpy as np

    from fieldbook.session import ship

    ship(df.sparkSession)
    depth = int(np.ceil(np.log2(sample)))
    names = list(features)
    # Bounded: trees * sample rows at most. One pass finds a hash cut that leaves a little more than enough rows.
    total = df.count()
    part = min(1.0, 4.0 * trees * sample / max(1, total))
    pool = df.select(*names, F.xxhash64(F.lit(seed), *key).alias("_h")).where(F.pmod("_h", F.lit(1_000_000)) < int(part * 1_000_000) + 1)
    copies = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))) if part == 1.0 else F.pmod(F.shiftright("_h", 20), F.lit(trees)).cast("int")
    dealt = pool.withColumn("tree", copies).withColumn("_o", F.xxhash64("_h", "tree"))
    chosen = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_o", "_h"))).where(F.col("_r") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x, rng, rows = pdf[names].to_numpy(float), np.random.default_rng(seed + int(pdf["tree"].iloc[0])), []
        stack = [(1, np.arange(len(x)), 0)]
        while stack:
            node, own, level = stack.pop()
            wide = [j for j in range(len(names)) if len(own) and x[own, j].min() < x[own, j].max()]
            if level >= depth or len(own) <= 1 or not wide:
                rows.append((node, -1, 0.0, float(level + _path_length(len(own)))))
                continue
            j = wide[rng.integers(len(wide))]
            cut = rng.uniform(x[own, j].min(), x[own, j].max())
            rows.append((node, j, cut, 0.0))
            stack += [(2 * node, own[x[own, j] < cut], level + 1), (2 * node + 1, own[x[own, j] >= cut], level + 1)]
        return pd.DataFrame([(int(pdf["tree"].iloc[0]), *r) for r in rows], columns=["tree", "node", "feature", "cut", "path"])

    forest = chosen.groupBy("tree").applyInPandas(grow, "tree int, node long, feature int, cut double, path double").toPandas()
    grown = sorted(forest["tree"].unique())
    place = {t: i for i, t in enumerate(grown)}
    size = 2 ** (depth + 1)
    feature, cut, path = np.full((len(grown), size), -1), np.zeros((len(grown), size)), np.zeros((len(grown), size))
    at = (forest["tree"].map(place).to_numpy(int), forest["node"].to_numpy(int))
    feature[at], cut[at], path[at] = forest["feature"], forest["cut"], forest["path"]
    scale = float(_path_length(min(sample, max(2, total))))

    @F.pandas_udf("double")
    def scored_by(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, len(names)))
        mean = np.zeros(len(x))
        for i in range(len(grown)):
            node = np.ones(len(x), np.int64)
            for _ in range(depth):
                f = feature[i, node]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= cut[i, node]
                node = np.where(inner, 2 * node + right, node)
            mean += path[i, node]
        return pd.Series(2 ** (-mean / max(1, len(grown)) / scale))

    scored = settled(df.withColumn("_raw", scored_by(F.array(*(F.col(c).cast("double") for c in names)))))
    ends = scored.agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi")).crossJoin(quantiles(scored, "_raw", [1 - share]).select(F.get("edges", F.lit(0)).alias("_cut")))
    j = scored.crossJoin(F.broadcast(ends))
    return j.withColumns({"score": F.coalesce(F.try_divide(F.col("_raw") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)), "is_outlier": F.col("_raw") > F.col("_cut")}).drop("_raw", "_lo", "_hi", "_cut")


def anomaly_rule(value: str, expected: str, residual: str, z: str, outlier=None, least: float = 5.0, z_cut: float = 3.5, ratio_cut: float = 2.5):
    """Enough expected, more than expected, and unusual by the forest, by z or by ratio."""
    unusual = (F.col(z) >= z_cut) | (F.col(value) / F.greatest(F.col(expected), F.lit(1.0)) >= ratio_cut)
    unusual = unusual if outlier is None else unusual | outlier
    return (F.col(expected) >= least) & (F.col(residual) > 0) & unusual


def injected_recall(df: DataFrame, group: Sequence[str], t: str, month: str, value: str, least: int = 20, every: int = 20, seed: int = 42) -> DataFrame:
    """One row: how many of the rows that were multiplied (by 3 to 6, chosen by hash) the rule finds again."""
    from fieldbook.functions.scalars import rounded

    # A hash that other engines have too.
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *group, t).cast("binary")), 1, 8), 16, 10).cast("bigint")
    picked = (F.col(value) >= least) & (F.pmod(h, F.lit(every)) == 0)
    percent = 300 + F.pmod(F.shiftright(h, 16), F.lit(301))
    changed = df.withColumn("_picked", picked).withColumn(value, F.when(picked, F.floor((F.col(value) * percent + 50) / 100)).otherwise(F.col(value)).cast("bigint"))
    scored = seasonal_expectation(changed, group, month, value).where("_picked")
    found = anomaly_rule(value, "expected", "residual", "z", z_cut=2.0, ratio_cut=1.8)
    return scored.agg(F.count("*").alias("n_injected"), F.count_if(found).alias("n_found"), F.coalesce(rounded(F.avg(found.cast("int"))), F.lit(0.0)).alias("recall"))


def lag_panel(df: DataFrame, key: str, year: str, value: str, first: int, last: int, partial: int) -> DataFrame:
    """Every key and year from first to last with lags, their mean, slope and growth; the target is null in the partial year. Missing years are 0."""
    from fieldbook.functions.scalars import rounded

    years = F.explode(F.sequence(F.lit(first), F.lit(last))).alias(year)
    got = df.groupBy(key, year).agg(F.sum(value).alias("n"))
    full = df.select(key).distinct().select(key, years).join(got, [key, year], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    w = Window.partitionBy(key).orderBy(year)
    lag = lambda k: F.coalesce(F.lag("n", k).over(w), F.lit(0))
    out = full.withColumns({"lag1": lag(1), "lag2": lag(2), "lag3": lag(3)})
    return out.select(key, year, F.when(F.col(year) != partial, F.col("n")).alias("target"), "lag1", "lag2", rounded((F.col("lag1") + F.col("lag2") + F.col("lag3")) / F.lit(3.0)).alias("avg3"), ((F.col("lag1") - F.col("lag3")) / F.lit(2.0)).alias("slope"), F.coalesce(rounded(F.try_divide((F.col("lag1") - F.col("lag2")).cast("double"), F.col("lag2").cast("double"))), F.lit(0.0)).alias("yoy"))
