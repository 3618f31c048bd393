"""Daily revenue forecast: walk-forward validation, seasonal baseline, ridge and tree models.

The fact is reduced to daily series in Spark. Ridge and baseline are validated and forecast for all series at once: sums of
products give the equations of all folds, and a series is one row with its last days as an array when it is stepped forward.
The tree models are fitted side by side and validated by Spark ML and asked for one day after the other: 63 single
predictions a model, on the 28 latest days.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflux.functions.dimensions import local_table
from orderflux.functions.expressions import ratio
from orderflux.plans.series import daily_series, model_features, seasonal_baseline
from orderflux.session import stable, together

FEATURES = ["t", "lag1", "lag7", "lag14", "roll7", "roll28", "dow_sin", "dow_cos", "is_weekend",
            "month_sin", "month_cos"]
OFFSET, TEST_DAYS, WINDOWS, MIN_TRAIN = 28, 14, 3, 30
BASELINE, RIDGE = "Seasonal Baseline", "Ridge"
TREES = ("Gradient Boosting", "Random Forest")
MODELS = (*TREES, RIDGE)


def fold_bounds(n: int) -> list[tuple[int, int]]:
    """Start and end of the validation windows over ``n`` feature rows."""
    ends = [n - k * TEST_DAYS for k in range(WINDOWS - 1, -1, -1)]
    folds = [(e - TEST_DAYS, e) for e in ends if e - TEST_DAYS > MIN_TRAIN]
    return folds or [(max(1, n - TEST_DAYS), n)]


def _features(history: np.ndarray, t: int, day: pd.Timestamp) -> np.ndarray:
    """Feature row of one day after at least 28 days of history."""
    turn = 2 * np.pi
    logs = np.log1p([history[-1], history[-7], history[-14], history[-7:].mean(), history[-28:].mean()])
    dow = day.dayofweek
    return np.array([t, *logs, np.sin(turn * dow / 7), np.cos(turn * dow / 7), float(dow >= 5),
                     np.sin(turn * day.month / 12), np.cos(turn * day.month / 12)])


def linear_forecasts(series: DataFrame, *by: str, horizon_weeks: int = 8) -> DataFrame:
    """Ridge and baseline for every series: validation rows and the daily forecast."""
    keys = by or ("_all",)
    keyed = series if by else series.withColumn("_all", F.lit("all"))
    parts = [ridge_validation(keyed, *keys), baseline_validation(keyed, *keys),
             stepwise_forecasts(keyed, *keys, horizon_weeks=horizon_weeks)]
    return reduce(lambda a, b: a.unionByName(b), parts).select(*by, "kind", "day", "model", "actual", "predicted")


def series_folds(features: DataFrame, *by: str) -> DataFrame:
    """(by, start, end) of every validation window of every series, over its feature rows: see :func:`fold_bounds`."""
    rows = features.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ends = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.col("_n") - k * TEST_DAYS)
    usual = F.filter(F.transform(ends, lambda e: F.struct((e - TEST_DAYS).alias("start"), e.alias("end"))),
                     lambda f: f["start"] > MIN_TRAIN)
    one = F.array(F.struct(F.greatest(F.lit(1), F.col("_n") - TEST_DAYS).cast("bigint").alias("start"), F.col("_n").alias("end")))
    return rows.select(*by, F.inline(F.when(F.size(usual) > 0, usual).otherwise(one)))


def solved(matrix: Column) -> Column:
    """Solution of a positive definite system given as rows of coefficients and right side, by elimination in column order."""
    size = len(FEATURES)

    def step(m: Column, k: Column) -> Column:
        pivot = F.transform(F.get(m, k), lambda v: v / F.get(F.get(m, k), k))
        return F.transform(m, lambda row, i: F.when(i == k, pivot).otherwise(
            F.zip_with(row, pivot, lambda v, p: v - F.get(row, k) * p)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def ridge_models(features: DataFrame, folds: DataFrame, *by: str, alpha: float = 1.0) -> DataFrame:
    """Ridge of each series and fold on the rows before the fold: (by, start, end, mean, scale, beta, level).

    One aggregate gives the sums of all products of features and label, 12 by 12 of them, for all series and folds at once; the
    equations of the standardised features follow from these and are solved row by row. The label's mean is the free
    intercept; a feature that does not vary counts as 0.
    """
    x = FEATURES
    before = features.withColumn("_i", F.col("t") - OFFSET).join(folds, list(by))
    before = before.where(F.col("_i") < F.col("start"))
    pairs = [(a, b) for i, a in enumerate(x) for b in x[i:]]
    sums = before.groupBy(*by, "start", "end").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg("label").alias("level"),
        F.array(*[F.avg(a) for a in x]).alias("mean"), F.array(*[F.sum(F.col(a) * F.col("label")) for a in x]).alias("_xy"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("_xx"))
    n, size = F.col("_n"), len(x)
    place = {p: k for k, p in enumerate(pairs)}

    def spread(i: int, j: int) -> Column:
        """Sum of products of two features, each less its mean."""
        at = place[x[min(i, j)], x[max(i, j)]]
        return F.get("_xx", F.lit(at)) - n * F.get("mean", F.lit(i)) * F.get("mean", F.lit(j))

    # What rounding leaves of a feature without variance is not variance.
    scale = F.array(*[F.when(spread(i, i) > 1e-9 * n, F.sqrt(spread(i, i) / n)).otherwise(1.0) for i in range(size)])
    scaled = sums.withColumn("scale", scale)
    s = [F.get("scale", F.lit(i)) for i in range(size)]
    rows = [F.array(*[spread(i, j) / (s[i] * s[j]) + (alpha if i == j else 0.0) for j in range(size)],
                    (F.get("_xy", F.lit(i)) - n * F.get("mean", F.lit(i)) * F.col("level")) / s[i]) for i in range(size)]
    return scaled.withColumn("_m", F.array(*rows)).select(*by, "start", "end", "mean", "scale", "level",
                                                          solved(F.col("_m")).alias("beta"))


def _stepped(start: Column, steps: int, following) -> Column:
    """``start`` with ``steps`` more values, each ``following(values so far, number of the step)``."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda path, k: F.concat(path, F.array(following(path, k))))


def _back(path: Column, n: int) -> Column:
    """The value ``n`` days before the next one."""
    return F.element_at(path, F.lit(-n))


def stepwise_forecasts(series: DataFrame, *by: str, horizon_weeks: int = 8) -> DataFrame:
    """Daily forecast of the baseline and of the ridge for all series at once: (by, kind, day, model, actual, predicted).

    A series is one row with its last 28 days as an array, to which every step adds the next day for all series in parallel;
    nothing is looped over on the driver. The ridge is fitted on all rows of its series.
    """
    steps = horizon_weeks * 7 + 7
    features = model_features(series, *by)
    ends = features.groupBy(*by).agg(F.count(F.lit(1)).alias("start")).withColumn("end", F.col("start"))
    models = ridge_models(stable(features), ends, *by).drop("start", "end")
    tails = series.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max("day").alias("_last"), F.transform(
        F.slice(F.sort_array(F.collect_list(F.struct("day", "revenue"))), -28, 28), lambda x: x["revenue"]).alias("_tail"))
    rows = tails.join(models, list(by), "left")                                 # one row a series
    turn = 2.0 * F.pi()

    def same_weekday(path: Column, _: Column) -> Column:
        return (_back(path, 7) + _back(path, 14) + _back(path, 21) + _back(path, 28)) / 4

    def fitted(path: Column, k: Column) -> Column:
        day = F.date_add("_last", k)
        mean = [F.aggregate(F.slice(path, -n, n), F.lit(0.0), lambda a, x: a + x) / n for n in (7, 28)]
        dow, month = F.weekday(day), F.month(day)
        x = [(F.col("_n") + k - 1).cast("double"), *[F.log1p(v) for v in (_back(path, 1), _back(path, 7), _back(path, 14), *mean)],
             F.sin(turn * dow / 7), F.cos(turn * dow / 7), F.when(dow >= 5, 1.0).otherwise(0.0),
             F.sin(turn * month / 12), F.cos(turn * month / 12)]
        out = F.col("level")
        for j, value in enumerate(x):
            out = out + (value - F.get("mean", F.lit(j))) / F.get("scale", F.lit(j)) * F.get("beta", F.lit(j))
        return F.greatest(F.lit(0.0), F.expm1(out))

    paths = rows.select(*by, "_last", F.posexplode(F.arrays_zip(
        F.slice(_stepped(F.col("_tail"), steps, same_weekday), 29, steps).alias("base"),
        F.slice(_stepped(F.col("_tail"), steps, fitted), 29, steps).alias("ridge"))).alias("_k", "_v"))
    models_of = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_v.{c}").alias("predicted"))
                          for m, c in ((BASELINE, "base"), (RIDGE, "ridge"))])
    return paths.select(*by, F.lit("forecast").alias("kind"), F.date_add("_last", F.col("_k") + 1).alias("day"),
                        F.inline(models_of)).select(*by, "kind", "day", "model", F.lit(None).cast("double").alias("actual"), "predicted")


def ridge_validation(series: DataFrame, *by: str) -> DataFrame:
    """Validation rows of the ridge for every series, without a loop over series, days or folds."""
    features = stable(model_features(series, *by))
    models = stable(ridge_models(features, series_folds(features, *by), *by))
    rows = features.withColumn("_i", F.col("t") - OFFSET).join(models, list(by))          # at most three models a series
    rows = rows.where((F.col("_i") >= F.col("start")) & (F.col("_i") < F.col("end")))
    fitted = F.col("level")
    for k, name in enumerate(FEATURES):
        at = F.lit(k)
        fitted = fitted + (F.col(name) - F.get("mean", at)) / F.get("scale", at) * F.get("beta", at)
    return rows.select(*by, F.lit("validation").alias("kind"), "day", F.lit(RIDGE).alias("model"), F.col("revenue").alias("actual"),
                       F.greatest(F.lit(0.0), F.expm1(fitted)).alias("predicted"))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """RMSE, MAE, R2 and MAPE (actuals near zero left out) per model over validation rows."""
    v = rows.filter("kind = 'validation'")
    error = F.col("actual") - F.col("predicted")
    share = F.when(F.abs("actual") > 1e-9, F.abs(error / F.col("actual")))
    out = v.groupBy(*by, "model").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.sum(error * error).alias("_sse"), (F.var_pop("actual") * F.count("actual")).alias("_sst"),
        (F.avg(share) * 100).alias("mape"))
    return out.withColumn("r2", 1 - ratio(F.col("_sse"), F.col("_sst"))).drop("_sse", "_sst")


# --- tree models -----------------------------------------------------------

#: Spark ML's limit; the depth is free otherwise.
DEEPEST = 30


#: Pieces a forest is fitted in, side by side. Its trees know nothing of each other, so their mean is that of the pieces.
PIECES = 8


def _parts(name: str, trees: int) -> list[tuple[float, object]]:
    """Estimators that together make one model, each with its share of the prediction."""
    if name == "Gradient Boosting":
        return [(1.0, GBTRegressor(maxIter=trees, maxDepth=3, stepSize=0.05, subsamplingRate=0.9, seed=42,
                                   predictionCol="_p0"))]
    sizes = [n for n in ((trees + k) // PIECES for k in range(PIECES)) if n]
    return [(n / trees, RandomForestRegressor(numTrees=n, maxDepth=DEEPEST, minInstancesPerNode=2, seed=42 + k,
                                              featureSubsetStrategy="all", cacheNodeIds=True, predictionCol=f"_p{k}"))
            for k, n in enumerate(sizes)]


def _predicted(parts: list, df: DataFrame) -> DataFrame:
    """``df`` with the column ``prediction`` of a model in parts."""
    for _, model in parts:
        df = model.transform(df)
    return df.withColumn("prediction", sum(F.lit(share) * F.col(f"_p{k}") for k, (share, _) in enumerate(parts)))


def _tree_path(parts: list, tail: list[tuple], n: int, horizon_days: int) -> list[tuple]:
    """Recursive forecast of one fitted model: (day, predicted) from the last 28 days of a series of ``n`` days."""
    last, path, out = pd.Timestamp(tail[-1][0]), [v for _, v in tail], []
    for step in range(1, horizon_days + 1):
        day = last + pd.Timedelta(days=step)
        row = _features(np.array(path[-28:]), n + step - 1, day)
        value = sum(share * model.predict(Vectors.dense(row)) for share, model in parts)
        path.append(max(0.0, float(np.expm1(value))))
        out.append((day.date(), path[-1]))
    return out


def tree_forecasts(series: DataFrame, horizon_weeks: int = 8, trees: int = 300) -> tuple[DataFrame, np.ndarray]:
    """Validation and forecast rows of the tree models for one series, and the forest's importances."""
    spark = series.sparkSession
    rows = stable(VectorAssembler(inputCols=FEATURES, outputCol="features")
                  .transform(model_features(series)).withColumn("_i", F.col("t") - OFFSET)
                  .coalesce(1)).persist()           # one row per calendar day
    folds, tests, paths, importance = fold_bounds(rows.count()), [], [], None
    whole = (None, None)
    jobs = [(name, fold, share, part) for name in TREES for fold in [*folds, whole] for share, part in _parts(name, trees)]
    fits = together([
        lambda part=part, start=start: part.fit(rows if start is None else rows.filter(F.col("_i") < start))
        for _, (start, _), _, part in jobs])
    fitted = {}
    for (name, fold, share, _), model in zip(jobs, fits):
        fitted.setdefault((name, fold), []).append((share, model))
    n, horizon = series.count(), horizon_weeks * 7 + 7
    tail = [(r["day"], float(r["revenue"])) for r in series.orderBy(F.desc("day")).limit(28).collect()][::-1]
    for name in TREES:
        for start, end in folds:
            test = _predicted(fitted[name, (start, end)], rows.filter((F.col("_i") >= start) & (F.col("_i") < end)))
            tests.append(test.select(
                F.lit("validation").alias("kind"), "day", F.lit(name).alias("model"),
                F.col("revenue").alias("actual"), F.greatest(F.lit(0.0), F.expm1("prediction")).alias("predicted")))
        final = fitted[name, whole]
        paths += [("forecast", day, name, None, v) for day, v in _tree_path(final, tail, n, horizon)]
        if name == "Random Forest":
            importance = sum(share * model.featureImportances.toArray() for share, model in final)
    future = spark.createDataFrame(paths, "kind string, day date, model string, actual double, predicted double")
    out = stable(reduce(lambda a, b: a.unionByName(b), [*tests, future]))
    rows.unpersist()
    return out, importance


# --- the whole forecast ----------------------------------------------------

def full_weeks(daily: DataFrame, day: str, values, weeks: int | None = None) -> DataFrame:
    """Sums of complete Monday-to-Sunday weeks, the first ``weeks`` of them when given."""
    week = F.date_trunc("week", day).cast("date").alias("week_start")
    out = daily.groupBy(week).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(v) for v in values])
    out = out.filter("_n = 7").drop("_n").orderBy("week_start")
    return out.limit(weeks) if weeks else out


def _ensemble_path(pdf: pd.DataFrame) -> pd.DataFrame:
    """Baseline on the ensemble path for one series; ``blend`` is NaN when the baseline is the ensemble."""
    pdf = pdf.sort_values("day").reset_index(drop=True)
    path, base = [], []
    for value, blend in zip(pdf["revenue"], pdf["blend"]):
        b = float(np.mean([path[-k] for k in (7, 14, 21, 28)])) if len(path) >= 28 else np.nan
        base.append(b)
        path.append(value if not np.isnan(value) else (blend if not np.isnan(blend) else b))
    return pd.DataFrame({"day": pdf["day"], "baseline": base, "ensemble": path})


def forecast_revenue(df: DataFrame, horizon_weeks: int = 8, trees: int = 300) -> dict | None:
    """Forecast of total revenue.

    Returns DataFrames ``history``, ``predictions`` (weekly), ``metrics``, ``feature_importance`` and the model
    choice, or None when there are fewer than 42 days. The ensemble is the mean of the models only when the best
    one beats the baseline's MAPE; otherwise it is the baseline.
    """
    spark = df.sparkSession
    series = stable(daily_series(df))
    if series.isEmpty():
        return None
    tree_rows, importances = tree_forecasts(series, horizon_weeks, trees)
    rows = stable(linear_forecasts(series, horizon_weeks=horizon_weeks).unionByName(tree_rows))
    metrics = stable(accuracy(rows))
    mape = {r["model"]: r["mape"] for r in metrics.collect()}              # four rows
    best = min(MODELS, key=lambda m: mape[m] if mape[m] is not None else 1e9)
    beats = mape[best] is not None and mape[best] < mape[BASELINE]

    future = rows.filter("kind = 'forecast'").groupBy("day").pivot("model", list(MODELS)).agg(F.first("predicted"))
    blend = sum((F.col(f"`{m}`") for m in MODELS), F.lit(0.0)) / len(MODELS) if beats else F.lit(None)
    joined = series.select("day", "revenue", F.lit(None).cast("double").alias("blend")).unionByName(
        future.select("day", F.lit(None).cast("double").alias("revenue"), blend.cast("double").alias("blend")))
    paths = joined.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(
        _ensemble_path, "day date, baseline double, ensemble double")      # one row per calendar day
    daily = future.join(paths, "day").select(
        "day", *[F.col(f"`{m}`") for m in MODELS], F.col("baseline").alias(BASELINE),
        F.col("ensemble").alias("Ensemble"))
    importance = local_table(spark, "feature string, importance double", sorted(
        zip(FEATURES, map(float, importances)), key=lambda p: -p[1]))
    return {"history": full_weeks(series, "day", ["revenue"]),
            "predictions": full_weeks(stable(daily), "day", [*MODELS, BASELINE, "Ensemble"], horizon_weeks),
            "metrics": metrics, "feature_importance": importance,
            "best_model": best if beats else BASELINE, "beats_baseline": beats,
            "best_mape": mape[best], "baseline_mape": mape[BASELINE], "horizon_weeks": horizon_weeks}


def baseline_validation(series: DataFrame, *by: str) -> DataFrame:
    """Validation rows of the baseline alone, in plain windows."""
    from pyspark.sql import Window
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = seasonal_baseline(series, *by).withColumn("_n", n - OFFSET).withColumn("_i", F.col("t") - OFFSET)
    first = F.greatest(F.col("_n") - WINDOWS * TEST_DAYS, F.lit(MIN_TRAIN + 1))
    start = F.when(F.col("_n") - TEST_DAYS > MIN_TRAIN,
                   first + F.pmod(F.col("_n") - first, F.lit(TEST_DAYS))).otherwise(
        F.greatest(F.lit(1), F.col("_n") - TEST_DAYS))
    return rows.filter(F.col("_i") >= start).select(
        *by, F.lit("validation").alias("kind"), "day", F.lit(BASELINE).alias("model"),
        F.col("revenue").alias("actual"), F.col("baseline").alias("predicted"))
