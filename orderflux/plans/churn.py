"""Customer features as of a date and a leak-free churn model.

Features use orders up to the reference time only; the label looks strictly after it.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflux.functions.dimensions import local_table
from orderflux.functions.expressions import ratio
from orderflux.operators.ordering import running_totals
from orderflux.plans import trees as T
from orderflux.session import stable, together

FEATURES = ["recency_days", "frequency", "monetary", "avg_order_value", "tenure_days", "days_since_reg",
            "recent_3m_orders", "revenue_30d", "interval_mean", "interval_std"]
MIN_USERS, MIN_TRAIN, MIN_CLASS, FOLDS, SEED = 30, 40, 5, 5, 42
DEEPEST = 30                                            # Spark ML's limit; the depth is free otherwise
PIECES, PIECE_ROWS = 16, 2_000
TASK_ROWS, TASK_TREES = 2_000_000, 5                    # most rows that go to every task; trees of a forest a task grows
GBT_DEPTH, GBT_STEP = 3, 0.05
OMITTED = "Extra Trees has no Spark ML counterpart"


def _rows(df: DataFrame) -> DataFrame:
    rows = df.filter("user_id IS NOT NULL AND order_time IS NOT NULL AND sales IS NOT NULL")
    return rows.filter(F.upper("segment") == "B2C") if "segment" in df.columns else rows


def _days(late: Column, early: Column) -> Column:
    """Whole days between two timestamps, rounded down as a time delta's days are."""
    return F.floor((F.unix_micros(late) - F.unix_micros(early)) / 86_400_000_000)


def customer_features(df: DataFrame, ref: datetime) -> DataFrame:
    """The ten features per user.

    Orders are first reduced to one row per user and day. Orders of one day are less than a day apart, so
    their intervals count as zero and only the steps between active days need a window, which then holds at
    most one row per calendar day, however many orders a user has.
    """
    ref_ts = F.lit(ref).cast("timestamp")
    last_90, last_30 = (F.lit(ref - timedelta(days=n)).cast("timestamp") for n in (90, 30))
    t = F.col("order_time")
    register = F.col("register_time") if "register_time" in df.columns else F.lit(None).cast("timestamp")
    per_day = df.filter(t <= ref_ts).groupBy("user_id", F.to_date(t).alias("_day")).agg(
        F.count(t).alias("_n"), F.sum("sales").alias("_s"), F.min(t).alias("_first"),
        F.max(t).alias("_last"), F.count_if(t >= last_90).alias("_n90"),
        F.sum(F.when(t >= last_30, F.col("sales")).otherwise(0.0)).alias("_s30"),
        F.min(register).alias("_reg"))
    w = Window.partitionBy("user_id").orderBy("_day")
    stepped = per_day.withColumn("_step", _days(F.col("_first"), F.lag("_last").over(w)))
    u = stepped.groupBy("user_id").agg(
        F.sum("_n").alias("frequency"), F.sum("_s").alias("monetary"), F.min("_first").alias("_first"),
        F.max("_last").alias("_last"), F.sum("_n90").alias("recent_3m_orders"),
        F.sum("_s30").alias("revenue_30d"), F.min("_reg").alias("_reg"),
        F.coalesce(F.sum("_step"), F.lit(0)).alias("_d"),
        F.coalesce(F.sum(F.col("_step") * F.col("_step")), F.lit(0)).alias("_dd"))
    gaps = F.col("frequency") - 1
    tenure = F.greatest(F.lit(0), _days(F.col("_last"), F.col("_first")))
    variance = (F.col("_dd") - F.col("_d") * F.col("_d") / gaps) / (gaps - 1)
    since = F.greatest(F.lit(0), _days(ref_ts, F.col("_reg")))
    return u.select(
        "user_id", F.greatest(F.lit(0), _days(ref_ts, F.col("_last"))).cast("double").alias("recency_days"),
        F.col("frequency").cast("double").alias("frequency"), "monetary",
        (F.col("monetary") / F.col("frequency")).alias("avg_order_value"),
        tenure.cast("double").alias("tenure_days"),
        F.when(F.col("_reg").isNull(), tenure).otherwise(since).cast("double").alias("days_since_reg"),
        F.col("recent_3m_orders").cast("double").alias("recent_3m_orders"), "revenue_30d",
        F.when(gaps > 0, F.col("_d") / gaps).otherwise(F.greatest(F.lit(1), tenure)).cast("double")
        .alias("interval_mean"),
        F.when(gaps > 1, F.sqrt(F.greatest(F.lit(0.0), variance))).otherwise(0.0).alias("interval_std"))


def latest_order(df: DataFrame) -> datetime | None:
    return _rows(df).agg(F.max("order_time")).first()[0]


def training_set(df: DataFrame, churn_days: int = 60, today: datetime | None = None) -> DataFrame:
    """Features at the cutoff and the label: no order strictly after it."""
    rows = _rows(df)
    today = today or latest_order(df)
    cutoff = today - timedelta(days=churn_days)
    later = (rows.filter(F.col("order_time") > F.lit(cutoff).cast("timestamp"))
             .select(F.col("user_id").alias("_later")).distinct())
    features = customer_features(rows, cutoff)
    return features.join(later, F.col("user_id") == F.col("_later"), "left").withColumn(
        "churn", F.col("_later").isNull().cast("int")).drop("_later")


def _pieces(trees: int, rows: int) -> list[int]:
    """Trees of each piece that a forest is fitted in, side by side. Its trees know nothing of each other, so the mean of the
    pieces is that of the forest; a small training set keeps it whole."""
    count = min(PIECES, 1 + rows // PIECE_ROWS)
    return [n for n in ((trees + k) // count for k in range(count)) if n]


def _models(trees: int, rounds: int, rows: int) -> dict[str, list[tuple[float, Pipeline]]]:
    """By name the pipelines that together make one model, each with its share of the score.

    The penalty of the regression is that of C = 1 over ``rows`` rows. Forests keep the node of each row: without, every pass
    carries all trees to the tasks and walks them from the root.
    """
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    common = {"labelCol": "churn"}
    return {
        "Logistic Regression": [(1.0, Pipeline(stages=[assemble, scale, LogisticRegression(
            featuresCol="scaled", weightCol="weight", maxIter=100, regParam=1.0 / max(1, rows), **common)]))],
        "Random Forest": [(n / trees, Pipeline(stages=[assemble, RandomForestClassifier(
            featuresCol="raw", weightCol="weight", numTrees=n, maxDepth=DEEPEST, seed=SEED + k, cacheNodeIds=True, **common)]))
            for k, n in enumerate(_pieces(trees, rows))],
        "Gradient Boosting": [(1.0, Pipeline(stages=[assemble, GBTClassifier(
            featuresCol="raw", maxIter=rounds, maxDepth=GBT_DEPTH, stepSize=GBT_STEP, seed=SEED, **common)]))],
    }


def _scored(parts: list, df: DataFrame) -> DataFrame:
    """``df`` with the column ``score`` of a model in parts."""
    columns, score = df.columns, F.lit(0.0)
    for k, (share, model) in enumerate(parts):
        df = model.transform(df).select(*columns, *[f"_s{j}" for j in range(k)],
                                        (F.lit(share) * vector_to_array("probability")[1]).alias(f"_s{k}"))
        score = score + F.col(f"_s{k}")
    return df.select(*columns, score.alias("score"))


def _united_scores(parts: list[DataFrame], keys=("model", "user_id")) -> DataFrame:
    """(model, user_id, churn, score) from the shares (model, part, user_id, churn, score) of each part, added in their order."""
    shares = F.sort_array(F.collect_list(F.struct("part", "score")))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
        F.max("churn").alias("churn"), F.aggregate(shares, F.lit(0.0), lambda total, s: total + s["score"]).alias("score"))


def _column(df: DataFrame, name: str) -> np.ndarray:
    return df.select(name).toArrow()[name].to_numpy()


def _grown_in_tasks(train: DataFrame, weights: tuple[float, float], trees: int, rounds: int = 0, folds: int = 0,
                    current: DataFrame | None = None) -> DataFrame:
    """(kind, model, row, churn, score) of a forest and of boosting, each fitted to all rows of a training set and without each fold.

    A ``held`` row has the score of the model without its fold, a ``now`` row that of a row of ``current`` (with its ``_row``), an
    ``importance`` row that of a feature in the forest on all rows. Both frames are checkpoints, so their rows have one order; a column after the
    other comes to the driver, which holds a byte a value (see :mod:`orderflux.plans.trees`). Thresholds of a model come from its own rows.
    A task grows some trees of one forest, or boosts one model, and scores what that model has to score; no tree leaves it.
    """
    spark, sets = train.sparkSession, [*range(folds), None]
    label = _column(train, "churn").astype(np.uint8)
    fold = _column(train, "fold") if folds else np.zeros(len(label), np.int32)
    ids = _column(current, "_row") if current is not None else np.zeros(0, np.int64)
    bins = {k: np.empty((len(label), len(FEATURES)), np.uint8) for k in sets}
    now = np.empty((len(ids), len(FEATURES)), np.uint8)
    for j, name in enumerate(FEATURES):
        values = _column(train, name)
        for k in sets:
            at = T.cuts(values if k is None else values[fold != k])
            bins[k][:, j] = T.binned(values, at)
        if len(ids):
            now[:, j] = T.binned(_column(current, name), at)
    empty = now[:0], ids[:0]
    tables = {k: spark.sparkContext.broadcast((bins[k], label, fold, *((now, ids) if k is None else empty))) for k in sets}
    units = [("Gradient Boosting", k, 0, []) for k in sets if rounds] + [
        ("Random Forest", k, first // TASK_TREES, [[SEED, sets.index(k), t] for t in range(first, min(trees, first + TASK_TREES))])
        for k in sets for first in range(0, trees, TASK_TREES)]

    def fit(frames):
        for unit in (u for frame in frames for u in frame["id"]):
            model, k, part, seeds = units[unit]
            table, churn, folds_of, other, other_ids = tables[k].value
            used = np.ones(len(table), bool) if k is None else folds_of != k
            held, x, y = np.flatnonzero(~used), table[used], churn[used]
            if seeds:
                scored = table[held], other
                found, importance = [np.zeros(len(t)) for t in scored], np.zeros(len(FEATURES))
                for tree in T.forest(x, y, weights, seeds, DEEPEST):
                    found = [s + tree.scores(t) for s, t in zip(found, scored)]
                    importance += tree.importance(len(FEATURES)) if k is None else 0
            else:
                found, importance = T.boosted(x, y, [table[held], other], rounds, GBT_DEPTH, GBT_STEP), None
            out = [("held", held, churn[held], found[0]), ("now", other_ids, np.zeros(len(other)), found[1])]
            if seeds and k is None:
                out.append(("importance", np.arange(len(FEATURES)), np.zeros(len(FEATURES)), importance))
            for kind, row, c, score in out:
                for a in range(0, len(row), 100_000):
                    z = slice(a, a + 100_000)
                    yield pd.DataFrame({"kind": kind, "model": model, "part": part, "row": row[z], "churn": c[z], "score": score[z]})

    shares = spark.range(0, len(units), 1, len(units)).mapInPandas(
        fit, "kind string, model string, part int, row long, churn int, score double")
    united = _united_scores([shares], ("kind", "model", "row"))
    out = stable(united.withColumn("score", F.when(F.col("model") == "Random Forest", F.col("score") / trees).otherwise(F.col("score"))))
    for table in tables.values():
        table.unpersist()
    return out


def roc_points(scores: DataFrame) -> DataFrame:
    """ROC point per model and distinct score (rows: model, churn, score)."""
    merged = scores.groupBy("model", "score").agg(
        F.sum("churn").cast("double").alias("pos"), F.sum(1 - F.col("churn")).cast("double").alias("neg"))
    points = running_totals(merged, "score", ["model"], cumulative="tp", weight="pos",
                            more={"fp": "neg"}, resolution=4096).drop("rank")
    totals = points.groupBy("model").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return points.join(totals, "model").withColumn("tpr", ratio(F.col("tp"), F.col("_p"))).withColumn(
        "fpr", ratio(F.col("fp"), F.col("_n")))


def classifier_metrics(points: DataFrame) -> DataFrame:
    """AUC, threshold of the greatest tpr - fpr, and precision, recall, F1 at it."""
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2) / (F.col("_p") * F.col("_n"))
    best = F.max_by(F.struct("score", "tp", "fp", "_p"), F.struct(F.col("tpr") - F.col("fpr"), "score"))
    out = points.groupBy("model").agg(F.sum(area).alias("auc"), best.alias("b"))
    precision, recall = ratio(F.col("b.tp"), F.col("b.tp") + F.col("b.fp")), ratio(F.col("b.tp"), F.col("b._p"))
    out = out.select("model", "auc", F.col("b.score").alias("threshold"),
                     F.coalesce(precision, F.lit(0.0)).alias("precision"),
                     F.coalesce(recall, F.lit(0.0)).alias("recall"))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def risk_tier(probability: Column) -> Column:
    """(0, 0.3] low, (0.3, 0.6] medium, above high; exactly 0 counts as low."""
    return (F.when(probability <= 0.3, "Low Risk").when(probability <= 0.6, "Medium Risk")
            .otherwise("High Risk"))


def _parts(rows: int) -> int:
    """Partitions for repeated passes over a training set; boosting runs hundreds of short jobs."""
    return 1 + rows // 50_000


def forest_importance(train: DataFrame, trees: int = 200) -> DataFrame:
    """Feature importances of the random forest fitted to a training set, largest first."""
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum("churn").alias("c")).first()
    balanced = [counts["n"] / (2.0 * max(c, 1)) for c in (counts["n"] - (counts["c"] or 0), counts["c"] or 0)]
    if PIECE_ROWS <= counts["n"] <= TASK_ROWS:
        return _grown_importance(_grown_in_tasks(train.fillna(0.0, FEATURES), balanced, trees))
    weight = F.when(F.col("churn") == 1, balanced[1]).otherwise(balanced[0])
    rows = train.fillna(0.0, FEATURES).withColumn("weight", weight).coalesce(_parts(counts["n"])).persist()
    parts = _models(trees, 1, counts["n"])["Random Forest"]
    fits = together([lambda part=part: part.fit(rows) for _, part in parts], _at_once(rows))
    rows.unpersist()
    return _importance(train.sparkSession, [(share, fit) for (share, _), fit in zip(parts, fits)])


def _at_once(df: DataFrame) -> int:
    """Fits side by side: one for each core, since each has few tasks."""
    return max(8, df.sparkSession.sparkContext.defaultParallelism)


def _ranked_importance(spark, values) -> DataFrame:
    return local_table(spark, "feature string, importance double",
                       sorted(zip(FEATURES, map(float, values)), key=lambda p: -p[1]))


def _importance(spark, parts: list) -> DataFrame:
    return _ranked_importance(spark, sum(share * fitted.stages[-1].featureImportances.toArray() for share, fitted in parts))


def _grown_importance(grown: DataFrame) -> DataFrame:
    values = np.array([r["score"] for r in grown.filter("kind = 'importance'").orderBy("row").collect()])
    return _ranked_importance(grown.sparkSession, values / max(values.sum(), 1e-300))


def predict_churn(df: DataFrame, churn_days: int = 60, trees: int = 200, rounds: int = 150,
                  folds: int = FOLDS) -> dict | None:
    """Train, validate out of fold, and score every current customer with the best model.

    Returns DataFrames ``at_risk``, ``metrics``, ``roc_curves``, ``feature_importance`` and scalars, or None
    when there is too little data.
    """
    today = latest_order(df)
    if today is None:
        return None
    train = stable(training_set(df, churn_days, today).fillna(0.0, FEATURES))
    size = train.agg(F.count(F.lit(1)).alias("n"), F.sum("churn").alias("churned")).first()
    users = _rows(df).select("user_id").distinct().limit(MIN_USERS).count()
    kept = size["n"] - (size["churned"] or 0)
    if users < MIN_USERS or size["n"] < MIN_TRAIN or min(size["churned"], kept) < MIN_CLASS:
        return None
    balanced = [size["n"] / (2.0 * n) for n in (kept, size["churned"])]
    weight = F.when(F.col("churn") == 1, balanced[1]).otherwise(balanced[0])
    # Folds are dealt within each class, in the order of a hash of the user.
    hashed = train.withColumn("weight", weight).withColumn(
        "_h", F.xxhash64(F.col("user_id"), F.lit(SEED)).cast("double"))
    train = stable(running_totals(hashed, "_h", ["churn"], rank="_rank").withColumn(
        "fold", F.pmod(F.col("_rank") - 1, F.lit(folds))).drop("_h", "_rank", "cumulative").coalesce(_parts(size["n"])))
    train.persist()                                   # every fit reads it; lost blocks come from the checkpoint
    current, in_tasks = customer_features(_rows(df), today).fillna(0.0, FEATURES), size["n"] >= PIECE_ROWS
    if in_tasks:
        current = stable(current.withColumn("_row", F.monotonically_increasing_id()))
        in_tasks = current.count() <= TASK_ROWS       # every user of the training set is among them
    # One pipeline for each fit: stages keep their parameters in Python objects, which threads should not share.
    jobs = [(name, fold, k, share, part) for name in ("Gradient Boosting", "Random Forest", "Logistic Regression")
            if not in_tasks or name == "Logistic Regression"
            for fold in [*range(folds), None] for k, (share, part) in enumerate(_models(trees, rounds, size["n"])[name])]

    def fit(name: str, fold: int | None, k: int, share: float, part: Pipeline):
        """The model on all rows, or a fold's scores, so that the driver holds no more trees than those at work."""
        if fold is None:
            return part.fit(train)
        model = part.fit(train.filter(F.col("fold") != fold))
        return stable(_scored([(share, model)], train.filter(F.col("fold") == fold)).select(
            F.lit(name).alias("model"), F.lit(k).alias("part"), "user_id", "churn", "score"))

    calls = [lambda job=job: fit(*job) for job in jobs]
    if in_tasks:
        calls.append(lambda: _grown_in_tasks(train, balanced, trees, rounds, folds, current))
    fits = together(calls, _at_once(train))
    fitted: dict[str, list] = {}
    for (name, fold, _, share, _), model in zip(jobs, fits):
        if fold is None:
            fitted.setdefault(name, []).append((share, model))
    scores = _united_scores([rows for (_, fold, *_), rows in zip(jobs, fits) if fold is not None]).select("model", "churn", "score")
    if in_tasks:
        scores = scores.unionByName(fits[-1].filter("kind = 'held'").select("model", "churn", "score"))
    points = stable(roc_points(scores))
    train.unpersist()
    metrics = stable(classifier_metrics(points))
    best = metrics.orderBy(F.desc("auc"), "model").first()["model"]
    if best in fitted:
        current = _scored(fitted[best], current)
    else:
        now = fits[-1].filter((F.col("kind") == "now") & (F.col("model") == best))
        current = current.join(now.select(F.col("row").alias("_row"), "score"), "_row")
    at_risk = current.select(
        "user_id", "recency_days", "frequency", "monetary", "avg_order_value", "recent_3m_orders",
        "revenue_30d", F.bround(F.col("score") * 100, 1).alias("churn_probability"),
        risk_tier(F.col("score")).alias("risk_tier")).orderBy(F.desc("churn_probability"), "user_id")
    importance = _grown_importance(fits[-1]) if in_tasks else _importance(df.sparkSession, fitted["Random Forest"])
    return {"at_risk": at_risk, "metrics": metrics, "best_model": best, "feature_importance": importance,
            "roc_curves": points.select("model", "score", "fpr", "tpr"), "churn_days": churn_days,
            "total_customers": size["n"], "churned_count": size["churned"],
            "validation_cutoff": str((today - timedelta(days=churn_days)).date()), "omitted": OMITTED}
