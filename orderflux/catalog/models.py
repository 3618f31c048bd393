"""Customer features, churn and forecast queries."""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import functions as F

from orderflux.catalog.base import register
from orderflux.plans import churn as CH
from orderflux.plans import forecast as FC
from orderflux.plans.series import daily_series
from orderflux.session import stable
from orderflux.sources.orders import successful

_COLUMNS = ("user_id", "segment", "order_time", "register_time", "sales")
REF = datetime(2000, 6, 30, 12, 0, 0)

_FEATURES = """p AS (SELECT user_id, order_time, sales, register_time FROM ok
    WHERE segment = 'B2C' AND order_time <= TIMESTAMP '2000-06-30 12:00:00'),
  g AS (SELECT user_id, floor(epoch(order_time - lag(order_time) OVER (PARTITION BY user_id ORDER BY order_time)) / 86400)
    AS d FROM p),
  gi AS (SELECT user_id, avg(d) AS m, stddev_samp(d) AS s FROM g GROUP BY 1),
  b AS (SELECT user_id, floor(epoch(TIMESTAMP '2000-06-30 12:00:00' - max(order_time)) / 86400) AS recency_days,
    count(*) AS frequency, sum(sales) AS monetary, avg(sales) AS avg_order_value,
    floor(epoch(max(order_time) - min(order_time)) / 86400) AS tenure_days,
    greatest(0, floor(epoch(TIMESTAMP '2000-06-30 12:00:00' - min(register_time)) / 86400)) AS days_since_reg,
    count(*) FILTER (order_time >= TIMESTAMP '2000-06-30 12:00:00' - INTERVAL 90 DAY) AS recent_3m_orders,
    coalesce(sum(sales) FILTER (order_time >= TIMESTAMP '2000-06-30 12:00:00' - INTERVAL 30 DAY), 0) AS revenue_30d
    FROM p GROUP BY 1),
  f AS (SELECT b.*, coalesce(m, greatest(tenure_days, 1)) AS interval_mean, coalesce(s, 0) AS interval_std
    FROM b JOIN gi USING (user_id))"""
_DIGITS = ("recency_days:0 frequency:0 monetary:2 avg_order_value:6 tenure_days:0 days_since_reg:0 "
           "recent_3m_orders:0 revenue_30d:2 interval_mean:6 interval_std:6")


@register("M6_J6_W4_customer_features", f"WITH {_FEATURES} SELECT * FROM f", _DIGITS)
def m6(spark, d):
    rows = successful(spark, d, *_COLUMNS).filter("segment = 'B2C'")
    return CH.customer_features(rows, REF)


@register("W4_purchase_intervals", f"""
WITH {_FEATURES} SELECT user_id, interval_mean, interval_std FROM f WHERE frequency > 1
""", "interval_mean:6 interval_std:6")
def w4(spark, d):
    rows = successful(spark, d, *_COLUMNS).filter("segment = 'B2C'")
    return CH.customer_features(rows, REF).filter("frequency > 1").select(
        "user_id", "interval_mean", "interval_std")


@register("M7_J7_churn_label", """
WITH r AS (SELECT * FROM ok WHERE segment = 'B2C'), m AS (SELECT max(order_time) - INTERVAL 60 DAY AS c FROM r)
SELECT user_id, CASE WHEN max(order_time) > any_value(c) THEN 0 ELSE 1 END::BIGINT AS churn
FROM r, m GROUP BY 1 HAVING min(order_time) <= any_value(c)
""")
def m7(spark, d):
    return CH.training_set(successful(spark, d, *_COLUMNS), 60).select("user_id", "churn")


@lru_cache(maxsize=1)
def _churn(spark, d):
    """One fit for the queries on it, at the library's defaults: 200 trees, 150 rounds, 5 folds."""
    return CH.predict_churn(successful(spark, d, *_COLUMNS), 60)


@register("M8_churn_metrics")
def m8(spark, d):
    out = _churn(spark, d)
    return out["metrics"].select("model", *[F.round(c, 4).alias(c) for c in (
        "auc", "threshold", "precision", "recall", "f1")])


@register("M9_at_risk_customers")
def m9(spark, d):
    out = _churn(spark, d)
    best = F.lit(out["best_model"])
    return out["at_risk"].select("user_id", "recency_days", "frequency", F.round("monetary", 2).alias("monetary"),
                                 "churn_probability", "risk_tier", best.alias("model"))


@register("M8_metrics_of_given_scores", """
WITH r AS (SELECT * FROM ok WHERE segment = 'B2C'), m AS (SELECT max(order_time) - INTERVAL 60 DAY AS c FROM r),
u AS (SELECT user_id, CASE WHEN max(order_time) > any_value(c) THEN 0 ELSE 1 END AS churn,
        floor(epoch(any_value(c) - max(order_time) FILTER (order_time <= c)) / 86400) AS recency
      FROM r, m GROUP BY 1 HAVING min(order_time) <= any_value(c)),
s AS (SELECT 'recency' AS model, churn, recency / 1000.0::DOUBLE AS score FROM u
      UNION ALL SELECT 'residue', churn, (recency % 97) / 97.0::DOUBLE FROM u),
g AS (SELECT model, score, sum(churn)::DOUBLE AS pos, sum(1 - churn)::DOUBLE AS neg FROM s GROUP BY 1, 2),
p AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS np,
        sum(neg) OVER (PARTITION BY model) AS nn FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
a AS (SELECT model, sum(neg * (tp - pos / 2) / (np * nn)) AS auc FROM p GROUP BY 1),
b AS (SELECT model, score AS threshold, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(np, 0), 0) AS recall
      FROM p QUALIFY row_number() OVER (PARTITION BY model ORDER BY tp / np - fp / nn DESC, score DESC) = 1)
SELECT model, auc, threshold, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1
FROM a JOIN b USING (model)
""", "auc:6 threshold:6 precision:6 recall:6 f1:6")
def m8s(spark, d):
    """ROC area, threshold, precision, recall and F1 of two scores that need no fit, over all customers before the cutoff."""
    train = CH.training_set(successful(spark, d, *_COLUMNS), 60)
    scores = train.select("churn", F.inline(F.array(
        F.struct(F.lit("recency").alias("model"), (F.col("recency_days") / 1000.0).alias("score")),
        F.struct(F.lit("residue").alias("model"), (F.pmod("recency_days", F.lit(97)) / 97.0).alias("score")))))
    return CH.classifier_metrics(stable(CH.roc_points(scores)))


@register("M9_tiers_of_given_scores", f"""
WITH {_FEATURES}, s AS (SELECT (recency_days % 11) / 10.0::DOUBLE AS score, monetary FROM f)
SELECT CASE WHEN score <= 0.3::DOUBLE THEN 'Low Risk' WHEN score <= 0.6::DOUBLE THEN 'Medium Risk' ELSE 'High Risk' END AS risk_tier,
  count(*) AS customers, sum(monetary) AS monetary FROM s GROUP BY 1
""", "monetary:2")
def m9s(spark, d):
    """Tiers of a score in tenths, so that both bounds are met exactly."""
    rows = CH.customer_features(successful(spark, d, *_COLUMNS).filter("segment = 'B2C'"), REF)
    tier = CH.risk_tier(F.pmod("recency_days", F.lit(11)) / 10.0)
    return rows.groupBy(tier.alias("risk_tier")).agg(F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("monetary"))


@register("M10_feature_importance")
def m10(spark, d):
    train = stable(CH.training_set(successful(spark, d, *_COLUMNS), 60))
    return CH.forest_importance(train).select("feature", F.round("importance", 4).alias("importance"))


_BASE = """ds AS (SELECT country, day, sum(sales) AS s FROM ok GROUP BY 1, 2),
  b AS (SELECT country, min(day) AS lo, max(day) AS hi FROM ds GROUP BY 1),
  cal AS (SELECT country, CAST(unnest(generate_series(lo, hi - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
  series AS (SELECT cal.country, cal.day, coalesce(s, 0) AS revenue FROM cal LEFT JOIN ds
             ON ds.day = cal.day AND ds.country = cal.country),
  l AS (SELECT *, (lag(revenue, 7) OVER w + lag(revenue, 14) OVER w + lag(revenue, 21) OVER w
      + lag(revenue, 28) OVER w) / 4 AS predicted, row_number() OVER (PARTITION BY country ORDER BY day DESC) AS back
    FROM series WINDOW w AS (PARTITION BY country ORDER BY day))"""


@register("M4_baseline_validation", f"""
WITH {_BASE} SELECT country, 'validation' AS kind, strftime(day, '%Y-%m-%d') AS day, 'Seasonal Baseline' AS model,
  revenue AS actual, predicted FROM l WHERE back <= 42
""", "actual:2 predicted:4")
def m4(spark, d):
    series = daily_series(successful(spark, d, "sales", "order_time", "country"), "country")
    return FC.baseline_validation(series, "country")


@register("M4_accuracy_of_baseline", f"""
WITH {_BASE} SELECT country, 'Seasonal Baseline' AS model, sqrt(avg((revenue - predicted) ** 2)) AS rmse,
  avg(abs(revenue - predicted)) AS mae, avg(abs((revenue - predicted) / revenue)) FILTER (revenue > 1e-9) * 100 AS mape,
  1 - sum((revenue - predicted) ** 2) / nullif(var_pop(revenue) * count(*), 0) AS r2 FROM l WHERE back <= 42 GROUP BY 1
""", "rmse:3 mae:3 mape:6 r2:6")
def m4a(spark, d):
    series = daily_series(successful(spark, d, "sales", "order_time", "country"), "country")
    return FC.accuracy(FC.baseline_validation(series, "country"), "country")


_X = ("t", "ln(1 + l1)", "ln(1 + l7)", "ln(1 + l14)", "ln(1 + r7)", "ln(1 + r28)", "sin(2 * pi() * (isodow(day) - 1) / 7)",
      "cos(2 * pi() * (isodow(day) - 1) / 7)", "CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END",
      "sin(2 * pi() * month(day) / 12)", "cos(2 * pi() * month(day) / 12)")


#: Ridge of every market on the rows before each ``fold`` (country, start_, end_), by elimination on 11 equations.
_RIDGE = f"""lags AS (
  SELECT country, day, revenue, row_number() OVER w - 1 AS t, lag(revenue, 1) OVER w AS l1, lag(revenue, 7) OVER w AS l7,
    lag(revenue, 14) OVER w AS l14, avg(revenue) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r7,
    avg(revenue) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS r28
  FROM series WINDOW w AS (PARTITION BY country ORDER BY day)),
feat AS (SELECT country, day, revenue, ln(1 + revenue) AS y, t - 28 AS i, [{", ".join(f"CAST({x} AS DOUBLE)" for x in _X)}] AS x
         FROM lags WHERE t >= 28),
size AS (SELECT country, count(*) AS n FROM feat GROUP BY 1),
{{fold}},
train AS (SELECT f.country, start_, x, y FROM feat f JOIN fold ON fold.country = f.country AND i < start_),
mean AS (SELECT country, start_, count(*) AS n, avg(y) AS level, [{", ".join(f"avg(x[{k}])" for k in range(1, 12))}] AS m,
           [{", ".join(f"CASE WHEN stddev_pop(x[{k}]) > 1e-4 THEN stddev_pop(x[{k}]) ELSE 1 END" for k in range(1, 12))}] AS s
         FROM train GROUP BY 1, 2),
unit AS (SELECT t.country, t.start_, y - level AS y, list_transform(range(1, 12), lambda k: (x[k] - m[k]) / s[k]) AS z
         FROM train t JOIN mean USING (country, start_)),
cell AS (SELECT country, start_, a, b, sum(z[a] * CASE WHEN b = 12 THEN y ELSE z[b] END) + CASE WHEN a = b THEN 1 ELSE 0 END AS v
         FROM unit, range(1, 12) p(a), range(1, 13) q(b) GROUP BY country, start_, a, b),
line AS (SELECT country, start_, a, list(v ORDER BY b) AS r FROM cell GROUP BY country, start_, a),
elim AS (
  SELECT country, start_, 0 AS k, list(r ORDER BY a) AS m FROM line GROUP BY country, start_
  UNION ALL
  SELECT country, start_, k + 1, list_transform(range(1, 12), lambda i: list_transform(range(1, 13), lambda j:
    CASE WHEN i = k + 1 THEN m[i][j] / m[k + 1][k + 1] ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END))
  FROM elim WHERE k < 11)"""
_FOLDS = "fold AS (SELECT country, n - 14 * k - 14 AS start_, n - 14 * k AS end_ FROM size, range(0, 3) r(k) WHERE n - 14 * k - 14 > 30)"


@register("M4_ridge_validation", f"""
WITH RECURSIVE {_BASE}, {_RIDGE.format(fold=_FOLDS)}
SELECT f.country, strftime(day, '%Y-%m-%d') AS day, revenue AS actual, greatest(0, level + list_sum(list_transform(
    range(1, 12), lambda k: (f.x[k] - mean.m[k]) / mean.s[k] * e.m[k][12]))) AS log_predicted
FROM feat f JOIN fold ON fold.country = f.country AND i >= fold.start_ AND i < end_
JOIN mean ON mean.country = f.country AND mean.start_ = fold.start_
JOIN elim e ON e.country = f.country AND e.start_ = fold.start_ AND e.k = 11
""", "actual:2 log_predicted:4")
def m4r(spark, d):
    """Ridge on the rows before each of the last three fortnights, for every market."""
    series = daily_series(successful(spark, d, "sales", "order_time", "country"), "country")
    return FC.ridge_validation(series, "country").select("country", "day", "actual", F.log1p("predicted").alias("log_predicted"))


_ALL_ROWS = "fold AS (SELECT country, n AS start_, n AS end_ FROM size)"
_STEP = ("(t + 28)", "ln(1 + r[28])", "ln(1 + r[22])", "ln(1 + r[15])", "ln(1 + list_sum(r[22:28]) / 7)", "ln(1 + list_sum(r) / 28)",
         "sin(2 * pi() * (isodow(day + 1) - 1) / 7)", "cos(2 * pi() * (isodow(day + 1) - 1) / 7)",
         "CASE WHEN isodow(day + 1) >= 6 THEN 1 ELSE 0 END", "sin(2 * pi() * month(day + 1) / 12)", "cos(2 * pi() * month(day + 1) / 12)")


@register("M5_stepwise_forecast", f"""
WITH RECURSIVE {_BASE}, {_RIDGE.format(fold=_ALL_ROWS)},
last28 AS (SELECT s.country, max(day) AS day, list(revenue ORDER BY day)[-28:] AS v FROM series s GROUP BY 1),
step AS (
  SELECT l.country, 0 AS k, day, v AS b, v AS r, level, mean.m, s, n AS t, list_transform(range(1, 12), lambda i: e.m[i][12]) AS beta
  FROM last28 l JOIN mean ON mean.country = l.country JOIN elim e ON e.country = l.country AND e.k = 11
  UNION ALL
  SELECT country, k + 1, day + 1, list_append(b[2:28], (b[1] + b[8] + b[15] + b[22]) / 4),
    list_append(r[2:28], greatest(0, exp(level + {" + ".join(
      f"({x} - m[{j}]) / s[{j}] * beta[{j}]" for j, x in enumerate(_STEP, 1))}) - 1)), level, m, s, t + 1, beta
  FROM step WHERE k < 63)
SELECT country, strftime(day, '%Y-%m-%d') AS day, ln(1 + b[28]) AS log_baseline, ln(1 + r[28]) AS log_ridge FROM step WHERE k > 0
""", "log_baseline:6 log_ridge:4")
def m5s(spark, d):
    """Nine weeks of baseline and ridge for every market."""
    series = stable(daily_series(successful(spark, d, "sales", "order_time", "country"), "country"))
    rows = FC.stepwise_forecasts(series, "country", horizon_weeks=8)
    return rows.groupBy("country", "day").agg(
        F.max(F.when(F.col("model") == FC.BASELINE, F.log1p("predicted"))).alias("log_baseline"),
        F.max(F.when(F.col("model") == FC.RIDGE, F.log1p("predicted"))).alias("log_ridge"))


@register("M5_forecast_by_market")
def m5m(spark, d):
    series = stable(daily_series(successful(spark, d, "sales", "order_time", "country"), "country"))
    rows = FC.linear_forecasts(series, "country", horizon_weeks=8).filter("kind = 'forecast'")
    return rows.select("country", "day", "model", F.round("predicted", 2).alias("predicted"))


@register("M3_M5_revenue_forecast")
def m5(spark, d):
    out = FC.forecast_revenue(successful(spark, d, "sales", "order_time"), 8)
    names = {m: m.lower().replace(" ", "_") for m in (*FC.MODELS, FC.BASELINE, "Ensemble")}
    return out["predictions"].select("week_start", *[F.round(F.col(f"`{m}`"), 2).alias(n)
                                                     for m, n in names.items()])


@register("M5_weekly_history", """
WITH ds AS (SELECT day, sum(sales) AS s FROM ok GROUP BY 1),
  f AS (SELECT CAST(unnest(generate_series(min(day), max(day) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM ds)
SELECT strftime(date_trunc('week', f.day), '%Y-%m-%d') AS week_start, sum(coalesce(s, 0)) AS revenue
FROM f LEFT JOIN ds USING (day) GROUP BY 1 HAVING count(*) = 7
""", "revenue:2")
def m5h(spark, d):
    return FC.full_weeks(daily_series(successful(spark, d, "sales", "order_time")), "day", ["revenue"])
