"""Time-series operators on daily or weekly aggregates.

The fact is aggregated to periods before any window, so a window holds at most one row per calendar
period and series.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflux import config
from orderflux.functions.expressions import ratio
from orderflux.functions.measures import gmv, orders, top
from orderflux.session import stable

MIN_DAYS = 42


def fill_days(daily: DataFrame, day: str, values, by=()) -> DataFrame:
    """Insert the missing days with zeros: each row also emits the days up to the next one."""
    w = Window.partitionBy(*by).orderBy(day)
    until = F.coalesce(F.date_sub(F.lead(day).over(w), 1), F.col(day))
    spread = (daily.withColumn("_until", until)
              .withColumn("_d", F.explode(F.sequence(day, "_until"))))
    real = F.col("_d") == F.col(day)
    return spread.select(*by, F.col("_d").alias(day),
                         *[F.when(real, F.col(v)).otherwise(0).alias(v) for v in values])


def daily_series(df: DataFrame, *by: str, drop_last: bool = True, min_days: int = MIN_DAYS) -> DataFrame:
    """Gap-free daily revenue with day index ``t``.

    The last (partial) day and leading days without revenue are dropped; a series shorter than
    ``min_days`` is left out.
    """
    daily = (df.filter("order_time IS NOT NULL AND sales IS NOT NULL")
             .groupBy(*by, F.to_date("order_time").alias("day")).agg(F.sum("sales").alias("revenue")))
    filled = fill_days(daily, "day", ["revenue"], by)
    whole = Window.partitionBy(*by)
    ordered = Window.partitionBy(*by).orderBy("day")
    if drop_last:
        filled = (filled.withColumn("_last", F.max("day").over(whole))
                  .withColumn("_n", F.count(F.lit(1)).over(whole))
                  .filter((F.col("day") < F.col("_last")) | (F.col("_n") == 1)).drop("_last", "_n"))
    live = F.min(F.when(F.col("revenue") > 0, F.col("day"))).over(whole)
    return (filled.withColumn("_live", live).filter("day >= _live")
            .withColumn("t", F.row_number().over(ordered) - 1)
            .withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") >= min_days)
            .drop("_live", "_n"))


def lag_features(series: DataFrame, *by: str) -> DataFrame:
    """Lags 1, 7, 14 and trailing means 7, 28 that end the day before, with their fallbacks."""
    w = Window.partitionBy(*by).orderBy("day")

    def lag(n: int) -> Column:
        return F.lag("revenue", n).over(w)

    def mean(n: int) -> Column:
        return F.when(F.col("t") >= n, F.avg("revenue").over(w.rowsBetween(-n, -1)))

    out = series.withColumn("lag1", F.coalesce(lag(1), F.lit(0.0)))
    out = out.withColumn("lag7", F.coalesce(lag(7), "lag1"))
    out = out.withColumn("lag14", F.coalesce(lag(14), "lag7"))
    out = out.withColumn("roll7", F.coalesce(mean(7), "lag1"))
    return out.withColumn("roll28", F.coalesce(mean(28), "roll7"))


def seasonal_baseline(series: DataFrame, *by: str) -> DataFrame:
    """Mean of the same weekday in the four weeks before; else of the last seven days."""
    w = Window.partitionBy(*by).orderBy("day")
    same = F.array_compact(F.array(*[F.lag("revenue", n).over(w) for n in (7, 14, 21, 28)]))
    out = series.withColumn("_same", same)
    total = F.aggregate("_same", F.lit(0.0), lambda a, x: a + x)
    last = F.avg("revenue").over(w.rowsBetween(-7, -1))
    value = F.when(F.size("_same") > 0, total / F.size("_same")).otherwise(F.coalesce(last, F.lit(0.0)))
    return out.withColumn("baseline", value).drop("_same")


def model_features(series: DataFrame, *by: str) -> DataFrame:
    """Feature matrix from day 28 on: log lags, weekday and month cycles, log target."""
    f = lag_features(series, *by).filter("t >= 28")
    turn = 2.0 * F.pi()
    dow, month = F.weekday("day"), F.month("day")
    return f.select(
        *by, "day", F.col("t").cast("double").alias("t"), "revenue",
        F.log1p("revenue").alias("label"),
        *[F.log1p(c).alias(c) for c in ("lag1", "lag7", "lag14", "roll7", "roll28")],
        F.sin(turn * dow / 7).alias("dow_sin"), F.cos(turn * dow / 7).alias("dow_cos"),
        F.when(dow >= 5, 1.0).otherwise(0.0).alias("is_weekend"),
        F.sin(turn * month / 12).alias("month_sin"), F.cos(turn * month / 12).alias("month_cos"))


# --- comparisons -----------------------------------------------------------

def _between(period: tuple) -> Column:
    return F.to_date("order_time").between(F.lit(period[0]), F.lit(period[1]))


def compare_periods(df: DataFrame, now: tuple, before: tuple, *by: str, min_orders: int = 0) -> DataFrame:
    """KPIs of two periods side by side with absolute and relative change, in one aggregation."""
    a, b = _between(now), _between(before)
    rows = df.filter(a | b)
    out = rows.groupBy(*by).agg(
        gmv(a).alias("gmv"), orders(rows, a).alias("orders"),
        gmv(b).alias("previous_gmv"), orders(rows, b).alias("previous_orders"))
    out = out.filter(F.greatest("orders", "previous_orders") >= min_orders)
    return (out.withColumn("change", F.col("gmv") - F.col("previous_gmv"))
            .withColumn("change_pct", ratio(F.col("change"), F.col("previous_gmv"))))


def top_movers(df: DataFrame, now: tuple, before: tuple, dimension: str, n: int = 5,
               min_orders: int = 0) -> DataFrame:
    """Members that moved most by absolute change, above a minimum base volume."""
    out = compare_periods(df.filter(F.col(dimension).isNotNull()), now, before, dimension,
                          min_orders=min_orders)
    rows = out.withColumn("direction", F.when(F.col("change") >= 0, "up").otherwise("down"))
    return top(rows.withColumn("_size", F.abs("change")), "_size", dimension, n).drop("_size")


def aligned_periods(df: DataFrame, first: tuple, second: tuple) -> DataFrame:
    """Revenue of two periods by day of period."""
    a, b = _between(first), _between(second)
    offset = F.when(a, F.datediff(F.to_date("order_time"), F.lit(first[0]))).otherwise(
        F.datediff(F.to_date("order_time"), F.lit(second[0])))
    return df.filter(a | b).groupBy(offset.cast("bigint").alias("day_of_period")).agg(
        gmv(a).alias("gmv_a"), gmv(b).alias("gmv_b"))


def day_over_day(df: DataFrame) -> DataFrame:
    daily = df.groupBy(F.to_date("order_time").alias("day")).agg(gmv().alias("gmv"))
    previous = F.lag("gmv").over(Window.partitionBy().orderBy("day"))      # one row per day
    return daily.withColumn("previous", previous).withColumn(
        "change_pct", ratio(F.col("gmv") - F.col("previous"), F.col("previous")))


def weekly_rolling(df: DataFrame, weeks: int = 4) -> DataFrame:
    weekly = df.groupBy(F.date_trunc("week", "order_time").cast("date").alias("week")).agg(
        gmv().alias("gmv"))
    w = Window.partitionBy().orderBy("week").rowsBetween(-(weeks - 1), 0)  # one row per week
    return weekly.withColumn("rolling", F.avg("gmv").over(w))


def week_on_week(df: DataFrame, *by: str) -> DataFrame:
    """Orders per week with week-on-week % (previous above zero) and the mean of the last four."""
    weekly = df.groupBy(*by, F.date_trunc("week", "order_time").cast("date").alias("week")).agg(
        orders(df).alias("orders"))
    w = Window.partitionBy(*by).orderBy("week")
    previous = F.lag("orders").over(w)
    return weekly.withColumn(
        "wow_pct", F.when(previous > 0, (F.col("orders") - previous) / previous * 100.0)).withColumn(
        "avg4", F.avg("orders").over(w.rowsBetween(-3, 0)))


def anomaly_signals(df: DataFrame, today: date, *by: str,
                    threshold: float = config.ANOMALY_THRESHOLD) -> DataFrame:
    """Daily mean of the last 7 days against the 28 days before."""
    recent = _between((today - timedelta(days=6), today))
    base = _between((today - timedelta(days=34), today - timedelta(days=7)))
    rows = df.filter(recent | base)
    out = rows.groupBy(*by).agg((gmv(recent) / 7.0).alias("recent"), (gmv(base) / 28.0).alias("baseline"))
    change = ratio(F.col("recent") - F.col("baseline"), F.col("baseline"))
    return out.withColumn("change", change).withColumn(
        "anomaly", F.coalesce((F.abs("change") > threshold).cast("int"), F.lit(0)))


def month_pace(df: DataFrame) -> DataFrame:
    """Month to date of the latest month, run rate and projection to its end."""
    daily = stable(df.groupBy(F.to_date("order_time").alias("day")).agg(gmv().alias("gmv")))
    last = daily.select(F.max("day")).scalar()
    current = daily.filter(F.trunc("day", "month") == F.trunc(last, "month"))
    out = current.agg(F.max("day").alias("as_of"), F.sum("gmv").alias("month_to_date"))
    elapsed, length = F.dayofmonth("as_of"), F.dayofmonth(F.last_day("as_of"))
    return out.withColumn("projection", F.col("month_to_date") / elapsed * length)
