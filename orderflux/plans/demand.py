"""Weekly demand per operator and product group with a linear-trend forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflux import config
from orderflux.functions.expressions import strip_ws
from orderflux.session import stable

GROUP = ["operator", "product_group"]
MIN_ORDERS, MIN_WEEKS, TREND_WEEKS = 10, 2, 8


def _label(df: DataFrame):
    present = [F.col(c) for c in ("product", "product_info", "denomination") if c in df.columns]
    return F.substring(strip_ws(F.coalesce(*present, F.lit("Unknown"))), 1, 40)


def weekly_demand(df: DataFrame) -> DataFrame:
    """Order rows per group and week. A trailing partial week is left out when there are three or more."""
    operator = F.coalesce(F.col("operator"), F.lit("Unknown")) if "operator" in df.columns \
        else F.lit("Unknown")
    week = F.date_trunc("week", "order_time").cast("date")
    cells = stable(df.filter("order_time IS NOT NULL").groupBy(
        strip_ws(operator).alias("operator"), _label(df).alias("product_group"), week.alias("week"))
        .agg(F.count(F.lit(1)).alias("orders"), F.max("order_time").alias("_max")))
    facts = cells.agg(F.max("week").alias("last"), F.max("_max").alias("latest"),
                      F.count_distinct("week").alias("weeks"), F.sum("orders").alias("rows"))
    ends = F.col("last").cast("timestamp") + F.make_dt_interval(F.lit(6), F.lit(12))
    partial = (F.col("weeks") >= 3) & (F.col("latest") < ends)
    cut = facts.select(F.when(partial, F.date_sub("last", 1)).otherwise(F.col("last"))).scalar()
    enough = facts.select(F.col("rows") >= MIN_ORDERS).scalar()
    return cells.filter(F.col("week") <= cut).filter(enough).drop("_max")


def demand_history(df: DataFrame, groups: int = config.DEMAND_TOP_GROUPS,
                   weeks: int = config.DEMAND_WEEKS) -> DataFrame:
    """The largest groups over the latest weeks, zero-filled, with week index ``t``."""
    cells = weekly_demand(df)
    best = (cells.groupBy(*GROUP).agg(F.sum("orders").alias("volume"))
            .orderBy(F.desc("volume"), *GROUP).limit(groups))
    calendar = (cells.select("week").distinct().orderBy(F.desc("week")).limit(weeks)
                .agg(F.sort_array(F.collect_list("week")).alias("calendar")))
    present = calendar.select("calendar").scalar()
    slots = best.select(*GROUP, F.posexplode(present).alias("t", "week"))
    filled = slots.join(cells, [*GROUP, "week"], "left")
    enough = cells.select(F.count_distinct("week") >= MIN_WEEKS).scalar()
    return filled.select(*GROUP, "t", "week", F.coalesce("orders", F.lit(0)).cast("double").alias("orders")
                         ).filter(enough)


def forecast_demand(df: DataFrame, horizon: int = 4, groups: int = config.DEMAND_TOP_GROUPS) -> DataFrame:
    """Per group: 4-week mean, week-on-week %, trend and ``horizon`` weekly forecasts with a band.

    With eight weeks or more a least-squares line is extended, floored at zero, with 1.64 standard
    deviations of its residuals as band; otherwise the 4-week mean with a fifth of it.
    """
    hist = stable(demand_history(df, groups))
    line = hist.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("orders", "t").alias("slope"),
        F.regr_intercept("orders", "t").alias("intercept"))
    w = Window.partitionBy(*GROUP)                                # at most twelve rows
    rows = (hist.join(line, GROUP)
            .withColumn("_resid", F.col("orders") - (F.col("intercept") + F.col("slope") * F.col("t")))
            .withColumn("_back", F.col("n") - 1 - F.col("t"))
            .withColumn("_mean", F.avg(F.when(F.col("_back") < 4, F.col("orders"))).over(w)))
    fit = rows.groupBy(*GROUP, "n", "slope", "intercept").agg(
        F.first("_mean").alias("avg4"), F.stddev_pop("_resid").alias("_std"),
        F.max(F.when(F.col("_back") == 0, F.col("orders"))).alias("_last"),
        F.max(F.when(F.col("_back") == 1, F.col("orders"))).alias("_previous"))
    long = F.col("n") >= TREND_WEEKS
    trend = (F.when(long & (F.col("slope") > F.col("avg4") * 0.02), "up")
             .when(long & (F.col("slope") < -F.col("avg4") * 0.02), "down").otherwise("flat"))
    band = F.when(long, F.col("_std")).otherwise(F.col("avg4") * 0.20) * 1.64
    out = fit.withColumn("trend", trend).withColumn("_band", band).withColumn(
        "wow_pct", F.when(F.col("_previous") > 0,
                          F.bround((F.col("_last") - F.col("_previous")) / F.col("_previous") * 100, 0)))
    for i in range(1, horizon + 1):
        point = F.when(long, F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope")
                                        * (F.col("n") + (i - 1)))).otherwise(F.col("avg4"))
        out = (out.withColumn(f"wk{i}_forecast", F.bround(point, 0))
               .withColumn(f"wk{i}_low", F.bround(F.greatest(F.lit(0.0), point - F.col("_band")), 0))
               .withColumn(f"wk{i}_high", F.bround(point + F.col("_band"), 0)))
    steps = [f"wk{i}_{k}" for i in range(1, horizon + 1) for k in ("forecast", "low", "high")]
    return out.select(*GROUP, F.bround("avg4", 1).alias("avg4"), "wow_pct", "trend", *steps).orderBy(
        F.desc("avg4"), *GROUP)
