"""Dated exchange rates and conversion. Rates are local currency per 1 RMB.

A rate is valid from its month until the next dated month of the same key. The rates are laid out as one
row per currency with the rate of every month, so the as-of lookup is one equi join on the currency and a place in
an array; no range condition is evaluated and planning runs no job. The calendar does not grow with the orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux.functions import values as V
from orderflux.functions.dimensions import fx_snapshot, local_table
from orderflux.functions.expressions import month_text, ratio, strip_ws
from orderflux.functions.measures import mark_unique, unique_orders


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Rate file keyed by ``iso`` or by ``country``; all columns as text."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return clean_rates(raw.withColumnsRenamed({c: c.strip("﻿ ").lower() for c in raw.columns}))


def clean_rates(raw: DataFrame) -> DataFrame:
    """Typed rates; rows without a month, a key or a numeric rate are skipped."""
    def text(name: str) -> Column:
        if name not in raw.columns:
            return F.lit(None).cast("string")
        s = strip_ws(F.col(name).cast("string"))
        return F.when(s != "", s)

    return raw.select(
        F.upper(text("iso")).alias("iso"), text("country").alias("country"),
        text("month").alias("month"), text("rate").try_cast("double").alias("rate"),
    ).filter("month IS NOT NULL AND rate IS NOT NULL AND coalesce(iso, country) IS NOT NULL")


def _snapshot_iso(spark: SparkSession) -> DataFrame:
    return fx_snapshot(spark).coalesce(1).groupBy("iso").agg(F.max("rate").alias("snapshot"))


def rates_by_iso(rates: DataFrame) -> DataFrame:
    """iso, month, rate – rows keyed by country take the currency of that country."""
    base = fx_snapshot(rates.sparkSession).select(F.col("country").alias("_c"), F.col("iso").alias("_iso"))
    keyed = rates.join(base, F.col("iso").isNull() & (F.col("country") == F.col("_c")), "left")
    return keyed.select(F.coalesce("iso", "_iso").alias("iso"), "month", "rate").filter("iso IS NOT NULL")


def rates_by_country(rates: DataFrame) -> DataFrame:
    """country, month, rate – rows keyed by currency apply to every country that uses it."""
    base = fx_snapshot(rates.sparkSession).select(F.col("country").alias("_c"), "iso")
    keyed = rates.filter("iso IS NOT NULL").drop("country").join(base, "iso").select(
        F.col("_c").alias("country"), "month", "rate")
    direct = rates.filter("iso IS NULL").select("country", "month", "rate")
    return direct.unionByName(keyed)


def _month_number(month: Column) -> Column:
    """Months since year 0 of a YYYY-MM text."""
    return (F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")) - 1


def rate_calendar(dated: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """One row per key: its snapshot rate and the rate in force in each month from its first to its last dated one.

    ``keys`` holds keys with their snapshot rate (NULL when there is none); ``how`` joins them to the dated
    ones. A row holds as many rates as months, so its size is bounded by the calendar.
    """
    months = dated.groupBy(key, _month_number(F.col("month")).alias("n")).agg(F.max("rate").alias("rate"))
    lists = months.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "rate"))).alias("d"))
    until = F.transform("d", lambda x, i: F.coalesce(F.get("d", i + 1)["n"], x["n"] + 1))
    filled = F.flatten(F.zip_with("d", until, lambda x, end: F.array_repeat(x["rate"], end - x["n"])))
    rates = lists.select(key, F.get("d", F.lit(0))["n"].alias("_first"), filled.alias("_rates"))
    return keys.join(rates, key, how).select(F.col(key).alias("_key"), "snapshot", "_first", "_rates")


def _join_calendar(df: DataFrame, calendar: DataFrame, key: Column, as_of: Column | None,
                   before: Column, undated: Column, out: str) -> DataFrame:
    """Left join on the key, then the month's place in the key's rates; after the last dated month that rate stays.

    ``before`` answers a month before the first dated one and ``undated`` a missing month.
    """
    place = _month_number(F.lit(None).cast("string") if as_of is None else as_of) - F.col("_first")
    value = (F.when(F.col("_key").isNull(), None).when((F.lit(True) if as_of is None else as_of.isNull()), undated)
             .when(place < 0, before)
             .otherwise(F.coalesce(F.get("_rates", F.least(place, F.size("_rates") - 1)), "snapshot")))
    joined = (df.withColumn("_k", key).join(calendar, F.col("_k") == F.col("_key"), "left")
              .withColumn(out, value).drop("_k", "_key", "snapshot", "_first", "_rates"))
    return mark_unique(joined) if unique_orders(df) else joined


def iso_calendar(rates: DataFrame) -> DataFrame:
    dated = rates_by_iso(rates)
    return rate_calendar(dated, _snapshot_iso(rates.sparkSession), "iso", "full_outer")  # a few hundred currencies


def country_calendar(rates: DataFrame) -> DataFrame:
    """Only countries of the snapshot are known."""
    keys = fx_snapshot(rates.sparkSession).select("country", F.col("rate").alias("snapshot"))
    return rate_calendar(rates_by_country(rates), keys, "country", "left")


def rate_for_iso(df: DataFrame, rates: DataFrame, iso: Column, as_of: Column | None,
                 out: str = "rate") -> DataFrame:
    """Rate of a currency in force at ``as_of`` (YYYY-MM text); NULL for an unknown currency.

    Before the first dated month, and for undated currencies, the snapshot; without a month the latest dated rate.
    """
    return _join_calendar(df, iso_calendar(rates), F.upper(strip_ws(iso)), as_of, F.col("snapshot"),
                          F.coalesce(F.element_at("_rates", -1), "snapshot"), out)


def rate_for_country(df: DataFrame, rates: DataFrame, country: Column, as_of: Column | None,
                     out: str = "rate") -> DataFrame:
    """Rate of a country's currency at ``as_of``; NULL for a country outside the snapshot.

    Before the first dated month the earliest dated rate; without a month, and for undated countries, the snapshot.
    """
    return _join_calendar(df, country_calendar(rates), strip_ws(country), as_of,
                          F.coalesce(F.get("_rates", F.lit(0)), "snapshot"), F.col("snapshot"), out)


def country_currency(df: DataFrame, column: str = "country") -> DataFrame:
    """Symbol and currency code of a country."""
    dim = fx_snapshot(df.sparkSession).select(F.col("country").alias("_c"), "symbol",
                                              F.col("iso").alias("currency"))
    return df.join(dim, strip_ws(F.col(column)) == F.col("_c"), "left").drop("_c")


def settlement_in_rmb(df: DataFrame, rates: DataFrame, iso: str = "settlement_iso") -> DataFrame:
    """settlement_rmb = settlement price / rate of the order month; RMB when no rate is known."""
    rated = rate_for_iso(df, rates, F.col(iso), month_text(F.col("order_time")), "_rate")
    return rated.withColumn(
        "settlement_rmb", F.col("settlement_price") / F.coalesce(F.nullif(F.col("_rate"), F.lit(0.0)),
                                                                 F.lit(1.0))).drop("_rate")


def display_currency(df: DataFrame, rates: DataFrame, mode: str = "RMB", market: str = "All",
                     amount: str = "sales", out: str = "display") -> DataFrame:
    """Amount in RMB, USD (fixed snapshot rate) or the market's own currency at the order month.

    Local currency needs one market; with market = All it stays RMB.
    """
    if mode == "USD":
        usd = fx_snapshot(df.sparkSession).filter("iso = 'USD'").select(F.max("rate")).scalar()
        return df.withColumn(out, F.col(amount) * usd)
    if mode == "Local" and market != "All":
        rated = rate_for_country(df, rates, F.lit(market), month_text(F.col("order_time")), "_r")
        return rated.withColumn(out, F.col(amount) * F.coalesce("_r", F.lit(1.0))).drop("_r")
    return df.withColumn(out, F.col(amount))


def derive_rate_table(daily: DataFrame, latest: DataFrame, needed: DataFrame | None = None,
                      pegs=None, last_month: str | None = None) -> DataFrame:
    """Monthly rate table from daily rates (day, iso, rate) and latest rates (iso, rate).

    Precedence per currency and month: a USD peg over the mean of the daily rates; a currency with
    neither gets its latest rate, in the last month only. RMB itself is left out.
    """
    spark = daily.sparkSession
    mean = (daily.filter("iso <> 'CNY'")
            .groupBy("iso", month_text(F.col("day")).alias("month"))
            .agg(F.avg("rate").alias("rate")).withColumn("source", F.lit("ecb")))
    peg = local_table(spark, "iso string, per_usd double", list((pegs or V.USD_PEGS).items()))
    usd = mean.filter("iso = 'USD'").select("month", F.col("rate").alias("_usd"),
                                            F.lit("USD").alias("_base"))
    pegged = (peg.withColumn("_base", F.lit("USD")).join(usd, "_base")
              .select("iso", "month", (F.col("_usd") * F.col("per_usd")).alias("rate"),
                      F.lit("usd-peg").alias("source")))
    covered = mean.select("iso").unionByName(peg.select("iso")).distinct()
    month_end = F.lit(last_month) if last_month else mean.select(F.max("month")).scalar()
    rest = (latest.filter("iso <> 'CNY'").join(covered, "iso", "left_anti")
            .select("iso", month_end.alias("month"), "rate", F.lit("er-api-latest").alias("source")))
    rows = by_precedence(mean, pegged, rest)
    return rows.join(needed, "iso", "left_semi") if needed is not None else rows


def by_precedence(mean: DataFrame, pegged: DataFrame, rest: DataFrame) -> DataFrame:
    """Union of the three sources; per currency and month the strongest source stays."""
    rank = F.when(F.col("source") == "usd-peg", 3).when(F.col("source") == "ecb", 2).otherwise(1)
    rows = mean.unionByName(pegged).unionByName(rest)
    best = rows.groupBy("iso", "month").agg(
        F.max_by(F.struct("rate", "source"), rank).alias("_best"))
    return best.select("iso", "month", "_best.rate", "_best.source")


def write_rates(rates: DataFrame, path: str) -> bool:
    """Write the table as CSV sorted by iso and month with six decimals; keep the old one when empty."""
    if rates.isEmpty():
        return False
    (rates.select("iso", "month", F.format_string("%.6f", "rate").alias("rate"), "source")
     .orderBy("iso", "month").coalesce(1)       # bounded by currencies x months
     .write.mode("overwrite").option("header", True).csv(path))
    return True


def newest_month(rates: DataFrame) -> DataFrame:
    return rates.select(F.max("month").alias("dated_max_month"))


def margin_columns(df: DataFrame) -> DataFrame:
    margin = F.col("sales") - F.col("settlement_rmb")
    return df.withColumn("margin", margin).withColumn("margin_pct", ratio(margin, F.col("sales")))
