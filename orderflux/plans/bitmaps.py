"""Distinct users of any roll-up and overlaps of periods from bitmaps, without shuffling user ids again.

User ids get dense numbers once; each market and day then holds its users as bits, 64 to a row, and only rows that have any.
So there are never more rows than users of a day, however thinly these are spread, and a row is a few numbers that aggregate by
hash. Rows of coarser periods are unions of these, overlaps are intersections, and counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflux.functions.expressions import ratio
from orderflux.session import stable

GRAINS = {"day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER", "year": "YEAR"}


def user_numbers(df: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, number): all user ids but NULL, numbered from 1 without gaps.

    Numbers are given within range partitions and moved by the sizes of those before: one row per partition is ordered.
    """
    ids = df.select(user).where(F.col(user).isNotNull()).distinct().repartitionByRange(user)
    placed = stable(ids.select(user, F.spark_partition_id().alias("_part"),
                               F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").select(user, (F.col("_start") + F.col("_at") + 1).alias("number"))


def user_bitmaps(df: DataFrame, numbers: DataFrame, *by: str, user: str = "user_id", time: str = "order_time") -> DataFrame:
    """(by, day, bucket, users): the users of each day as the bits of a long. Only here do ids meet their numbers."""
    number = F.col("number")
    rows = df.where(F.col(time).isNotNull()).select(*by, F.to_date(time).alias("day"), user).join(numbers, user)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
    return rows.groupBy(*by, "day", F.shiftright(number, 6).alias("bucket")).agg(F.bit_or(bit).alias("users"))


def period(grain: str) -> Column:
    return F.date_trunc(GRAINS[grain], "day").cast("date")


def united(bitmaps: DataFrame, *by: str, grain: str | None = None) -> DataFrame:
    """Bitmaps of coarser rows: those of ``by``, and of the periods of a grain as ``period``."""
    keys = [*by, *([period(grain).alias("period")] if grain else [])]
    return bitmaps.groupBy(*keys, "bucket").agg(F.bit_or("users").alias("users"))


def distinct_users(bitmaps: DataFrame, *by: str, grain: str | None = None) -> DataFrame:
    """Exact number of distinct users of each roll-up that has any."""
    rows = united(bitmaps, *by, grain=grain)
    keys = [*by, *(["period"] if grain else [])]
    return rows.groupBy(*keys).agg(F.sum(F.bit_count("users").cast("long")).alias("users"))


def returning_users(bitmaps: DataFrame, *by: str, months: int = 1) -> DataFrame:
    """Users of each month who had also bought ``months`` before: (by, month, users, repeat_users, repurchase_rate)."""
    rows = stable(united(bitmaps, *by, grain="month"))
    shifted = rows.withColumn("period", F.add_months("period", months))
    both = rows.unionByName(shifted).groupBy(*by, "period", "bucket").agg(
        F.bit_and("users").alias("users"), F.count(F.lit(1)).alias("_n")).where("_n = 2")
    repeats = both.groupBy(*by, "period").agg(F.sum(F.bit_count("users").cast("long")).alias("repeat_users"))
    out = rows.groupBy(*by, "period").agg(F.sum(F.bit_count("users").cast("long")).alias("users")).join(repeats, [*by, "period"], "left")
    return out.select(*by, F.col("period").alias("month"), "users", F.coalesce("repeat_users", F.lit(0)).alias("repeat_users")).withColumn(
        "repurchase_rate", ratio(F.col("repeat_users"), F.col("users")))
