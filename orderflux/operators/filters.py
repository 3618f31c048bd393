"""Composable predicates. Each returns a Column, so Catalyst can push it down."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflux.functions import values as V
from orderflux.functions.expressions import is_data_category, status_group

ALL = "All"


def _all(predicates) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def _one(column: str, value) -> list[Column]:
    if value in (None, ALL, [], ()):
        return []
    return [F.col(column).isin(list(value) if isinstance(value, (list, tuple, set)) else [value])]


def status(choice: str = "Successful", column: str = "order_status") -> Column:
    """Successful (default), All, Non-successful, Refunded, Cancelled or Pending."""
    raw = F.col(column)
    if choice == ALL:
        return F.lit(True)
    if choice == "Non-successful":
        return ~F.coalesce(raw.isin(V.STATUS_GROUPS["Successful"]), F.lit(False))
    return raw.isin(V.STATUS_GROUPS[choice])


def raw_categories(top: str | None = None, subs=None) -> list[str]:
    """Raw category values selected by a class and, optionally, some of its members."""
    if not top or top == ALL:
        return [raw for raws in V.CATEGORY_CLASSES.values() for raw in raws]
    group = V.CATEGORY_CLASSES.get(top, [])
    return [raw for raw in group if raw in set(subs)] if subs else list(group)


def category(top: str | None = None, subs=None, column: str = "product_category") -> Column:
    """Active category filter; raw values without a class never pass."""
    chosen = raw_categories(top, subs)
    return F.col(column).isin(chosen) if chosen else F.lit(False)


def ewallet_values() -> list[str]:
    return [raw for cls in V.EWALLET_CLASSES for raw in V.CATEGORY_CLASSES[cls]]


def exclude_ewallet(selected_class: str | None = None, column: str = "product_category") -> Column:
    """Global e-wallet exclusion, lifted by an explicit e-wallet selection; NULLs stay."""
    if selected_class in V.EWALLET_CLASSES:
        return F.lit(True)
    return F.coalesce(~F.col(column).isin(ewallet_values()), F.lit(True))


def exclude_markets(view: str, markets=("Malaysia",), column: str = "country") -> Column:
    """Roll-up views leave the named markets out; a single-market view does not."""
    if view == "single":
        return F.lit(True)
    return F.coalesce(~F.col(column).isin(list(markets)), F.lit(True))


def date_range(start: date | None = None, end: date | None = None,
               column: str = "order_time", partition: str | None = None) -> Column:
    """Inclusive day range. With ``partition`` the month bound is added so files are pruned."""
    parts = []
    if start:
        parts.append(F.col(column) >= F.lit(start).cast("timestamp"))
        if partition:
            parts.append(F.col(partition) >= F.lit(start.strftime("%Y-%m")))
    if end:
        parts.append(F.col(column) < F.lit(end + timedelta(days=1)).cast("timestamp"))
        if partition:
            parts.append(F.col(partition) <= F.lit(end.strftime("%Y-%m")))
    return _all(parts)


def quick_period(name: str, today: date) -> tuple[date, date]:
    """Named period ending on ``today``."""
    if name.startswith("last_") and name.endswith("_days"):
        return today - timedelta(days=int(name.split("_")[1]) - 1), today
    month_start = today.replace(day=1)
    if name == "this_month":
        return month_start, today
    if name == "last_month":
        end = month_start - timedelta(days=1)
        return end.replace(day=1), end
    if name == "this_year":
        return today.replace(month=1, day=1), today
    raise ValueError(f"unknown period {name!r}")


def previous_period(start: date, end: date) -> tuple[date, date]:
    """The period of the same length that ends the day before ``start``."""
    length = (end - start).days + 1
    return start - timedelta(days=length), start - timedelta(days=1)


def sidebar(segment=None, statuses: str = "Successful", region=None, market=None,
            category_class: str | None = None, subcategories=None, currency=None,
            start: date | None = None, end: date | None = None,
            ewallet: bool = False, partition: str | None = None) -> Column:
    """The whole filter chain as one predicate; ``partition`` names the month column to prune by."""
    parts = [status(statuses)]
    parts += _one("segment", segment) + _one("region", region) + _one("country", market)
    parts += _one("settlement_iso", currency)
    if category_class and category_class != ALL:
        parts.append(category(category_class, subcategories))
    if not ewallet:
        parts.append(exclude_ewallet(category_class))
    parts.append(date_range(start, end, partition=partition))
    return _all(parts)


def product_tab(operator=ALL, category_class: str = ALL) -> Column:
    parts = _one("operator", operator)
    if category_class != ALL:
        parts.append(category(category_class))
    return _all(parts)


def map_channels(df: DataFrame, mapping: DataFrame, column: str = "user_source",
                 out: str = "member_source") -> DataFrame:
    """Raw source to member source; sources marked 删除 are dropped, unmapped ones kept as is."""
    m = mapping.select(F.col("source").alias("_source"), F.col("member").alias("_member"))
    joined = df.join(m, F.col(column) == F.col("_source"), "left")
    return (joined.filter(F.coalesce(F.col("_member") != "删除", F.lit(True)))
            .withColumn(out, F.coalesce("_member", column)).drop("_source", "_member"))


def quality_view(df: DataFrame) -> DataFrame:
    """Rows for the quality metrics: every status, with its group."""
    return df.withColumn("status_group", status_group(F.col("order_status")))


def data_rows() -> Column:
    return is_data_category(F.col("product_category"))
