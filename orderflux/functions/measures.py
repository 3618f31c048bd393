"""Aggregate expressions shared by the metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflux.functions.expressions import ratio
from orderflux.session import stable


#: Steps of a plan that give at most one row for each row they read.
_ROW_WISE = {"Project", "Filter", "SubqueryAlias", "Sort", "GlobalLimit", "LocalLimit", "Window"}


def mark_unique(df: DataFrame) -> DataFrame:
    """State that ``order_id`` is unique in ``df``, as publication and joins with keyed tables know."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"unique": True}) if c == "order_id" else F.col(f"`{c}`")
                       for c in df.columns])


def unique_orders(df: DataFrame) -> bool:
    """Whether ``order_id`` was marked unique and only row-wise steps came after.

    The mark itself outlives unions, joins and explosions, so the steps since the mark are looked at: the first one that
    could repeat a row ends the trust.
    """
    if "order_id" not in df.columns or not df.schema["order_id"].metadata.get("unique"):
        return False
    node = df._jdf.queryExecution().analyzed()
    while True:
        name = node.nodeName()
        if name == "Project":
            columns = node.projectList()
            for i in range(columns.size()):
                c = columns.apply(i)
                if c.name() == "order_id" and c.nodeName() == "Alias" and c.explicitMetadata().isDefined():
                    return True
        if name not in _ROW_WISE:
            return False
        node = node.children().head()


def orders(df: DataFrame, when: Column | None = None) -> Column:
    """Distinct orders; a plain count, which shuffles no ids, where :func:`unique_orders` holds."""
    column = F.col("order_id") if when is None else F.when(when, F.col("order_id"))
    return F.count(column) if unique_orders(df) else F.count_distinct(column)


def gmv(when: Column | None = None, column: str = "sales") -> Column:
    value = F.col(column) if when is None else F.when(when, F.col(column))
    return F.coalesce(F.sum(value), F.lit(0.0))


def users(when: Column | None = None) -> Column:
    column = F.col("user_id") if when is None else F.when(when, F.col("user_id"))
    return F.count_distinct(column)


def with_share(df: DataFrame, measure: str = "gmv", out: str = "share",
               bounded: bool = False) -> DataFrame:
    """Share of the grand total of aggregated rows.

    ``bounded`` rows (segments, regions, classes, months) share one small window. Other rows are
    checkpointed once and the total is a scalar subquery over them, so neither is a second scan of the
    fact planned nor are all rows sent to one task.
    """
    if bounded:
        total = F.sum(measure).over(Window.partitionBy())
        return df.withColumn(out, ratio(F.col(measure), total))
    rows = stable(df)
    return rows.withColumn(out, ratio(F.col(measure), rows.select(F.sum(measure)).scalar()))


def top(df: DataFrame, measure: str, keys, n: int) -> DataFrame:
    """First ``n`` rows by a measure, ties broken by key; plans as TakeOrderedAndProject."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.orderBy(F.desc(measure), *keys).limit(n)
