"""Category, denomination, data-package, supplier and destination metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflux import config
from orderflux.functions import expressions as E
from orderflux.functions.dimensions import add_category_class, add_destination
from orderflux.functions.expressions import month, ratio
from orderflux.functions.measures import gmv, orders, top, with_share
from orderflux.operators.filters import data_rows
from orderflux.operators.geo import same_market
from orderflux.operators.ordering import keep_top_members, top_per_group
from orderflux.session import stable


def _economics(df: DataFrame) -> list:
    return [orders(df).alias("orders"), gmv().alias("gmv"), gmv(column="settlement_rmb").alias("cost")]


def _margins(df: DataFrame) -> DataFrame:
    return (df.withColumn("margin", F.col("gmv") - F.col("cost"))
            .withColumn("margin_pct", ratio(F.col("gmv") - F.col("cost"), F.col("gmv"))))


def fulfilment_kpis(df: DataFrame) -> DataFrame:
    """All statuses: supplier-id coverage, unreconcilable successful orders, PIN and gateway share."""
    usable = E.usable_supplier_id(F.col("interface_order_id")).isNotNull()
    b2b, b2c = F.col("segment") == "B2B", F.col("segment") == "B2C"
    out = df.agg(
        orders(df).alias("orders"), orders(df, usable).alias("with_supplier_id"),
        orders(df, E.is_successful() & ~usable).alias("unreconcilable"),
        orders(df, b2b).alias("b2b"), orders(df, b2b & F.col("pin_code").isNotNull()).alias("pin"),
        orders(df, b2c).alias("b2c"),
        orders(df, b2c & F.col("gateway_order_id").isNotNull()).alias("gateway"))
    return out.select("orders", "unreconcilable",
                      ratio(F.col("with_supplier_id"), F.col("orders")).alias("supplier_id_coverage"),
                      ratio(F.col("pin"), F.col("b2b")).alias("pin_share"),
                      ratio(F.col("gateway"), F.col("b2c")).alias("gateway_share"))


def routing_gap(df: DataFrame) -> DataFrame:
    """Successful orders without a usable supplier id, per operator."""
    missing = E.usable_supplier_id(F.col("interface_order_id")).isNull()
    rows = df.filter("operator IS NOT NULL")
    out = rows.groupBy("operator").agg(orders(rows).alias("orders"),
                                       orders(rows, missing).alias("missing"))
    return out.withColumn("missing_share", ratio(F.col("missing"), F.col("orders")))


def category_overview(df: DataFrame) -> DataFrame:
    rows = add_category_class(df)
    return _margins(rows.groupBy("category_class").agg(*_economics(rows)))


def category_monthly(df: DataFrame, n: int = 6) -> DataFrame:
    rows = add_category_class(df)
    cells = rows.groupBy("category_class", month(F.col("order_time")).alias("month")).agg(
        gmv().alias("gmv"), orders(rows).alias("orders"))
    return keep_top_members(stable(cells), "category_class", n, "gmv")


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", E.denomination_label(F.col("sku_name"), F.col("denomination")))


def airtime_denominations(df: DataFrame, n: int = 20) -> DataFrame:
    rows = _labelled(df.filter(E.is_airtime_category(F.col("product_category"))))
    out = rows.groupBy("label").agg(orders(rows).alias("orders"), gmv().alias("gmv"))
    return top(out, "orders", "label", n)


def denomination_by_operator(df: DataFrame) -> DataFrame:
    rows = _labelled(df).filter("operator IS NOT NULL AND label IS NOT NULL")
    return rows.groupBy("label", "operator").agg(orders(rows).alias("orders"), gmv().alias("gmv"))


def denomination_bands(df: DataFrame, edges=config.DENOMINATION_BAND_EDGES) -> DataFrame:
    band = E.bands(E.to_number(F.col("denomination")), edges)
    rows = df.withColumn("band", band).filter("band IS NOT NULL")
    return with_share(rows.groupBy("band").agg(gmv().alias("gmv")), bounded=True)


def denomination_scorecard(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Operator x denomination x product. ``limit`` is the display cap; exports leave it open."""
    out = _margins(df.groupBy("operator", "denomination", "product").agg(*_economics(df)))
    return top(out, "gmv", ["operator", "denomination", "product"], limit) if limit else out


def _packages(df: DataFrame) -> DataFrame:
    mb = E.package_mb(F.col("sku_name"), F.col("product"))
    return (df.filter(data_rows()).withColumn("volume_mb", mb)
            .withColumn("volume", E.package_label(mb)))


def packages_by_volume(df: DataFrame) -> DataFrame:
    rows = _packages(df)
    return rows.groupBy("volume_mb", "volume").agg(orders(rows).alias("orders"), gmv().alias("gmv"))


def packages_by_tier(df: DataFrame, edges=config.PACKAGE_TIER_EDGES_MB) -> DataFrame:
    rows = _packages(df)
    tier = (F.when(F.col("volume_mb") >= float(config.UNLIMITED_MB), "Unlimited")
            .otherwise(E.bands(F.col("volume_mb"), edges, "MB")))
    return rows.groupBy(tier.alias("tier")).agg(orders(rows).alias("orders"), gmv().alias("gmv"))


def packages_by_operator(df: DataFrame) -> DataFrame:
    rows = _packages(df).filter("operator IS NOT NULL")
    return rows.groupBy("operator", "volume").agg(orders(rows).alias("orders"), gmv().alias("gmv"))


def operator_category(df: DataFrame) -> DataFrame:
    rows = add_category_class(df.filter("operator IS NOT NULL"))
    return rows.groupBy("operator", "category_class").agg(gmv().alias("gmv"),
                                                          orders(rows).alias("orders"))


def operator_category_pivot(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Operators by rows, classes by columns; the class list is fixed, so no extra pass finds it."""
    from orderflux.functions import values as V
    classes = [*V.CATEGORY_CLASSES, V.UNMAPPED_CLASS]
    wide = operator_category(df).groupBy("operator").pivot("category_class", classes).agg(F.sum("gmv"))
    names = [V.LABELS_EN.get(c, "Other") for c in classes]
    filled = [F.coalesce(f"`{c}`", F.lit(0.0)).alias(n.lower().replace("-", "").replace("/", "_")
                                                    .replace(" ", "_")) for c, n in zip(classes, names)]
    out = wide.select("operator", *filled)
    total = sum((F.col(c) for c in out.columns[1:]), F.lit(0.0))
    out = out.withColumn("total", total)
    return top(out, "total", "operator", limit) if limit else out


def product_tree(df: DataFrame) -> DataFrame:
    """Class and product revenue with sub-totals; ``level`` 0 = product, 1 = class, 3 = all."""
    rows = add_category_class(df)
    return rows.rollup("category_class", "product").agg(
        gmv().alias("gmv"), orders(rows).alias("orders"), F.grouping_id().cast("int").alias("level"))


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    rows = df.filter("product IS NOT NULL")
    return top(rows.groupBy("product", "segment").agg(gmv().alias("gmv"), orders(rows).alias("orders")),
               "gmv", ["product", "segment"], n)


def top_destinations(df: DataFrame, n: int = 15) -> DataFrame:
    rows = add_destination(df)
    return top(rows.groupBy("destination").agg(orders(rows).alias("orders"), gmv().alias("gmv")),
               "orders", "destination", n)


def corridors(df: DataFrame) -> DataFrame:
    """Market to destination flows where the two differ after alias matching."""
    rows = same_market(add_destination(df)).filter("NOT same_market")
    return rows.groupBy("country", "destination").agg(orders(rows).alias("orders"), gmv().alias("gmv"))


def ranking_by_customer_type(df: DataFrame, by: str = "orders", n: int = 5) -> DataFrame:
    """Best (brand, label) per customer type and airtime/data class."""
    from orderflux.plans.customers import customer_type
    category = F.col("product_category")
    kind = F.when(E.is_airtime_category(category), "Airtime").when(E.is_data_category(category), "Data")
    rows = (_labelled(df).withColumn("kind", kind).withColumn("customer_type", customer_type())
            .filter("kind IS NOT NULL"))
    out = rows.groupBy("customer_type", "kind", "brand", "label").agg(
        orders(rows).alias("orders"), gmv().alias("gmv"))
    return top_per_group(out, ["customer_type", "kind"], by, ["brand", "label"], n)


def supplier_concentration(df: DataFrame, n: int = 3,
                           limit: float = config.SUPPLIER_TOP_SHARE_LIMIT) -> DataFrame:
    """Share of the n largest operators per category class, flagged above the threshold."""
    rows = add_category_class(df.filter("operator IS NOT NULL"))
    cells = stable(rows.groupBy("category_class", "operator").agg(gmv().alias("gmv")))
    total = cells.groupBy("category_class").agg(F.sum("gmv").alias("total"),
                                                F.count(F.lit(1)).alias("operators"))
    best = (top_per_group(cells, ["category_class"], "gmv", ["operator"], n)
            .groupBy("category_class").agg(F.sum("gmv").alias("top_gmv")))
    return (total.join(best, "category_class")
            .withColumn("top_share", ratio(F.col("top_gmv"), F.col("total")))
            .withColumn("concentrated", (F.col("top_share") > limit).cast("int")))


def pin_store_weekly(df: DataFrame, weeks: int = 12) -> DataFrame:
    """Weekly orders per operator and denomination for the latest weeks of PIN orders."""
    from orderflux.operators.ordering import last_periods
    rows = df.filter("pin_code IS NOT NULL").withColumn(
        "week", F.date_trunc("week", "order_time").cast("date"))
    cells = rows.groupBy("week", "operator", "denomination").agg(orders(rows).alias("orders"))
    return last_periods(stable(cells), "week", weeks)


def pin_stock_estimate(df: DataFrame, weeks: int = config.PIN_STOCK_WEEKS) -> DataFrame:
    """Mean weekly orders over the latest weeks, empty weeks counted as zero."""
    recent = stable(pin_store_weekly(df, weeks))
    present = recent.select(F.count_distinct("week")).scalar()
    return recent.groupBy("operator", "denomination").agg(F.sum("orders").alias("orders")).withColumn(
        "weekly_estimate", ratio(F.col("orders"), present))
