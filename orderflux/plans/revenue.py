"""Revenue, order-quality and market metrics. Inputs are filtered facts, outputs DataFrames.

Unless a function says "all statuses", pass successful orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflux import config
from orderflux.functions.expressions import month, ratio, to_number
from orderflux.functions.measures import gmv, orders, top, users, with_share
from orderflux.operators.filters import quality_view
from orderflux.operators.ordering import exact_median, keep_top_members, last_periods
from orderflux.session import stable

GRAINS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def _aov(df: DataFrame) -> DataFrame:
    return df.withColumn("aov", ratio(F.col("gmv"), F.col("orders")))


def kpi_set(df: DataFrame, *by: str) -> DataFrame:
    """GMV, orders, AOV, users and markets, overall or by dimensions."""
    return _aov(df.groupBy(*by).agg(
        gmv().alias("gmv"), orders(df).alias("orders"), users().alias("users"),
        F.count_distinct("country").alias("markets")))


def margin(df: DataFrame, *by: str) -> DataFrame:
    """Gross margin and margin % on settlement converted to RMB."""
    out = df.groupBy(*by).agg(gmv().alias("gmv"), gmv(column="settlement_rmb").alias("cost"))
    return (out.withColumn("margin", F.col("gmv") - F.col("cost"))
            .withColumn("margin_pct", ratio(F.col("gmv") - F.col("cost"), F.col("gmv"))))


def net_contribution(df: DataFrame) -> DataFrame:
    """All statuses: GMV of paid orders less refunds, coupon spend and cost of goods."""
    q = quality_view(df)
    ok, refunded = F.col("status_group") == "Successful", F.col("status_group") == "Refunded"
    out = q.agg(gmv(ok | refunded).alias("gmv"), gmv(refunded).alias("refunds"),
                gmv(ok, "coupon_amount").alias("coupon_spend"),
                gmv(ok, "settlement_rmb").alias("cogs"))
    return out.withColumn("net_contribution", F.col("gmv") - F.col("refunds")
                          - F.col("coupon_spend") - F.col("cogs"))


def status_kpis(df: DataFrame, *by: str) -> DataFrame:
    """All statuses: order counts and rates per status group, refunded GMV."""
    q = quality_view(df)
    group = F.col("status_group")
    out = q.groupBy(*by).agg(
        orders(q).alias("orders"),
        *[orders(q, group == g).alias(g.lower())
          for g in ("Successful", "Refunded", "Cancelled", "Pending")],
        gmv(group == "Refunded").alias("refunded_gmv"))
    for g, name in (("successful", "success"), ("refunded", "refund"), ("cancelled", "cancel"),
                    ("pending", "pending")):
        out = out.withColumn(f"{name}_rate", ratio(F.col(g), F.col("orders")))
    return out


def orders_by_status_segment(df: DataFrame) -> DataFrame:
    q = quality_view(df)
    return q.groupBy("status_group", "segment").agg(orders(q).alias("orders"))


def status_by_segment_pivot(df: DataFrame) -> DataFrame:
    """One row per status with a column per segment; conditional sums of the small long form."""
    long = orders_by_status_segment(df)
    return (long.groupBy("status_group").pivot("segment", ["B2B", "B2C"]).agg(F.sum("orders"))
            .select("status_group", F.coalesce("B2B", F.lit(0)).alias("b2b_orders"),
                    F.coalesce("B2C", F.lit(0)).alias("b2c_orders")))


def monthly_refund_rate(df: DataFrame) -> DataFrame:
    q = quality_view(df)
    out = q.groupBy(month(F.col("order_time")).alias("month"), "segment").agg(
        orders(q).alias("orders"), orders(q, F.col("status_group") == "Refunded").alias("refunded"))
    return out.withColumn("refund_rate", ratio(F.col("refunded"), F.col("orders")))


def refund_rate_by_operator(df: DataFrame, min_orders: int = config.REFUND_RATE_MIN_ORDERS,
                            n: int = 10) -> DataFrame:
    q = quality_view(df).filter("operator IS NOT NULL")
    out = (q.groupBy("operator").agg(
        orders(q).alias("orders"), orders(q, F.col("status_group") == "Refunded").alias("refunded"))
        .filter(F.col("orders") >= min_orders)
        .withColumn("refund_rate", ratio(F.col("refunded"), F.col("orders"))))
    return top(out, "refund_rate", "operator", n)


def trend(df: DataFrame, grain: str = "D", *by: str) -> DataFrame:
    """Revenue and orders per day, week (from Monday), month, quarter or year."""
    period = F.date_trunc(GRAINS[grain], "order_time").cast("date").alias("period")
    return df.groupBy(period, *by).agg(gmv().alias("gmv"), orders(df).alias("orders"))


def mix(df: DataFrame, dimension: str, bounded: bool = False) -> DataFrame:
    return with_share(df.groupBy(dimension).agg(gmv().alias("gmv")), bounded=bounded)


def segment_summary(df: DataFrame) -> DataFrame:
    out = df.groupBy("segment").agg(gmv().alias("gmv"), orders(df).alias("orders"),
                                    users().alias("users"))
    return with_share(_aov(out), bounded=True)


def market_table(df: DataFrame, *by: str) -> DataFrame:
    out = df.groupBy("country", *by).agg(
        gmv().alias("gmv"), orders(df).alias("orders"), users().alias("users"),
        F.avg(to_number(F.col("denomination"))).alias("avg_denomination"))
    return with_share(_aov(out))


def market_month_heatmap(df: DataFrame, n: int = 15) -> DataFrame:
    """Revenue of the top markets by month. The month totals are small; they are ranked, not the fact."""
    cells = stable(df.groupBy("country", month(F.col("order_time")).alias("month"))
                   .agg(gmv().alias("gmv")))
    return keep_top_members(cells, "country", n, "gmv")


def weekday_hour(df: DataFrame) -> DataFrame:
    return df.groupBy(F.weekday("order_time").alias("weekday"), F.hour("order_time").alias("hour")).agg(
        orders(df).alias("orders"))


def ops_kpis(df: DataFrame) -> DataFrame:
    """Mean daily revenue and orders over active days, peak day and peak hour (ties: earliest)."""
    cells = stable(df.groupBy(F.to_date("order_time").alias("day"), F.hour("order_time").alias("hour")).agg(
        gmv().alias("gmv"), orders(df).alias("orders")))
    by_day = cells.groupBy("day").agg(F.sum("gmv").alias("gmv"), F.sum("orders").alias("orders"))
    by_hour = cells.groupBy("hour").agg(F.sum("orders").alias("orders"))
    days = by_day.agg(
        F.avg("gmv").alias("avg_daily_gmv"), F.avg("orders").alias("avg_daily_orders"),
        F.max_by("day", F.struct("gmv", F.negative(F.unix_date("day")))).alias("peak_day"))
    hours = by_hour.select(F.max_by("hour", F.struct("orders", F.negative("hour")))).scalar()
    return days.withColumn("peak_hour", hours)


def operator_scorecard(df: DataFrame, current: tuple, previous: tuple) -> DataFrame:
    """Sales, orders, AOV, margin, share and growth against the previous equal period."""
    day = F.to_date("order_time")
    now = day.between(*[F.lit(d) for d in current])
    before = day.between(*[F.lit(d) for d in previous])
    rows = df.filter(now | before).filter("operator IS NOT NULL")
    out = rows.groupBy("operator").agg(
        gmv(now).alias("gmv"), orders(rows, now).alias("orders"),
        gmv(now, "settlement_rmb").alias("cost"), gmv(before).alias("previous_gmv"))
    out = _aov(out).withColumn("margin", F.col("gmv") - F.col("cost"))
    out = out.withColumn("margin_pct", ratio(F.col("margin"), F.col("gmv")))
    out = out.withColumn("growth", ratio(F.col("gmv") - F.col("previous_gmv"), F.col("previous_gmv")))
    return with_share(out)


def cost_vs_margin(df: DataFrame, n: int = 15) -> DataFrame:
    rows = margin(df.filter("operator IS NOT NULL"), "operator")
    return top(rows.select("operator", "gmv", "cost", "margin"), "gmv", "operator", n)


def margin_trend(df: DataFrame, n: int = 6) -> DataFrame:
    rows = df.filter("operator IS NOT NULL").withColumn("month", month(F.col("order_time")))
    cells = stable(margin(rows, "operator", "month"))
    return keep_top_members(cells, "operator", n, "gmv").select("operator", "month", "margin_pct")


def settlement_audit(df: DataFrame) -> DataFrame:
    """Rows, settlement and median margin % per settlement currency and market."""
    rows = df.withColumn("margin_pct", ratio(F.col("sales") - F.col("settlement_rmb"), F.col("sales")))
    keys = ["settlement_iso", "country"]
    return exact_median(rows, keys, "margin_pct", "median_margin_pct", sums={"settlement_rmb": "settlement_rmb"}).select(
        *keys, "rows", F.coalesce("settlement_rmb", F.lit(0.0)).alias("settlement_rmb"), "median_margin_pct")


def discount_depth(df: DataFrame, *by: str) -> DataFrame:
    """Mean of 1 - paid / listed over rows with a listed price."""
    rows = df.filter("sales_listed > 0")
    depth = 1.0 - F.col("sales_paid") / F.col("sales_listed")
    return rows.groupBy(*by).agg(F.avg(depth).alias("discount_depth"),
                                 F.count("sales_paid").alias("rows"))


def key_markets(df: DataFrame, markets, months: int = 3) -> DataFrame:
    """Monthly KPIs of the key markets and of the rest ('Global') for the latest months."""
    group = F.when(F.col("country").isin(list(markets)), F.col("country")).otherwise("Global")
    cells = df.groupBy(month(F.col("order_time")).alias("month"), group.alias("market")).agg(
        gmv().alias("gmv"), orders(df).alias("orders"))
    return _aov(last_periods(cells, "month", months))


def category_share_recent(df: DataFrame, months: int = 3) -> DataFrame:
    """Airtime against data by orders for the latest months."""
    from orderflux.functions.expressions import is_airtime_category, is_data_category
    category = F.col("product_category")
    kind = F.when(is_airtime_category(category), "Airtime").when(is_data_category(category), "Data")
    rows = df.withColumn("kind", kind).filter("kind IS NOT NULL")
    cells = last_periods(
        rows.groupBy(month(F.col("order_time")).alias("month"), "kind").agg(orders(rows).alias("orders")),
        "month", months)
    total = F.sum("orders").over(Window.partitionBy("month"))     # two rows per month
    return cells.withColumn("share", ratio(F.col("orders"), total))


def opportunity_quadrants(df: DataFrame) -> DataFrame:
    """Markets split at the median of orders and of AOV."""
    rows = stable(_aov(df.filter("country IS NOT NULL").groupBy("country").agg(
        gmv().alias("gmv"), orders(df).alias("orders"))))
    many = F.col("orders") >= rows.select(F.median("orders")).scalar()      # one row per country
    rich = F.col("aov") >= rows.select(F.median("aov")).scalar()
    name = (F.when(many & rich, "high orders, high AOV").when(many, "high orders, low AOV")
            .when(rich, "low orders, high AOV").otherwise("low orders, low AOV"))
    return rows.withColumn("quadrant", name)


def profit_pool(df: DataFrame, dimension: str) -> DataFrame:
    rows = margin(df.filter(F.col(dimension).isNotNull()), dimension).select(
        dimension, "gmv", "margin")
    return with_share(rows, "margin", "margin_share")


def revenue_bridge(df: DataFrame, first: tuple, second: tuple) -> DataFrame:
    """Bridge between two periods: start, volume effect, price effect, end."""
    day = F.to_date("order_time")
    a = day.between(*[F.lit(d) for d in first])
    b = day.between(*[F.lit(d) for d in second])
    rows = df.filter(a | b)
    t = rows.agg(gmv(a).alias("ga"), orders(rows, a).alias("oa"),
                 gmv(b).alias("gb"), orders(rows, b).alias("ob"))
    price_a = F.coalesce(ratio(F.col("ga"), F.col("oa")), F.lit(0.0))
    volume = (F.col("ob") - F.col("oa")) * price_a
    steps = [("1 start", F.col("ga")), ("2 volume", volume),
             ("3 price", F.col("gb") - F.col("ga") - volume), ("4 end", F.col("gb"))]
    return t.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("step"), v.alias("amount")) for n, v in steps])).alias("s")).select("s.*")


def explorer(df: DataFrame, dimensions, measures=("gmv", "orders", "aov"), totals: bool = True):
    """Ad-hoc group-by with shares and, when asked, a total row (NULL dimensions, is_total = 1)."""
    dimensions = list(dimensions)
    aggregates = [gmv().alias("gmv"), orders(df).alias("orders"), users().alias("users"),
                  F.grouping_id().alias("_g")]
    sets = [[F.col(d) for d in dimensions], []] if totals else [[F.col(d) for d in dimensions]]
    out = _aov(df.groupingSets(sets, *dimensions).agg(*aggregates))
    out = out.withColumn("is_total", (F.col("_g") > 0).cast("int"))
    rows = stable(out)
    grand = rows.filter("is_total = 1" if totals else "is_total = 0").select(F.sum("gmv")).scalar()
    return rows.withColumn("share", ratio(F.col("gmv"), grand)).select(
        *dimensions, "is_total", *measures, "share")


def snapshot_counts(df: DataFrame) -> DataFrame:
    """All rows: row count, date range and rows per segment."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min("order_time").alias("first_order"),
                  F.max("order_time").alias("last_order"),
                  F.count_if(F.col("segment") == "B2B").alias("b2b_rows"),
                  F.count_if(F.col("segment") == "B2C").alias("b2c_rows"))


def snapshot_charts(df: DataFrame, months: int = 8, markets: int = 8) -> DataFrame:
    """Revenue of the latest months, by segment and of the top markets, in one long table."""
    cells = stable(df.filter("sales IS NOT NULL").groupBy(
        F.date_format("order_time", "yyyy-MM").alias("month"), "segment", "country")
        .agg(F.sum("sales").alias("gmv")))

    def part(chart: str, key: str) -> DataFrame:
        return (cells.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
                .agg(F.sum("gmv").alias("gmv")).select(F.lit(chart).alias("chart"), "key", "gmv"))

    return (part("month", "month").orderBy(F.desc("key")).limit(months)
            .unionByName(part("segment", "segment"))
            .unionByName(top(part("market", "country"), "gmv", "key", markets)))


def target_overlay(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Monthly actual against a plan table (month, target)."""
    actual = df.groupBy(month(F.col("order_time")).alias("month")).agg(gmv().alias("actual"))
    return actual.join(targets, "month", "left").withColumn(
        "attainment", ratio(F.col("actual"), F.col("target")))


def top_member_trend(df: DataFrame, member: str, n: int) -> DataFrame:
    cells = stable(df.filter(F.col(member).isNotNull())
                   .groupBy(member, month(F.col("order_time")).alias("month"))
                   .agg(gmv().alias("gmv"), orders(df).alias("orders")))
    return keep_top_members(cells, member, n, "gmv")

