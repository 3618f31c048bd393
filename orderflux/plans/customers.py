"""Agent, customer-lifecycle, cohort and promotion metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflux import config
from orderflux.functions.expressions import month, normalise_user_id, ratio
from orderflux.functions.measures import gmv, orders, top, users
from orderflux.operators.ordering import last_periods, pareto
from orderflux.session import stable


def b2c(df: DataFrame) -> DataFrame:
    return df.filter("segment = 'B2C' AND user_id IS NOT NULL")


def beneficiary_histogram(df: DataFrame) -> DataFrame:
    """Top-ups per number -> how many numbers."""
    rows = df.filter("recharge_number IS NOT NULL")
    per = rows.groupBy("recharge_number").agg(orders(rows).alias("top_ups"))
    return per.groupBy("top_ups").agg(F.count(F.lit(1)).alias("numbers"))


def beneficiary_kpis(df: DataFrame, reseller: int = config.RESELLER_MIN_NUMBERS) -> DataFrame:
    """Unique numbers over all rows and B2C users with many distinct numbers."""
    numbers = df.select(F.count_distinct("recharge_number")).scalar()
    per_user = b2c(df).groupBy("user_id").agg(F.count_distinct("recharge_number").alias("n"))
    return per_user.agg(F.count(F.lit(1)).alias("users"),
                        F.count_if(F.col("n") >= reseller).alias("resellers")).withColumn(
        "unique_numbers", numbers)


def agent_performance(df: DataFrame, n: int | None = None) -> DataFrame:
    """B2B agents: sales, orders, AOV, share, cumulative share."""
    rows = df.filter("segment = 'B2B' AND agent_name IS NOT NULL")
    per = rows.groupBy("agent_name").agg(gmv().alias("gmv"), orders(rows).alias("orders"))
    out = pareto(per, "gmv").withColumn("aov", ratio(F.col("gmv"), F.col("orders")))
    return top(out, "gmv", "agent_name", n) if n else out


def agent_kpis(df: DataFrame) -> DataFrame:
    rows = df.filter("segment = 'B2B' AND agent_name IS NOT NULL")
    out = rows.agg(F.count_distinct("agent_name").alias("agents"), gmv().alias("gmv"),
                   orders(rows).alias("orders"))
    return out.withColumn("gmv_per_agent", ratio(F.col("gmv"), F.col("agents")))


def customer_averages(df: DataFrame, *by: str) -> DataFrame:
    """Users, and mean orders and revenue per user."""
    rows = b2c(df)
    per = rows.groupBy(*by, "user_id").agg(orders(rows).alias("n"), gmv().alias("s"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("orders"), F.sum("s").alias("gmv"),
        F.avg("n").alias("orders_per_user"), F.avg("s").alias("gmv_per_user"))


def customer_type(order: str = "order_time", register: str = "register_time") -> Column:
    """New when registered in the order's month, Returning when earlier, else Unknown."""
    o, r = month(F.col(order)), month(F.col(register))
    return F.when(r == o, "New").when(r < o, "Returning").otherwise("Unknown")


def new_vs_returning(df: DataFrame) -> DataFrame:
    rows = b2c(df).withColumn("customer_type", customer_type())
    return rows.groupBy(month(F.col("order_time")).alias("month"), "customer_type").agg(
        users().alias("users"), orders(rows).alias("orders"), gmv().alias("gmv"))


def _user_months(df: DataFrame) -> DataFrame:
    """One row per user and active month: the set all month-based measures work on."""
    return b2c(df).select("user_id", month(F.col("order_time")).alias("month")).distinct()


def acquisition(df: DataFrame) -> DataFrame:
    """Users by month of their first order."""
    first = b2c(df).groupBy("user_id").agg(month(F.min("order_time")).alias("month"))
    return first.groupBy("month").agg(F.count(F.lit(1)).alias("users"))


def repurchase_rate(df: DataFrame) -> DataFrame:
    """Users of this month who also bought last month, over users of this month."""
    w = Window.partitionBy("user_id").orderBy("month")      # at most one row per month
    marked = _user_months(df).withColumn("_previous", F.lag("month").over(w))
    again = F.col("_previous") == F.add_months("month", -1)
    out = marked.groupBy("month").agg(F.count(F.lit(1)).alias("users"),
                                      F.count_if(again).alias("repeat_users"))
    return out.withColumn("repurchase_rate", ratio(F.col("repeat_users"), F.col("users")))


def retention_rate(df: DataFrame) -> DataFrame:
    """Last month's new users who bought again this month, over last month's new users."""
    flagged = (b2c(df).withColumn("_new", customer_type() == "New")
               .groupBy("user_id", month(F.col("order_time")).alias("month"))
               .agg(F.max("_new").alias("_new")))
    w = Window.partitionBy("user_id").orderBy("month")
    marked = flagged.withColumn("_next", F.lead("month").over(w)).filter("_new")
    kept = F.col("_next") == F.add_months("month", 1)
    out = marked.groupBy(F.add_months("month", 1).alias("month")).agg(
        F.count(F.lit(1)).alias("previous_new"), F.count_if(kept).alias("retained"))
    return out.withColumn("retention_rate", ratio(F.col("retained"), F.col("previous_new")))


def clean_user_list(users_df: DataFrame, id_column: str = "user_list_id") -> DataFrame:
    return users_df.withColumn("user_id", normalise_user_id(F.col(id_column))).drop(id_column)


def scope_user_list(users_df: DataFrame, view: str = "rollup") -> DataFrame:
    """Channel rules: a roll-up keeps WeChat only; WeChat needs a source country, Alipay does not."""
    alipay = F.coalesce(F.col("member_source").contains("支付宝"), F.lit(False))
    has_country = F.coalesce(F.trim("source_country"), F.lit("")) != ""
    keep = (~alipay & has_country) if view == "rollup" else (alipay | has_country)
    return users_df.filter(keep)


def conversion(users_df: DataFrame, df: DataFrame, start: date, end: date,
               view: str = "rollup") -> DataFrame:
    """New customers registered in the period and the share that bought in it."""
    day = F.to_date("register_time").between(F.lit(start), F.lit(end))
    new = scope_user_list(users_df, view).filter(day).select("user_id").distinct()
    buyers = (df.filter(F.to_date("order_time").between(F.lit(start), F.lit(end)))
              .select(F.col("user_id").alias("_buyer")).distinct())
    out = new.join(buyers, F.col("user_id") == F.col("_buyer"), "left").agg(
        F.count(F.lit(1)).alias("new_customers"), F.count("_buyer").alias("converted"))
    return out.withColumn("conversion_rate", ratio(F.col("converted"), F.col("new_customers")))


def conversion_by_month(users_df: DataFrame, df: DataFrame, view: str = "rollup") -> DataFrame:
    """The same for every registration month in one pass."""
    new = scope_user_list(users_df, view).select(
        "user_id", month(F.col("register_time")).alias("month")).distinct()
    buyers = df.filter("user_id IS NOT NULL").select(
        F.col("user_id").alias("_u"), month(F.col("order_time")).alias("_m")).distinct()
    joined = new.join(buyers, (F.col("user_id") == F.col("_u")) & (F.col("month") == F.col("_m")), "left")
    out = joined.groupBy("month").agg(F.count(F.lit(1)).alias("new_customers"),
                                      F.count("_u").alias("converted"))
    return out.withColumn("conversion_rate", ratio(F.col("converted"), F.col("new_customers")))


def match_rate(users_df: DataFrame, df: DataFrame) -> DataFrame:
    """Ordering users found in the user list."""
    buyers = b2c(df).select("user_id").distinct()
    listed = users_df.select(F.col("user_id").alias("_l")).distinct()
    out = buyers.join(listed, F.col("user_id") == F.col("_l"), "left").agg(
        F.count(F.lit(1)).alias("users"), F.count("_l").alias("matched"))
    return out.withColumn("match_rate", ratio(F.col("matched"), F.col("users")))


def order_frequency(df: DataFrame) -> DataFrame:
    rows = b2c(df)
    per = rows.groupBy("user_id").agg(orders(rows).alias("orders"))
    return per.groupBy("orders").agg(F.count(F.lit(1)).alias("users"))


def multi_order_share(df: DataFrame) -> DataFrame:
    out = order_frequency(df).agg(
        F.sum("users").alias("users"),
        F.sum(F.when(F.col("orders") >= 2, F.col("users")).otherwise(0)).alias("multi_users"))
    return out.withColumn("multi_order_share", ratio(F.col("multi_users"), F.col("users")))


def days_to_first_order(df: DataFrame) -> DataFrame:
    per = b2c(df).groupBy("user_id").agg(F.min("order_time").alias("first"),
                                         F.min("register_time").alias("registered"))
    days = F.datediff("first", "registered")
    return per.filter(days >= 0).groupBy(days.cast("bigint").alias("days")).agg(
        F.count(F.lit(1)).alias("users"))


def funnel_by_source(users_df: DataFrame, df: DataFrame) -> DataFrame:
    """Registered -> at least one order -> at least two orders, per source."""
    rows = b2c(df)
    per = rows.groupBy(F.col("user_id").alias("_u")).agg(orders(rows).alias("_n"))
    joined = users_df.join(per, F.col("user_id") == F.col("_u"), "left")
    return joined.groupBy("user_source").agg(
        F.count(F.lit(1)).alias("registered"), F.count_if(F.col("_n") >= 1).alias("ordered"),
        F.count_if(F.col("_n") >= 2).alias("repeated"))


def _cohort_cells(df: DataFrame) -> DataFrame:
    """user, month, revenue and cohort month; one row per user and month."""
    cells = b2c(df).groupBy("user_id", month(F.col("order_time")).alias("month")).agg(gmv().alias("gmv"))
    cohort = F.min("month").over(Window.partitionBy("user_id"))
    offset = F.months_between("month", "cohort").cast("int")
    return cells.withColumn("cohort", cohort).withColumn("offset", offset)


def cohort_retention(df: DataFrame) -> DataFrame:
    out = _cohort_cells(df).groupBy("cohort", "offset").agg(F.count(F.lit(1)).alias("active"))
    size = F.max(F.when(F.col("offset") == 0, F.col("active"))).over(Window.partitionBy("cohort"))
    return out.withColumn("cohort_size", size).withColumn(
        "retention", ratio(F.col("active"), F.col("cohort_size")))


def cohort_ltv(df: DataFrame, cohorts: int = 6) -> DataFrame:
    """Cumulative revenue per cohort member; the latest cohorts and the average of all."""
    cells = _cohort_cells(df).groupBy("cohort", "offset").agg(
        F.sum("gmv").alias("gmv"), F.count(F.lit(1)).alias("active"))
    by_cohort = Window.partitionBy("cohort").orderBy("offset")   # cohort months x offsets: small
    running = F.sum("gmv").over(by_cohort.rowsBetween(Window.unboundedPreceding, 0))
    size = F.max(F.when(F.col("offset") == 0, F.col("active"))).over(Window.partitionBy("cohort"))
    curves = stable(cells.withColumn("cohort_size", size).withColumn("ltv", running / size))
    mean = curves.groupBy("offset").agg(F.avg("ltv").alias("average_ltv"))
    recent = last_periods(curves.select("cohort", "offset", "cohort_size", "ltv"), "cohort", cohorts)
    return recent.join(mean, "offset")


def source_scorecard(df: DataFrame, window_days: int = config.LTV_WINDOW_DAYS) -> DataFrame:
    """Users, new users, revenue, coupon spend, early revenue and ROI per source."""
    rows = b2c(df)
    first = rows.groupBy(F.col("user_id").alias("_u")).agg(F.min("order_time").alias("_first"))
    joined = rows.join(first, F.col("user_id") == F.col("_u"), "left")
    early = F.col("order_time") < F.col("_first") + F.make_dt_interval(F.lit(window_days))
    out = joined.groupBy("user_source").agg(
        users().alias("users"), users(customer_type() == "New").alias("new_users"),
        gmv().alias("gmv"), gmv(column="coupon_amount").alias("coupon_spend"),
        gmv(early).alias("early_gmv"))
    return out.withColumn("roi", ratio(F.col("gmv"), F.col("coupon_spend")))


def ip_origin(df: DataFrame) -> DataFrame:
    rows = b2c(df).filter("ip_country IS NOT NULL")
    return rows.groupBy("ip_country").agg(orders(rows).alias("orders"), gmv().alias("gmv"))


def ip_failure_rate(df: DataFrame) -> DataFrame:
    """All statuses: share of non-successful orders per subdivision (needs the geo struct)."""
    from orderflux.functions.expressions import is_successful
    rows = b2c(df).filter("geo.subdivision IS NOT NULL")
    out = rows.groupBy(F.col("geo.country").alias("geo_country"),
                       F.col("geo.subdivision").alias("subdivision")).agg(
        orders(rows).alias("orders"), orders(rows, ~is_successful()).alias("failed"))
    return out.withColumn("failure_rate", ratio(F.col("failed"), F.col("orders")))


# --- promotions (B2C) ------------------------------------------------------

def promotion_kpis(df: DataFrame) -> DataFrame:
    rows = b2c(df)
    used, promo = F.col("coupon_used"), F.col("new_user_promo")
    out = rows.agg(orders(rows).alias("orders"), orders(rows, used).alias("coupon_orders"),
                   gmv(column="coupon_amount").alias("coupon_spend"), gmv(used).alias("coupon_gmv"),
                   orders(rows, promo).alias("promo_orders"))
    return out.withColumn("usage_rate", ratio(F.col("coupon_orders"), F.col("orders")))


def coupon_monthly(df: DataFrame) -> DataFrame:
    rows = b2c(df)
    return rows.groupBy(month(F.col("order_time")).alias("month")).agg(
        gmv(column="coupon_amount").alias("coupon_spend"), gmv(F.col("coupon_used")).alias("coupon_gmv"))


def new_user_promo_trend(df: DataFrame) -> DataFrame:
    rows = b2c(df)
    out = rows.groupBy(month(F.col("order_time")).alias("month")).agg(
        orders(rows).alias("orders"), orders(rows, F.col("new_user_promo")).alias("promo_orders"))
    return out.withColumn("promo_share", ratio(F.col("promo_orders"), F.col("orders")))


def campaign_table(df: DataFrame, limit: int | None = None) -> DataFrame:
    rows = b2c(df).filter("coupon_name IS NOT NULL")
    out = rows.groupBy("coupon_name").agg(
        orders(rows).alias("orders"), gmv(column="coupon_amount").alias("coupon_spend"),
        gmv().alias("gmv"), F.avg("coupon_amount").alias("avg_discount"))
    out = out.withColumn("gmv_per_spend", ratio(F.col("gmv"), F.col("coupon_spend")))
    return top(out, "gmv", "coupon_name", limit) if limit else out


def coupon_vs_others(df: DataFrame) -> DataFrame:
    """Users with any coupon order against the rest: AOV and share with two orders or more."""
    rows = b2c(df)
    per = rows.groupBy("user_id").agg(F.max("coupon_used").alias("coupon_user"),
                                      orders(rows).alias("n"), gmv().alias("s"))
    out = per.groupBy(F.col("coupon_user").cast("int").alias("coupon_user")).agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("orders"), F.sum("s").alias("gmv"),
        F.count_if(F.col("n") >= 2).alias("repeaters"))
    return (out.withColumn("aov", ratio(F.col("gmv"), F.col("orders")))
            .withColumn("repeat_share", ratio(F.col("repeaters"), F.col("users"))))


def featured_products(df: DataFrame) -> DataFrame:
    rows = b2c(df)
    out = rows.groupBy(F.col("badge_product").cast("int").alias("featured")).agg(
        orders(rows).alias("orders"), gmv().alias("gmv"),
        F.count_distinct("product").alias("products"))
    return out.withColumn("aov", ratio(F.col("gmv"), F.col("orders")))
