"""Customer, cohort and promotion queries."""

from __future__ import annotations

from datetime import date

from functools import reduce

from pyspark.sql import functions as F

from orderflux.catalog.base import register
from orderflux.functions.dimensions import local_table
from orderflux.operators.geo import locate_ips
from orderflux.plans import bitmaps as B
from orderflux.plans import customers as C
from orderflux.session import stable
from orderflux.sources.orders import orders_fact, successful, table, user_list

B2C = "(SELECT * FROM ok WHERE segment = 'B2C')"
_TYPE = """CASE WHEN date_trunc('month', register_time) = date_trunc('month', order_time) THEN 'New'
  WHEN date_trunc('month', register_time) < date_trunc('month', order_time) THEN 'Returning'
  ELSE 'Unknown' END"""


@register("G27_beneficiary_histogram", """
SELECT n AS top_ups, count(*) AS numbers FROM (SELECT recharge_number, count(*) AS n FROM ok GROUP BY 1)
GROUP BY 1
""")
def g27(spark, d):
    return C.beneficiary_histogram(successful(spark, d, "order_id", "recharge_number"))


@register("G27_beneficiary_kpis", f"""
WITH u AS (SELECT user_id, count(DISTINCT recharge_number) AS n FROM {B2C} GROUP BY 1)
SELECT count(*) AS users, count(*) FILTER (n >= 4) AS resellers,
  (SELECT count(DISTINCT recharge_number) FROM ok) AS unique_numbers FROM u
""")
def g27k(spark, d):
    return C.beneficiary_kpis(successful(spark, d, "segment", "user_id", "recharge_number"))


@register("G28_W6_agent_performance", """
WITH t AS (SELECT agent_name, sum(sales) AS gmv, count(*) AS orders FROM ok
           WHERE agent_name IS NOT NULL GROUP BY 1)
SELECT agent_name, gmv, orders, gmv / orders AS aov, rank() OVER (ORDER BY gmv DESC) AS rank,
  gmv / (SELECT sum(gmv) FROM t) AS share,
  sum(gmv) OVER (ORDER BY gmv DESC) / (SELECT sum(gmv) FROM t) AS cumulative_share FROM t
""", "gmv:2 aov:6 share:8 cumulative_share:8")
def g28(spark, d):
    return C.agent_performance(successful(spark, d, "order_id", "sales", "segment", "agent_name"))


@register("G28_L1_top_agents", """
WITH t AS (SELECT agent_name, sum(sales) AS gmv, count(*) AS orders FROM ok
           WHERE agent_name IS NOT NULL GROUP BY 1)
SELECT agent_name, gmv, orders, gmv / orders AS aov, rank() OVER (ORDER BY gmv DESC) AS rank,
  gmv / (SELECT sum(gmv) FROM t) AS share,
  sum(gmv) OVER (ORDER BY gmv DESC) / (SELECT sum(gmv) FROM t) AS cumulative_share FROM t
ORDER BY gmv DESC, agent_name LIMIT 20
""", "gmv:2 aov:6 share:8 cumulative_share:8")
def g28t(spark, d):
    return C.agent_performance(successful(spark, d, "order_id", "sales", "segment", "agent_name"), 20)


@register("G28_agent_kpis", """
SELECT count(DISTINCT agent_name) AS agents, sum(sales) AS gmv, count(*) AS orders,
  sum(sales) / count(DISTINCT agent_name) AS gmv_per_agent FROM ok WHERE agent_name IS NOT NULL
""", "gmv:2 gmv_per_agent:6")
def g28k(spark, d):
    return C.agent_kpis(successful(spark, d, "order_id", "sales", "segment", "agent_name"))


@register("G29_customer_averages", f"""
WITH u AS (SELECT region, user_id, count(*) AS n, sum(sales) AS s FROM {B2C} GROUP BY 1, 2)
SELECT region, count(*) AS users, CAST(sum(n) AS BIGINT) AS orders, sum(s) AS gmv,
  avg(n) AS orders_per_user, avg(s) AS gmv_per_user FROM u GROUP BY 1
""", "gmv:2 orders_per_user:6 gmv_per_user:6")
def g29(spark, d):
    return C.customer_averages(successful(spark, d, "order_id", "sales", "segment", "user_id", "region"),
                               "region")


@register("G30_new_vs_returning", f"""
SELECT strftime(mon, '%Y-%m-%d') AS month, {_TYPE} AS customer_type, count(DISTINCT user_id) AS users,
  count(*) AS orders, sum(sales) AS gmv FROM {B2C} GROUP BY 1, 2
""", "gmv:2")
def g30(spark, d):
    return C.new_vs_returning(successful(spark, d, "order_id", "sales", "segment", "user_id", "order_time",
                                         "register_time"))


@register("G31_acquisition", f"""
SELECT strftime(m, '%Y-%m-%d') AS month, count(*) AS users
FROM (SELECT user_id, min(mon) AS m FROM {B2C} GROUP BY 1) GROUP BY 1
""")
def g31(spark, d):
    return C.acquisition(successful(spark, d, "segment", "user_id", "order_time"))


@register("G32_U2_repurchase_rate", f"""
WITH um AS (SELECT DISTINCT user_id, mon FROM {B2C})
SELECT strftime(a.mon, '%Y-%m-%d') AS month, count(*) AS users, count(b.user_id) AS repeat_users,
  count(b.user_id) / count(*) AS repurchase_rate
FROM um a LEFT JOIN um b ON a.user_id = b.user_id AND b.mon = a.mon - INTERVAL 1 MONTH GROUP BY 1
""", "repurchase_rate:8")
def g32(spark, d):
    return C.repurchase_rate(successful(spark, d, "segment", "user_id", "order_time"))


def _bitmaps(df):
    """Bitmaps of a fact's users by market and day, stored once for all roll-ups."""
    return stable(B.user_bitmaps(df, B.user_numbers(df), "country"))


@register("G1_users_of_any_roll_up", """
WITH known AS (SELECT * FROM ok WHERE user_id IS NOT NULL)
SELECT 'day' AS grain, strftime(order_time, '%Y-%m-%d') AS period, count(DISTINCT user_id) AS users FROM known GROUP BY ALL
UNION ALL SELECT 'week', strftime(date_trunc('week', order_time), '%Y-%m-%d'), count(DISTINCT user_id) FROM known GROUP BY ALL
UNION ALL SELECT 'month', strftime(date_trunc('month', order_time), '%Y-%m-%d'), count(DISTINCT user_id) FROM known GROUP BY ALL
UNION ALL SELECT 'market', country, count(DISTINCT user_id) FROM known GROUP BY ALL
UNION ALL SELECT 'all', '', count(DISTINCT user_id) FROM known
""")
def g1_users(spark, d):
    """Distinct users by day, week, month, market and overall, from one table of bitmaps."""
    bits = _bitmaps(successful(spark, d, "user_id", "order_time", "country"))
    parts = [B.distinct_users(bits, grain=g).select(F.lit(g).alias("grain"), F.col("period").cast("string").alias("period"), "users")
             for g in ("day", "week", "month")]
    parts += [B.distinct_users(bits, "country").select(F.lit("market"), "country", "users"),
              B.distinct_users(bits).select(F.lit("all"), F.lit(""), "users")]
    return reduce(lambda a, b: a.union(b), parts)


@register("G32_repurchase_from_bitmaps", f"""
WITH um AS (SELECT DISTINCT user_id, country, mon FROM {B2C} WHERE user_id IS NOT NULL)
SELECT a.country, strftime(a.mon, '%Y-%m-%d') AS month, count(*) AS users, count(b.user_id) AS repeat_users,
  count(b.user_id) / count(*) AS repurchase_rate
FROM um a LEFT JOIN um b ON a.user_id = b.user_id AND b.country = a.country AND b.mon = a.mon - INTERVAL 1 MONTH GROUP BY 1, 2
""", "repurchase_rate:8")
def g32_bits(spark, d):
    """Repurchase per market as intersections of months."""
    rows = successful(spark, d, "segment", "user_id", "order_time", "country").filter("segment = 'B2C' AND country IS NOT NULL")
    return B.returning_users(_bitmaps(rows), "country")


@register("G33_retention_rate", f"""
WITH um AS (SELECT DISTINCT user_id, mon FROM {B2C}),
  nw AS (SELECT DISTINCT user_id, mon FROM {B2C} WHERE {_TYPE} = 'New')
SELECT strftime(nw.mon + INTERVAL 1 MONTH, '%Y-%m-%d') AS month, count(*) AS previous_new,
  count(um.user_id) AS retained, count(um.user_id) / count(*) AS retention_rate
FROM nw LEFT JOIN um ON um.user_id = nw.user_id AND um.mon = nw.mon + INTERVAL 1 MONTH GROUP BY 1
""", "retention_rate:8")
def g33(spark, d):
    return C.retention_rate(successful(spark, d, "segment", "user_id", "order_time", "register_time"))


_SCOPE = "member_source NOT LIKE '%支付宝%' AND coalesce(trim(source_country), '') <> ''"


@register("G34_S9_conversion", f"""
WITH n AS (SELECT DISTINCT user_id FROM userlist WHERE {_SCOPE}
             AND CAST(register_time AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'),
  b AS (SELECT DISTINCT user_id FROM ok WHERE day BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'
        AND user_id IS NOT NULL)
SELECT count(*) AS new_customers, count(b.user_id) AS converted, count(b.user_id) / count(*) AS conversion_rate
FROM n LEFT JOIN b USING (user_id)
""", "conversion_rate:8")
def g34(spark, d):
    return C.conversion(C.clean_user_list(user_list(spark, d)),
                        successful(spark, d, "user_id", "order_time"),
                        date(1995, 3, 1), date(1995, 6, 30))


@register("G34_conversion_by_month", f"""
WITH n AS (SELECT DISTINCT user_id, date_trunc('month', register_time) AS m FROM userlist WHERE {_SCOPE}),
  b AS (SELECT DISTINCT user_id, CAST(mon AS TIMESTAMP) AS m FROM ok WHERE user_id IS NOT NULL)
SELECT strftime(n.m, '%Y-%m-%d') AS month, count(*) AS new_customers, count(b.user_id) AS converted,
  count(b.user_id) / count(*) AS conversion_rate
FROM n LEFT JOIN b ON b.user_id = n.user_id AND b.m = n.m GROUP BY 1
""", "conversion_rate:8")
def g34m(spark, d):
    return C.conversion_by_month(C.clean_user_list(user_list(spark, d)),
                                 successful(spark, d, "user_id", "order_time"))


@register("J9_user_list_match", f"""
WITH b AS (SELECT DISTINCT user_id FROM {B2C}), l AS (SELECT DISTINCT user_id FROM userlist)
SELECT count(*) AS users, count(l.user_id) AS matched, count(l.user_id) / count(*) AS match_rate
FROM b LEFT JOIN l USING (user_id)
""", "match_rate:8")
def j9(spark, d):
    return C.match_rate(C.clean_user_list(user_list(spark, d)),
                        successful(spark, d, "segment", "user_id"))


@register("G35_order_frequency", f"""
SELECT n AS orders, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM {B2C} GROUP BY 1) GROUP BY 1
""")
def g35(spark, d):
    return C.order_frequency(successful(spark, d, "order_id", "segment", "user_id"))


@register("G35_multi_order_share", f"""
WITH u AS (SELECT user_id, count(*) AS n FROM {B2C} GROUP BY 1)
SELECT count(*) AS users, count(*) FILTER (n >= 2) AS multi_users,
  count(*) FILTER (n >= 2) / count(*) AS multi_order_share FROM u
""", "multi_order_share:8")
def g35s(spark, d):
    return C.multi_order_share(successful(spark, d, "order_id", "segment", "user_id"))


@register("G36_days_to_first_order", f"""
WITH u AS (SELECT user_id, datediff('day', CAST(min(register_time) AS DATE), CAST(min(order_time) AS DATE)) AS n
           FROM {B2C} GROUP BY 1)
SELECT n AS days, count(*) AS users FROM u WHERE n >= 0 GROUP BY 1
""")
def g36(spark, d):
    return C.days_to_first_order(successful(spark, d, "segment", "user_id", "order_time", "register_time"))


@register("G36_funnel_by_source", f"""
WITH u AS (SELECT user_id, count(*) AS n FROM {B2C} GROUP BY 1)
SELECT user_source, count(*) AS registered, count(*) FILTER (n >= 1) AS ordered,
  count(*) FILTER (n >= 2) AS repeated FROM userlist LEFT JOIN u USING (user_id) GROUP BY 1
""")
def g36f(spark, d):
    return C.funnel_by_source(C.clean_user_list(user_list(spark, d)),
                              successful(spark, d, "order_id", "segment", "user_id"))


_COHORT = f"""um AS (SELECT user_id, mon, sum(sales) AS gmv FROM {B2C} GROUP BY 1, 2),
  co AS (SELECT *, min(mon) OVER (PARTITION BY user_id) AS c FROM um),
  cells AS (SELECT c, datediff('month', c, mon) AS o, count(*) AS active, sum(gmv) AS gmv FROM co GROUP BY 1, 2),
  sz AS (SELECT *, max(CASE WHEN o = 0 THEN active END) OVER (PARTITION BY c) AS size FROM cells)"""


@register("G37_cohort_retention", f"""
WITH {_COHORT} SELECT strftime(c, '%Y-%m-%d') AS cohort, o AS "offset", active, size AS cohort_size,
  active / size AS retention FROM sz
""", "retention:8")
def g37(spark, d):
    return C.cohort_retention(successful(spark, d, "sales", "segment", "user_id", "order_time"))


@register("W7_cohort_ltv", f"""
WITH {_COHORT}, l AS (SELECT c, o, size, sum(gmv) OVER (PARTITION BY c ORDER BY o) / size AS ltv FROM sz),
  m AS (SELECT o, avg(ltv) AS average_ltv FROM l GROUP BY 1)
SELECT strftime(c, '%Y-%m-%d') AS cohort, l.o AS "offset", size AS cohort_size, ltv, average_ltv
FROM l JOIN m ON m.o = l.o WHERE c IN (SELECT DISTINCT c FROM l ORDER BY 1 DESC LIMIT 6)
""", "ltv:4 average_ltv:4")
def w7(spark, d):
    return C.cohort_ltv(successful(spark, d, "sales", "segment", "user_id", "order_time"))


@register("G38_source_scorecard", f"""
WITH f AS (SELECT user_id AS u, min(order_time) AS ft FROM {B2C} GROUP BY 1)
SELECT user_source, count(DISTINCT user_id) AS users,
  count(DISTINCT CASE WHEN {_TYPE} = 'New' THEN user_id END) AS new_users, sum(sales) AS gmv,
  sum(coupon_amount) AS coupon_spend,
  sum(CASE WHEN order_time < ft + INTERVAL 90 DAY THEN sales ELSE 0 END) AS early_gmv,
  sum(sales) / sum(coupon_amount) AS roi
FROM {B2C} b JOIN f ON f.u = b.user_id GROUP BY 1
""", "gmv:2 coupon_spend:2 early_gmv:2 roi:6")
def g38(spark, d):
    return C.source_scorecard(successful(spark, d, "sales", "segment", "user_id", "order_time",
                                         "register_time", "coupon_amount", "user_source"))


@register("G39_ip_origin", f"""
SELECT ip_country, count(*) AS orders, sum(sales) AS gmv FROM {B2C} WHERE ip_country IS NOT NULL GROUP BY 1
""", "gmv:2")
def g39(spark, d):
    return C.ip_origin(successful(spark, d, "order_id", "sales", "segment", "user_id", "ip_country"))


@register("G39_J5_ip_failure_rate", """
WITH g AS (SELECT *, CAST(split_part(ip_address, '.', 2) AS INTEGER) AS o2,
    CAST(split_part(ip_address, '.', 3) AS INTEGER) AS o3 FROM fact WHERE segment = 'B2C')
SELECT CASE WHEN o3 < 8 THEN 'Country ' || (o2 + 10) ELSE 'Country ' || o2 END AS geo_country,
  CASE WHEN o3 < 8 THEN 'Sub ' || o2 || '-' || o3 ELSE 'Sub ' || o2 END AS subdivision,
  count(*) AS orders, count(*) FILTER (status_group <> 'Successful') AS failed,
  count(*) FILTER (status_group <> 'Successful') / count(*) AS failure_rate
FROM g WHERE o2 < 3 GROUP BY 1, 2
""", "failure_rate:8")
def g39f(spark, d):
    df = orders_fact(spark, d, "order_id", "segment", "user_id", "ip_address")
    return C.ip_failure_rate(locate_ips(df, ip_ranges(spark, d)))


def ip_ranges(spark, d):
    """Ranges derived from the nation table: three /16 blocks and eight nested /24 in each."""
    from orderflux.sources.orders import table
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    base = F.lit(10).cast("bigint") * 16777216
    wide = n.filter("k < 3").select(
        (base + F.col("k") * 65536).alias("start_ip"), (base + F.col("k") * 65536 + 65535).alias("end_ip"),
        F.lit(16).alias("prefix"), F.lit(None).cast("string").alias("iso2"),
        F.concat(F.lit("Country "), "k").alias("country"), F.concat(F.lit("Sub "), "k").alias("subdivision"),
        F.lit(None).cast("string").alias("city"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"))
    nested = n.filter("k < 24").withColumn("b", F.floor(F.col("k") / 8)).withColumn("s", F.col("k") % 8)
    start = base + F.col("b") * 65536 + F.col("s") * 256
    narrow = nested.select(
        start.alias("start_ip"), (start + 255).alias("end_ip"), F.lit(24).alias("prefix"),
        F.lit(None).cast("string").alias("iso2"),
        F.concat(F.lit("Country "), (F.col("b") + 10).cast("string")).alias("country"),
        F.concat(F.lit("Sub "), "b", F.lit("-"), "s").alias("subdivision"),
        F.lit(None).cast("string").alias("city"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"))
    return wide.unionByName(narrow)


@register("J5_mixed_versions", """
WITH a AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'narrow' WHEN 1 THEN 'wide' WHEN 2 THEN 'dotted' END AS place FROM customer)
SELECT k AS custkey, CASE WHEN k % 10 < 9 THEN place END AS subdivision FROM a
""")
def j5_mixed(spark, d):
    """Addresses of both versions, some of them unreadable, against networks of both."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    k = F.col("custkey")
    digits = F.lower(F.hex(k % 4096))
    ip = (F.when(k % 10 == 9, F.when(k % 20 == 9, "2001:db8:::1")).when(k % 4 == 0, F.concat(F.lit("2001:DB8:1:2::"), digits))
          .when(k % 4 == 1, F.concat(F.lit("2001:db8:ffff:0:0:0:0:"), digits))
          .when(k % 4 == 2, F.concat(F.lit("10.1."), (k % 256).cast("string"), F.lit(".7"))).otherwise(
              F.concat(F.lit("fe80::"), digits)))
    rows = [("2001:db8::/32", "wide"), ("2001:db8:1:2::/64", "narrow"), ("2001:db8:1:2::/120", "narrow"), ("10.0.0.0/8", "dotted"),
            ("not a network", "x"), ("10.2.0.0/16", "other")]
    ranges = local_table(spark, "network string, subdivision string", rows).select(
        "network", F.lit("AA").alias("iso2"), F.lit("A").alias("country"), "subdivision", F.lit(None).cast("string").alias("city"),
        F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    return locate_ips(c.withColumn("ip_address", ip), ranges).select("custkey", F.col("geo.subdivision").alias("subdivision"))


@register("J5_ip_lookup", """
WITH g AS (SELECT order_id, CAST(split_part(ip_address, '.', 2) AS INTEGER) AS o2,
    CAST(split_part(ip_address, '.', 3) AS INTEGER) AS o3 FROM fact)
SELECT order_id, CASE WHEN o2 < 3 THEN CASE WHEN o3 < 8 THEN 'Country ' || (o2 + 10)
    ELSE 'Country ' || o2 END END AS geo_country,
  CASE WHEN o2 < 3 THEN CASE WHEN o3 < 8 THEN 'Sub ' || o2 || '-' || o3 ELSE 'Sub ' || o2 END END
    AS subdivision FROM g
""")
def j5(spark, d):
    df = locate_ips(orders_fact(spark, d, "order_id", "ip_address"), ip_ranges(spark, d))
    return df.select("order_id", F.col("geo.country").alias("geo_country"), "geo.subdivision")


@register("G40_promotion_kpis", f"""
SELECT count(*) AS orders, count(*) FILTER (coupon_used) AS coupon_orders, sum(coupon_amount) AS coupon_spend,
  sum(sales) FILTER (coupon_used) AS coupon_gmv, count(*) FILTER (new_user_promo) AS promo_orders,
  count(*) FILTER (coupon_used) / count(*) AS usage_rate FROM {B2C}
""", "coupon_spend:2 coupon_gmv:2 usage_rate:8")
def g40(spark, d):
    return C.promotion_kpis(successful(spark, d, "order_id", "sales", "segment", "user_id", "coupon_used",
                                       "coupon_amount", "new_user_promo"))


@register("G41_coupon_monthly", f"""
SELECT strftime(mon, '%Y-%m-%d') AS month, sum(coupon_amount) AS coupon_spend,
  coalesce(sum(sales) FILTER (coupon_used), 0) AS coupon_gmv FROM {B2C} GROUP BY 1
""", "coupon_spend:2 coupon_gmv:2")
def g41(spark, d):
    return C.coupon_monthly(successful(spark, d, "sales", "segment", "user_id", "coupon_used",
                                       "coupon_amount", "order_time"))


@register("G41_new_user_promo_trend", f"""
SELECT strftime(mon, '%Y-%m-%d') AS month, count(*) AS orders,
  count(*) FILTER (new_user_promo) AS promo_orders,
  count(*) FILTER (new_user_promo) / count(*) AS promo_share FROM {B2C} GROUP BY 1
""", "promo_share:8")
def g41p(spark, d):
    return C.new_user_promo_trend(successful(spark, d, "order_id", "segment", "user_id", "new_user_promo",
                                             "order_time"))


@register("G42_campaign_table", f"""
SELECT coupon_name, count(*) AS orders, sum(coupon_amount) AS coupon_spend, sum(sales) AS gmv,
  avg(coupon_amount) AS avg_discount, sum(sales) / sum(coupon_amount) AS gmv_per_spend
FROM {B2C} WHERE coupon_name IS NOT NULL GROUP BY 1
""", "coupon_spend:2 gmv:2 avg_discount:6 gmv_per_spend:6")
def g42(spark, d):
    return C.campaign_table(successful(spark, d, "order_id", "sales", "segment", "user_id", "coupon_name",
                                       "coupon_amount"))


@register("G43_coupon_vs_others", f"""
WITH u AS (SELECT user_id, max(CASE WHEN coupon_used THEN 1 ELSE 0 END) AS c, count(*) AS n, sum(sales) AS s
           FROM {B2C} GROUP BY 1)
SELECT CAST(c AS BIGINT) AS coupon_user, count(*) AS users, CAST(sum(n) AS BIGINT) AS orders, sum(s) AS gmv,
  count(*) FILTER (n >= 2) AS repeaters, sum(s) / sum(n) AS aov,
  count(*) FILTER (n >= 2) / count(*) AS repeat_share FROM u GROUP BY 1
""", "gmv:2 aov:6 repeat_share:8")
def g43(spark, d):
    return C.coupon_vs_others(successful(spark, d, "order_id", "sales", "segment", "user_id",
                                         "coupon_used"))


@register("G44_featured_products", f"""
SELECT CASE WHEN badge_product THEN 1 ELSE 0 END::BIGINT AS featured, count(*) AS orders, sum(sales) AS gmv,
  count(DISTINCT product) AS products, sum(sales) / count(*) AS aov FROM {B2C} GROUP BY 1
""", "gmv:2 aov:6")
def g44(spark, d):
    return C.featured_products(successful(spark, d, "order_id", "sales", "segment", "user_id", "product",
                                          "badge_product"))
