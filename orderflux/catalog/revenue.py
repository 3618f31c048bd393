"""Revenue, quality, market, product and supplier queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from orderflux.catalog.base import costed, register
from orderflux.operators.filters import exclude_markets
from orderflux.plans import products as P
from orderflux.plans import revenue as R
from orderflux.sources.orders import orders_fact, successful, table

NOW, BEFORE = (date(2000, 1, 1), date(2000, 12, 31)), (date(1999, 1, 1), date(1999, 12, 31))


@register("G1_kpi_set", """
SELECT sum(sales) AS gmv, count(DISTINCT order_id) AS orders, count(DISTINCT user_id) AS users,
       count(DISTINCT country) AS markets, sum(sales) / count(DISTINCT order_id) AS aov FROM ok
""", "gmv:2 aov:6")
def g1(spark, d):
    return R.kpi_set(successful(spark, d, "order_id", "sales", "user_id", "country"))


@register("G1_orders_of_repeated_fact", """
SELECT segment, count(DISTINCT order_id) AS orders, 2 * count(*) AS rows FROM fact GROUP BY 1
""")
def g1_repeated(spark, d):
    """Order counts stay distinct when rows are repeated after publication, here by a union and by a join."""
    from orderflux.functions.measures import orders
    f = orders_fact(spark, d, "order_id", "segment")
    twice, again = f.union(f), f.join(f.select("segment").distinct().crossJoin(spark.range(2)), "segment")
    joined = again.groupBy("segment").agg(orders(again).alias("joined"))
    return twice.groupBy("segment").agg(orders(twice).alias("orders"), F.count(F.lit(1)).alias("rows")).join(
        joined, "segment").where("joined = orders").drop("joined")


@register("G1_W12_kpis_by_market_month", """
WITH t AS (SELECT country, mon, sum(sales) AS gmv, count(DISTINCT order_id) AS orders,
             count(DISTINCT user_id) AS users FROM ok GROUP BY 1, 2)
SELECT country, strftime(mon, '%Y-%m-%d') AS month, gmv, orders, users, gmv / orders AS aov,
       gmv / sum(gmv) OVER (PARTITION BY mon) AS share FROM t
""", "gmv:2 aov:6 share:8")
def g1_market_month(spark, d):
    from pyspark.sql import Window
    from orderflux.functions.expressions import month, ratio
    from orderflux.functions.measures import gmv, orders, users
    df = successful(spark, d, "order_id", "sales", "user_id", "country", "order_time")
    out = df.groupBy("country", month(F.col("order_time")).alias("month")).agg(
        gmv().alias("gmv"), orders(df).alias("orders"), users().alias("users"))
    total = F.sum("gmv").over(Window.partitionBy("month"))      # one row per country
    return (out.withColumn("aov", ratio(F.col("gmv"), F.col("orders")))
            .withColumn("share", ratio(F.col("gmv"), total)))


@register("G2_gross_margin_by_segment", """
SELECT segment, sum(sales) AS gmv, sum(settlement_rmb) AS cost,
       sum(sales) - sum(settlement_rmb) AS margin,
       (sum(sales) - sum(settlement_rmb)) / sum(sales) AS margin_pct FROM okcost GROUP BY segment
""", "gmv:2 cost:2 margin:2 margin_pct:8")
def g2(spark, d):
    return R.margin(costed(spark, d, "sales", "segment"), "segment")


@register("G3_net_contribution", """
WITH t AS (
  SELECT sum(CASE WHEN status_group IN ('Successful', 'Refunded') THEN sales ELSE 0 END) AS gmv,
    sum(CASE WHEN status_group = 'Refunded' THEN sales ELSE 0 END) AS refunds,
    sum(CASE WHEN status_group = 'Successful' THEN coupon_amount ELSE 0 END) AS coupon_spend,
    sum(CASE WHEN status_group = 'Successful' THEN settlement_rmb ELSE 0 END) AS cogs FROM cost)
SELECT *, gmv - refunds - coupon_spend - cogs AS net_contribution FROM t
""", "gmv:2 refunds:2 coupon_spend:2 cogs:1 net_contribution:1")
def g3(spark, d):
    return R.net_contribution(costed(spark, d, "sales", "coupon_amount", every_status=True))


@register("G4_status_kpis", """
WITH t AS (SELECT count(*) AS orders, count(*) FILTER (status_group = 'Successful') AS successful,
    count(*) FILTER (status_group = 'Refunded') AS refunded,
    count(*) FILTER (status_group = 'Cancelled') AS cancelled,
    count(*) FILTER (status_group = 'Pending') AS pending,
    sum(CASE WHEN status_group = 'Refunded' THEN sales ELSE 0 END) AS refunded_gmv FROM fact)
SELECT *, successful / orders AS success_rate, refunded / orders AS refund_rate,
  cancelled / orders AS cancel_rate, pending / orders AS pending_rate FROM t
""", "refunded_gmv:2 success_rate:8 refund_rate:8 cancel_rate:8 pending_rate:8")
def g4(spark, d):
    return R.status_kpis(orders_fact(spark, d, "order_id", "sales"))


@register("G5_orders_by_status_segment", """
SELECT status_group, segment, count(DISTINCT order_id) AS orders FROM fact GROUP BY 1, 2
""")
def g5(spark, d):
    return R.orders_by_status_segment(orders_fact(spark, d, "order_id", "segment"))


@register("G5_status_segment_pivot", """
SELECT status_group, count(*) FILTER (segment = 'B2B') AS b2b_orders,
       count(*) FILTER (segment = 'B2C') AS b2c_orders FROM fact GROUP BY 1
""")
def g5p(spark, d):
    return R.status_by_segment_pivot(orders_fact(spark, d, "order_id", "segment"))


@register("G6_monthly_refund_rate", """
SELECT strftime(mon, '%Y-%m-%d') AS month, segment, count(*) AS orders,
  count(*) FILTER (status_group = 'Refunded') AS refunded,
  count(*) FILTER (status_group = 'Refunded') / count(*) AS refund_rate FROM fact GROUP BY 1, 2
""", "refund_rate:8")
def g6(spark, d):
    return R.monthly_refund_rate(orders_fact(spark, d, "order_id", "segment", "order_time"))


@register("G7_refund_rate_by_operator", """
SELECT operator, count(*) AS orders, count(*) FILTER (status_group = 'Refunded') AS refunded,
  count(*) FILTER (status_group = 'Refunded') / count(*) AS refund_rate
FROM fact WHERE operator IS NOT NULL GROUP BY 1 HAVING count(*) >= 200
ORDER BY refund_rate DESC, operator LIMIT 10
""", "refund_rate:8")
def g7(spark, d):
    return R.refund_rate_by_operator(orders_fact(spark, d, "order_id", "operator"))


for _grain, _unit in (("D", "day"), ("W", "week"), ("M", "month"), ("Q", "quarter"), ("Y", "year")):
    @register(f"G8_trend_{_unit}", f"""
    SELECT strftime(date_trunc('{_unit}', order_time), '%Y-%m-%d') AS period, sum(sales) AS gmv,
           count(DISTINCT order_id) AS orders FROM ok GROUP BY 1
    """, "gmv:2")
    def g8(spark, d, grain=_grain):
        return R.trend(successful(spark, d, "order_id", "sales", "order_time"), grain)


for _dim, _bounded in (("segment", True), ("region", True), ("product_category", False)):
    @register(f"G9_mix_by_{_dim}", f"""
    SELECT {_dim}, sum(sales) AS gmv, sum(sales) / (SELECT sum(sales) FROM ok) AS share
    FROM ok GROUP BY 1
    """, "gmv:2 share:8")
    def g9(spark, d, dim=_dim, bounded=_bounded):
        return R.mix(successful(spark, d, "sales", dim), dim, bounded)


@register("G10_segment_summary", """
SELECT segment, sum(sales) AS gmv, count(DISTINCT order_id) AS orders, count(DISTINCT user_id) AS users,
  sum(sales) / count(DISTINCT order_id) AS aov, sum(sales) / (SELECT sum(sales) FROM ok) AS share
FROM ok GROUP BY 1
""", "gmv:2 aov:6 share:8")
def g10(spark, d):
    return R.segment_summary(successful(spark, d, "order_id", "sales", "user_id", "segment"))


@register("G11_market_table", """
SELECT country, segment, sum(sales) AS gmv, count(DISTINCT order_id) AS orders,
  count(DISTINCT user_id) AS users, avg(CAST(denomination AS DOUBLE)) AS avg_denomination,
  sum(sales) / count(DISTINCT order_id) AS aov, sum(sales) / (SELECT sum(sales) FROM ok) AS share
FROM ok GROUP BY 1, 2
""", "gmv:2 avg_denomination:6 aov:6 share:8")
def g11(spark, d):
    return R.market_table(successful(spark, d, "order_id", "sales", "user_id", "country", "segment",
                                     "denomination"), "segment")


@register("G12_market_month_heatmap", """
SELECT country, strftime(mon, '%Y-%m-%d') AS month, sum(sales) AS gmv FROM ok
WHERE country IN (SELECT country FROM ok WHERE country IS NOT NULL GROUP BY 1
                  ORDER BY sum(sales) DESC, country LIMIT 15) GROUP BY 1, 2
""", "gmv:2")
def g12(spark, d):
    return R.market_month_heatmap(successful(spark, d, "sales", "country", "order_time"))


@register("G13_weekday_hour", """
SELECT isodow(order_time) - 1 AS weekday, hour(order_time) AS hour, count(DISTINCT order_id) AS orders
FROM ok GROUP BY 1, 2
""")
def g13(spark, d):
    return R.weekday_hour(successful(spark, d, "order_id", "order_time"))


@register("G14_ops_kpis", """
WITH dd AS (SELECT day, sum(sales) AS g, count(*) AS n FROM ok GROUP BY 1),
     hh AS (SELECT hour(order_time) AS h, count(*) AS n FROM ok GROUP BY 1)
SELECT avg(g) AS avg_daily_gmv, avg(n) AS avg_daily_orders,
  (SELECT strftime(day, '%Y-%m-%d') FROM dd ORDER BY round(g, 2) DESC, day LIMIT 1) AS peak_day,
  (SELECT h FROM hh ORDER BY n DESC, h LIMIT 1) AS peak_hour FROM dd
""", "avg_daily_gmv:4 avg_daily_orders:6")
def g14(spark, d):
    return R.ops_kpis(successful(spark, d, "order_id", "sales", "order_time"))


@register("G15_operator_scorecard", """
WITH t AS (
  SELECT operator, sum(CASE WHEN y = 2000 THEN sales ELSE 0 END) AS gmv,
    count(*) FILTER (y = 2000) AS orders, sum(CASE WHEN y = 2000 THEN settlement_rmb ELSE 0 END) AS cost,
    sum(CASE WHEN y = 1999 THEN sales ELSE 0 END) AS previous_gmv
  FROM (SELECT *, year(order_time) AS y FROM okcost)
  WHERE y IN (1999, 2000) AND operator IS NOT NULL GROUP BY 1)
SELECT *, gmv / nullif(orders, 0) AS aov, gmv - cost AS margin, (gmv - cost) / nullif(gmv, 0) AS margin_pct,
  (gmv - previous_gmv) / nullif(previous_gmv, 0) AS growth, gmv / (SELECT sum(gmv) FROM t) AS share FROM t
""", "gmv:2 cost:2 previous_gmv:2 aov:6 margin:2 margin_pct:8 growth:8 share:8")
def g15(spark, d):
    return R.operator_scorecard(costed(spark, d, "order_id", "sales", "operator"), NOW, BEFORE)


@register("G16_cost_vs_margin", """
SELECT operator, sum(sales) AS gmv, sum(settlement_rmb) AS cost,
  sum(sales) - sum(settlement_rmb) AS margin FROM okcost WHERE operator IS NOT NULL GROUP BY 1
ORDER BY gmv DESC, operator LIMIT 15
""", "gmv:2 cost:2 margin:2")
def g16(spark, d):
    return R.cost_vs_margin(costed(spark, d, "sales", "operator"))


@register("G16_margin_trend", """
SELECT operator, strftime(mon, '%Y-%m-%d') AS month,
  (sum(sales) - sum(settlement_rmb)) / nullif(sum(sales), 0) AS margin_pct FROM okcost
WHERE operator IN (SELECT operator FROM okcost WHERE operator IS NOT NULL GROUP BY 1
                   ORDER BY sum(sales) DESC, operator LIMIT 6) GROUP BY 1, 2
""", "margin_pct:8")
def g16t(spark, d):
    return R.margin_trend(costed(spark, d, "sales", "operator"))


@register("G17_fulfilment_kpis", """
SELECT count(*) AS orders,
  count(*) FILTER (status_group = 'Successful' AND interface_order_id = '--') AS unreconcilable,
  count(*) FILTER (interface_order_id <> '--') / count(*) AS supplier_id_coverage,
  count(*) FILTER (segment = 'B2B' AND pin_code IS NOT NULL) / count(*) FILTER (segment = 'B2B') AS pin_share,
  count(*) FILTER (segment = 'B2C' AND gateway_order_id IS NOT NULL) / count(*) FILTER (segment = 'B2C')
    AS gateway_share FROM fact
""", "supplier_id_coverage:8 pin_share:8 gateway_share:8")
def g17(spark, d):
    return P.fulfilment_kpis(orders_fact(spark, d, "order_id", "segment", "interface_order_id",
                                         "pin_code", "gateway_order_id"))


@register("G18_routing_gap", """
SELECT operator, count(*) AS orders, count(*) FILTER (interface_order_id = '--') AS missing,
  count(*) FILTER (interface_order_id = '--') / count(*) AS missing_share
FROM ok WHERE operator IS NOT NULL GROUP BY 1
""", "missing_share:8")
def g18(spark, d):
    return P.routing_gap(successful(spark, d, "order_id", "operator", "interface_order_id"))


@register("G19_category_overview", """
SELECT category_class, count(*) AS orders, sum(sales) AS gmv, sum(settlement_rmb) AS cost,
  sum(sales) - sum(settlement_rmb) AS margin,
  (sum(sales) - sum(settlement_rmb)) / sum(sales) AS margin_pct FROM okcost GROUP BY 1
""", "gmv:2 cost:2 margin:2 margin_pct:8")
def g19(spark, d):
    return P.category_overview(costed(spark, d, "order_id", "sales", "product_category"))


@register("G19_category_monthly", """
SELECT category_class, strftime(mon, '%Y-%m-%d') AS month, sum(sales) AS gmv, count(*) AS orders FROM ok
WHERE category_class IN (SELECT category_class FROM ok GROUP BY 1 ORDER BY sum(sales) DESC, 1 LIMIT 6)
GROUP BY 1, 2
""", "gmv:2")
def g19m(spark, d):
    return P.category_monthly(successful(spark, d, "order_id", "sales", "product_category", "order_time"))


@register("G20_airtime_denominations", """
SELECT sku_name AS label, count(*) AS orders, sum(sales) AS gmv FROM ok
WHERE product_category IN ('充话费', '后付费') GROUP BY 1 ORDER BY orders DESC, label LIMIT 20
""", "gmv:2")
def g20(spark, d):
    return P.airtime_denominations(successful(spark, d, "order_id", "sales", "product_category",
                                              "sku_name", "denomination"))


@register("G20_denomination_by_operator", """
SELECT sku_name AS label, operator, count(*) AS orders, sum(sales) AS gmv FROM ok
WHERE operator IS NOT NULL AND sku_name IS NOT NULL GROUP BY 1, 2
""", "gmv:2")
def g20o(spark, d):
    return P.denomination_by_operator(successful(spark, d, "order_id", "sales", "operator",
                                                 "sku_name", "denomination"))


@register("G20_denomination_bands", """
WITH t AS (SELECT CASE WHEN n < 10 THEN '<10' WHEN n < 20 THEN '10-20' WHEN n < 30 THEN '20-30'
    WHEN n < 40 THEN '30-40' ELSE '>=40' END AS band, sales
  FROM (SELECT CAST(denomination AS DOUBLE) AS n, sales FROM ok) WHERE n IS NOT NULL)
SELECT band, sum(sales) AS gmv, sum(sales) / (SELECT sum(sales) FROM t) AS share FROM t GROUP BY 1
""", "gmv:2 share:8")
def g20b(spark, d):
    return P.denomination_bands(successful(spark, d, "sales", "denomination"))


@register("G21_denomination_scorecard", """
SELECT operator, denomination, product, count(*) AS orders, sum(sales) AS gmv, sum(settlement_rmb) AS cost,
  sum(sales) - sum(settlement_rmb) AS margin,
  (sum(sales) - sum(settlement_rmb)) / sum(sales) AS margin_pct FROM okcost GROUP BY 1, 2, 3
""", "gmv:2 cost:5 margin:5 margin_pct:8")
def g21(spark, d):
    return P.denomination_scorecard(costed(spark, d, "order_id", "sales", "operator", "denomination",
                                           "product"))


_VOLUME = """CASE WHEN volume_mb >= 1048576 THEN 'Unlimited'
  WHEN volume_mb = 3584 THEN '3.5GB'
  WHEN volume_mb >= 1024 AND volume_mb % 1024 = 0 THEN CAST(volume_mb / 1024 AS INTEGER) || 'GB'
  WHEN volume_mb >= 1024 THEN regexp_replace(CAST(volume_mb / 1024 AS VARCHAR), '\\.0$', '') || 'GB'
  ELSE CAST(volume_mb AS INTEGER) || 'MB' END"""
_DATA = "product_category IN ('买流量', '充流量-测试')"


@register("G22_packages_by_volume", f"""
SELECT volume_mb, CASE WHEN volume_mb IS NOT NULL THEN {_VOLUME} END AS volume, count(*) AS orders,
  sum(sales) AS gmv FROM ok WHERE {_DATA} GROUP BY 1, 2
""", "gmv:2 volume_mb:3")
def g22(spark, d):
    return P.packages_by_volume(successful(spark, d, "order_id", "sales", "product_category", "sku_name",
                                           "product"))


@register("G22_packages_by_tier", f"""
SELECT CASE WHEN volume_mb >= 1048576 THEN 'Unlimited' WHEN volume_mb < 1024 THEN '<1024MB'
  WHEN volume_mb < 10240 THEN '1024-10240MB' WHEN volume_mb < 30720 THEN '10240-30720MB'
  WHEN volume_mb IS NOT NULL THEN '>=30720MB' END AS tier, count(*) AS orders, sum(sales) AS gmv
FROM ok WHERE {_DATA} GROUP BY 1
""", "gmv:2")
def g22t(spark, d):
    return P.packages_by_tier(successful(spark, d, "order_id", "sales", "product_category", "sku_name",
                                         "product"))


@register("G22_packages_by_operator", f"""
SELECT operator, CASE WHEN volume_mb IS NOT NULL THEN {_VOLUME} END AS volume, count(*) AS orders,
  sum(sales) AS gmv FROM ok WHERE {_DATA} AND operator IS NOT NULL GROUP BY 1, 2
""", "gmv:2")
def g22o(spark, d):
    return P.packages_by_operator(successful(spark, d, "order_id", "sales", "product_category", "operator",
                                             "sku_name", "product"))


@register("G23_operator_category", """
SELECT operator, category_class, sum(sales) AS gmv, count(*) AS orders FROM ok
WHERE operator IS NOT NULL GROUP BY 1, 2
""", "gmv:2")
def g23(spark, d):
    return P.operator_category(successful(spark, d, "order_id", "sales", "operator", "product_category"))


_PIVOT = {"airtime": "话费充值", "ewallet_pin": "电子钱包/PIN", "ewallet": "电子钱包", "data": "流量套餐",
          "bill_payment": "账单缴费", "postpaid": "后付费", "other": "其他"}


@register("G23_operator_category_pivot", "SELECT operator, " + ", ".join(
    f"coalesce(sum(sales) FILTER (category_class = '{c}'), 0) AS {n}" for n, c in _PIVOT.items())
    + ", sum(sales) AS total FROM ok WHERE operator IS NOT NULL GROUP BY 1",
    " ".join(f"{n}:2" for n in [*_PIVOT, "total"]))
def g23p(spark, d):
    return P.operator_category_pivot(successful(spark, d, "order_id", "sales", "operator",
                                                "product_category"))


@register("G24_product_tree", """
SELECT category_class, product, sum(sales) AS gmv, count(*) AS orders,
  CAST(grouping(category_class, product) AS BIGINT) AS level FROM ok GROUP BY ROLLUP (category_class, product)
""", "gmv:2")
def g24(spark, d):
    return P.product_tree(successful(spark, d, "order_id", "sales", "product_category", "product"))


@register("G24_L1_top_products", """
SELECT product, segment, sum(sales) AS gmv, count(*) AS orders FROM ok WHERE product IS NOT NULL
GROUP BY 1, 2 ORDER BY gmv DESC, 1, 2 LIMIT 10
""", "gmv:2")
def g24t(spark, d):
    return P.top_products(successful(spark, d, "order_id", "sales", "product", "segment"))


@register("G25_top_destinations", """
SELECT destination, count(*) AS orders, sum(sales) AS gmv FROM ok GROUP BY 1
ORDER BY orders DESC, destination LIMIT 15
""", "gmv:2")
def g25(spark, d):
    return P.top_destinations(successful(spark, d, "order_id", "sales", "area_code"))


@register("G26_corridors", """
SELECT country, destination, count(*) AS orders, sum(sales) AS gmv FROM ok
WHERE NOT (contains(lower(destination), lower(country)) OR contains(lower(country), lower(destination))
  OR (country IN ('United States', 'Canada') AND destination = 'USA/Canada')
  OR (country = 'Democratic Republic of the Congo' AND destination = 'DR Congo')
  OR (country IN ('Russia', 'Kazakhstan') AND destination = 'Russia/Kazakhstan')) GROUP BY 1, 2
""", "gmv:2")
def g26(spark, d):
    return P.corridors(successful(spark, d, "order_id", "sales", "country", "area_code"))


@register("G45_discount_depth", """
SELECT segment, avg(1 - sales_paid / sales_listed) AS discount_depth, count(sales_paid) AS rows
FROM ok WHERE sales_listed > 0 GROUP BY 1
""", "discount_depth:8")
def g45(spark, d):
    return R.discount_depth(successful(spark, d, "sales_paid", "sales_listed", "segment"), "segment")


@register("G46_key_markets", """
WITH t AS (SELECT mon, CASE WHEN country IN ('Egypt', 'Iraq', 'Indonesia') THEN country ELSE 'Global' END
    AS market, sum(sales) AS gmv, count(*) AS orders FROM ok
  WHERE coalesce(country <> 'Malaysia', true) GROUP BY 1, 2)
SELECT strftime(mon, '%Y-%m-%d') AS month, market, gmv, orders, gmv / orders AS aov FROM t
WHERE mon IN (SELECT DISTINCT mon FROM t ORDER BY mon DESC LIMIT 3)
""", "gmv:2 aov:6")
def g46(spark, d):
    df = successful(spark, d, "order_id", "sales", "country", "order_time")
    return R.key_markets(df.filter(exclude_markets("rollup")), ("Egypt", "Iraq", "Indonesia"))


@register("G46_category_share_recent", """
WITH t AS (SELECT mon, CASE WHEN product_category IN ('充话费', '后付费') THEN 'Airtime' ELSE 'Data' END AS kind,
    count(*) AS orders FROM ok
  WHERE product_category IN ('充话费', '后付费', '买流量', '充流量-测试') GROUP BY 1, 2)
SELECT strftime(mon, '%Y-%m-%d') AS month, kind, orders, orders / sum(orders) OVER (PARTITION BY mon) AS share
FROM t WHERE mon IN (SELECT DISTINCT mon FROM t ORDER BY mon DESC LIMIT 3)
""", "share:8")
def g46c(spark, d):
    return R.category_share_recent(successful(spark, d, "order_id", "product_category", "order_time"))


@register("G47_opportunity_quadrants", """
WITH t AS (SELECT country, sum(sales) AS gmv, count(*) AS orders, sum(sales) / count(*) AS aov FROM ok
           WHERE country IS NOT NULL GROUP BY 1),
     m AS (SELECT median(orders) AS mo, median(aov) AS ma FROM t)
SELECT t.*, CASE WHEN orders >= mo AND aov >= ma THEN 'high orders, high AOV'
  WHEN orders >= mo THEN 'high orders, low AOV' WHEN aov >= ma THEN 'low orders, high AOV'
  ELSE 'low orders, low AOV' END AS quadrant FROM t, m
""", "gmv:2 aov:6")
def g47(spark, d):
    return R.opportunity_quadrants(successful(spark, d, "order_id", "sales", "country"))


@register("G48_profit_pool", """
WITH t AS (SELECT operator, sum(sales) AS gmv, sum(sales) - sum(settlement_rmb) AS margin
           FROM okcost WHERE operator IS NOT NULL GROUP BY 1)
SELECT *, margin / (SELECT sum(margin) FROM t) AS margin_share FROM t
""", "gmv:2 margin:2 margin_share:8")
def g48(spark, d):
    return R.profit_pool(costed(spark, d, "sales", "operator"), "operator")


@register("G48_revenue_bridge", """
WITH t AS (SELECT sum(sales) FILTER (year(order_time) = 1999) AS ga, count(*) FILTER (year(order_time) = 1999)
    AS oa, sum(sales) FILTER (year(order_time) = 2000) AS gb, count(*) FILTER (year(order_time) = 2000) AS ob
  FROM ok)
SELECT '1 start' AS step, ga AS amount FROM t UNION ALL SELECT '2 volume', (ob - oa) * (ga / oa) FROM t
UNION ALL SELECT '3 price', gb - ga - (ob - oa) * (ga / oa) FROM t UNION ALL SELECT '4 end', gb FROM t
""", "amount:2")
def g48b(spark, d):
    return R.revenue_bridge(successful(spark, d, "order_id", "sales", "order_time"), BEFORE, NOW)


@register("G49_pin_store_weekly", """
WITH t AS (SELECT CAST(date_trunc('week', order_time) AS DATE) AS w, operator, denomination, count(*) AS orders
           FROM ok WHERE pin_code IS NOT NULL GROUP BY 1, 2, 3)
SELECT strftime(w, '%Y-%m-%d') AS week, operator, denomination, orders FROM t
WHERE w IN (SELECT DISTINCT w FROM t ORDER BY w DESC LIMIT 12)
""")
def g49(spark, d):
    return P.pin_store_weekly(successful(spark, d, "order_id", "pin_code", "operator", "denomination",
                                         "order_time"))


@register("G49_pin_stock_estimate", """
WITH t AS (SELECT CAST(date_trunc('week', order_time) AS DATE) AS w, operator, denomination, count(*) AS n
           FROM ok WHERE pin_code IS NOT NULL GROUP BY 1, 2, 3),
  r AS (SELECT * FROM t WHERE w IN (SELECT DISTINCT w FROM t ORDER BY w DESC LIMIT 4))
SELECT operator, denomination, CAST(sum(n) AS BIGINT) AS orders,
  sum(n) / (SELECT count(DISTINCT w) FROM r) AS weekly_estimate FROM r GROUP BY 1, 2
""", "weekly_estimate:6")
def g49e(spark, d):
    return P.pin_stock_estimate(successful(spark, d, "order_id", "pin_code", "operator", "denomination",
                                           "order_time"))


@register("G50_settlement_audit", """
SELECT settlement_iso, country, count(*) AS rows, sum(settlement_rmb) AS settlement_rmb,
  median((sales - settlement_rmb) / sales) AS median_margin_pct FROM okcost GROUP BY 1, 2
""", "settlement_rmb:2 median_margin_pct:8")
def g50(spark, d):
    return R.settlement_audit(costed(spark, d, "sales", "country"))


@register("G50_median_refined", """
SELECT l_returnflag AS flag, median(l_extendedprice) AS median_price, count(*) AS rows FROM lineitem GROUP BY 1
""", "median_price:4")
def g50r(spark, d):
    """The exact median where a value bucket holds far more values than one task may order."""
    from orderflux.operators.ordering import exact_median
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("price"))
    return exact_median(rows, ["flag"], "price", "median_price", resolution=1, most=64).select("flag", "median_price", "rows")


@register("G50_settlement_audit_with_gaps", """
WITH t AS (SELECT CASE WHEN okey % 3 > 0 THEN settlement_iso END AS settlement_iso, country,
    CASE WHEN okey % 5 > 0 THEN sales END AS sales, settlement_rmb FROM okcost)
SELECT settlement_iso, country, count(*) AS rows, sum(settlement_rmb) AS settlement_rmb,
  median((sales - settlement_rmb) / sales) AS median_margin_pct FROM t GROUP BY 1, 2
""", "settlement_rmb:2 median_margin_pct:8")
def g50_gaps(spark, d):
    """Orders without currency and without sales keep their row, sum and median."""
    key = F.col("order_id").cast("bigint")
    rows = costed(spark, d, "order_id", "sales", "country").withColumns({
        "settlement_iso": F.when(key % 3 > 0, F.col("settlement_iso")), "sales": F.when(key % 5 > 0, F.col("sales"))})
    return R.settlement_audit(rows)


@register("G51_sales_explorer", """
SELECT region, segment, CASE WHEN grouping(region, segment) > 0 THEN 1 ELSE 0 END::BIGINT AS is_total,
  sum(sales) AS gmv, count(*) AS orders, sum(sales) / count(*) AS aov,
  sum(sales) / (SELECT sum(sales) FROM ok) AS share
FROM ok GROUP BY GROUPING SETS ((region, segment), ())
""", "gmv:2 aov:6 share:8")
def g51(spark, d):
    return R.explorer(successful(spark, d, "order_id", "sales", "user_id", "region", "segment"),
                      ["region", "segment"])


@register("G52_snapshot_counts", """
SELECT count(*) AS rows, strftime(min(order_time), '%Y-%m-%d %H:%M:%S') AS first_order,
  strftime(max(order_time), '%Y-%m-%d %H:%M:%S') AS last_order,
  count(*) FILTER (segment = 'B2B') AS b2b_rows, count(*) FILTER (segment = 'B2C') AS b2c_rows FROM fact
""")
def g52(spark, d):
    return R.snapshot_counts(orders_fact(spark, d, "order_time", "segment"))


@register("G52_L4_snapshot_charts", """
SELECT 'month' AS chart, ym AS key, sum(sales) AS gmv FROM ok
  WHERE ym IN (SELECT DISTINCT ym FROM ok ORDER BY 1 DESC LIMIT 8) GROUP BY 2
UNION ALL SELECT 'segment', segment, sum(sales) FROM ok GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'market', country, sum(sales) AS g FROM ok GROUP BY 2
                         ORDER BY g DESC, country LIMIT 8)
""", "gmv:2")
def g52c(spark, d):
    return R.snapshot_charts(successful(spark, d, "sales", "segment", "country", "order_time"))


_KIND = """CASE WHEN product_category IN ('充话费', '后付费') THEN 'Airtime'
  WHEN product_category IN ('买流量', '充流量-测试') THEN 'Data' END"""
_TYPE = """CASE WHEN date_trunc('month', register_time) = date_trunc('month', order_time) THEN 'New'
  WHEN date_trunc('month', register_time) < date_trunc('month', order_time) THEN 'Returning'
  ELSE 'Unknown' END"""

for _measure, _n in (("orders", 5), ("gmv", 10)):
    @register(f"G53_L3_product_ranking_by_{_measure}", f"""
    WITH t AS (SELECT {_TYPE} AS customer_type, {_KIND} AS kind, brand, sku_name AS label,
        count(*) AS orders, sum(sales) AS gmv FROM ok WHERE {_KIND} IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_type, kind
        ORDER BY {_measure} DESC, brand, label) AS rank FROM t) WHERE rank <= {_n}
    """, "gmv:2")
    def g53(spark, d, measure=_measure, n=_n):
        df = successful(spark, d, "order_id", "sales", "product_category", "brand", "sku_name",
                        "denomination", "order_time", "register_time")
        return P.ranking_by_customer_type(df, measure, n)


@register("G54_supplier_concentration", """
WITH t AS (SELECT category_class, operator, sum(sales) AS gmv FROM ok WHERE operator IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY category_class ORDER BY gmv DESC, operator) AS rk FROM t)
SELECT category_class, sum(gmv) AS total, count(*) AS operators, sum(gmv) FILTER (rk <= 3) AS top_gmv,
  sum(gmv) FILTER (rk <= 3) / sum(gmv) AS top_share,
  CASE WHEN sum(gmv) FILTER (rk <= 3) / sum(gmv) > 0.8 THEN 1 ELSE 0 END::BIGINT AS concentrated
FROM r GROUP BY 1
""", "total:2 top_gmv:2 top_share:8")
def g54(spark, d):
    return P.supplier_concentration(successful(spark, d, "sales", "operator", "product_category"))


@register("G55_target_overlay", """
WITH t AS (SELECT mon, sum(sales) AS actual FROM ok GROUP BY 1),
  p AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, count(*) * 250000.0::DOUBLE AS target
        FROM orders GROUP BY 1)
SELECT strftime(t.mon, '%Y-%m-%d') AS month, actual, target, actual / target AS attainment
FROM t LEFT JOIN p USING (mon)
""", "actual:2 target:2 attainment:8")
def g55(spark, d):
    plan = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(
        (F.count(F.lit(1)) * 250000.0).alias("target"))
    return R.target_overlay(successful(spark, d, "sales", "order_time"), plan)


for _member, _n in (("operator", 7), ("product", 5)):
    @register(f"G56_top_{_member}_trend", f"""
    SELECT {_member}, strftime(mon, '%Y-%m-%d') AS month, sum(sales) AS gmv, count(*) AS orders FROM ok
    WHERE {_member} IN (SELECT {_member} FROM ok WHERE {_member} IS NOT NULL GROUP BY 1
                        ORDER BY sum(sales) DESC, 1 LIMIT {_n}) GROUP BY 1, 2
    """, "gmv:2")
    def g56(spark, d, member=_member, n=_n):
        return R.top_member_trend(successful(spark, d, "order_id", "sales", member, "order_time"),
                                  member, n)


@register("L5_scorecard_display_cap", """
SELECT operator, denomination, product, count(*) AS orders, sum(sales) AS gmv, sum(settlement_rmb) AS cost,
  sum(sales) - sum(settlement_rmb) AS margin,
  (sum(sales) - sum(settlement_rmb)) / sum(sales) AS margin_pct FROM okcost GROUP BY 1, 2, 3
ORDER BY gmv DESC, operator, denomination, product LIMIT 500
""", "gmv:2 cost:5 margin:5 margin_pct:8")
def l5(spark, d):
    """The screen shows 500 rows; exports use the uncapped scorecard."""
    return P.denomination_scorecard(costed(spark, d, "order_id", "sales", "operator", "denomination",
                                           "product"), 500)
