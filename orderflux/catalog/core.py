"""Dimensions, expressions, filters, exchange rates, comparisons and series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from orderflux.catalog.base import costed, dated_rates, register
from orderflux.functions import dimensions as D
from orderflux.functions import expressions as E
from orderflux.functions.measures import gmv, orders
from orderflux.operators import filters as FL
from orderflux.operators import fx, geo
from orderflux.operators.normalise import normalise
from orderflux.operators.ordering import pareto
from orderflux.plans import demand as DM
from orderflux.plans import series as S
from orderflux.sources.orders import orders_fact, successful, table

NOW, BEFORE = (date(2000, 1, 1), date(2000, 12, 31)), (date(1999, 1, 1), date(1999, 12, 31))


# --- normalising -----------------------------------------------------------

def raw_headings(spark, d):
    """Orders under source headings, all text; some paid amounts are missing or unreadable."""
    f = orders_fact(spark, d, "order_id", "cust_key", "raw_country", "sales_paid", "sales_listed",
                    "order_time", "order_status")
    n = F.col("cust_key")
    paid = F.when(n % 13 == 0, "abc").otherwise(F.col("sales_paid").cast("string"))
    return f.select(
        F.col("order_id").alias("订单号"), F.col("raw_country").alias("国家"), paid.alias("实际支付"),
        F.col("sales_listed").cast("string").alias("售价"),
        F.date_format("order_time", "yyyy-MM-dd HH:mm:ss").alias("订单时间"),
        F.col("order_status").alias("订单状态"),
        F.when(n % 2 == 0, "A").alias("商品分类"), F.lit("B").alias("分类"))


@register("N1_N2_normalise_columns", """
SELECT order_id, country, CASE WHEN ckey % 13 = 0 THEN NULL ELSE coalesce(sales_paid, sales_listed) END AS sales,
  sales_listed, strftime(order_time, '%Y-%m-%d %H:%M:%S') AS order_time, order_status,
  CASE WHEN ckey % 2 = 0 THEN 'A' END AS product_category FROM fact
""", "sales:2 sales_listed:2")
def n1(spark, d):
    return normalise(raw_headings(spark, d)).drop("sales_paid")


@register("N3_N4_N5_country_dimensions", """
SELECT raw_country, country, region,
  CASE country WHEN 'Egypt' THEN 'EGY' WHEN 'United States' THEN 'USA' WHEN 'Malaysia' THEN 'MYS'
  WHEN 'United Kingdom' THEN 'GBR' WHEN 'United Arab Emirates' THEN 'ARE' WHEN 'Morocco' THEN 'MAR'
  WHEN 'Brazil' THEN 'BRA' WHEN 'Indonesia' THEN 'IDN' WHEN 'France' THEN 'FRA' WHEN 'Saudi Arabia' THEN 'SAU'
  WHEN 'Democratic Republic of the Congo' THEN 'COD' WHEN 'Canada' THEN 'CAN' WHEN 'Hong Kong' THEN 'HKG'
  WHEN 'Russia' THEN 'RUS' WHEN 'Iraq' THEN 'IRQ' WHEN 'Côte d''Ivoire' THEN 'CIV' WHEN 'Mexico' THEN 'MEX'
  WHEN 'China' THEN 'CHN' WHEN 'Germany' THEN 'DEU' WHEN 'Turkey' THEN 'TUR' WHEN 'Nigeria' THEN 'NGA'
  WHEN 'Australia' THEN 'AUS' WHEN 'New Zealand' THEN 'NZL' WHEN 'Kazakhstan' THEN 'KAZ' END AS iso3,
  count(*) AS orders FROM fact GROUP BY ALL
""")
def n3(spark, d):
    f = orders_fact(spark, d, "order_id", "raw_country")
    out = D.translate_country(f.withColumn("country", F.col("raw_country")))
    out = D.add_iso3(D.add_region(out))
    return out.groupBy("raw_country", "country", "region", "iso3").agg(orders(f).alias("orders"))


@register("N6_destination_of_calling_code", """
SELECT area_code, mapped_destination AS destination, count(*) AS orders FROM fact GROUP BY 1, 2
""")
def n6(spark, d):
    f = orders_fact(spark, d, "order_id", "area_code")
    return D.add_destination(f).groupBy("area_code", "destination").agg(orders(f).alias("orders"))


@register("N7_category_class", """
SELECT product_category, category_class,
  CASE category_class WHEN '话费充值' THEN 'Airtime' WHEN '电子钱包/PIN' THEN 'E-wallet/PIN'
    WHEN '电子钱包' THEN 'E-wallet' WHEN '流量套餐' THEN 'Data' WHEN '账单缴费' THEN 'Bill Payment'
    WHEN '后付费' THEN 'Postpaid' ELSE '其他' END AS label, count(*) AS orders FROM fact GROUP BY 1, 2, 3
""")
def n7(spark, d):
    f = orders_fact(spark, d, "order_id", "product_category")
    return D.add_category_class(f, label="label").groupBy(
        "product_category", "category_class", "label").agg(orders(f).alias("orders"))


@register("N8_country_scrub", """
SELECT CASE WHEN okey % 40 < 2 THEN NULL ELSE country END AS country, count(*) AS orders FROM fact GROUP BY 1
""")
def n8(spark, d):
    f = orders_fact(spark, d, "order_id", "country")
    key = F.col("order_id").cast("bigint") % 40
    dirty = F.when(key == 0, "2026-08-01 10:00:00").when(key == 1, " UseePay ").otherwise(F.col("country"))
    return f.withColumn("country", E.scrub_country(dirty)).groupBy("country").agg(
        orders(f).alias("orders"))


@register("N9_operator_from_brand", """
SELECT CASE WHEN okey % 3 = 0 AND operator IS NOT NULL THEN operator
  WHEN okey % 3 = 1 AND brand IS NOT NULL THEN brand ELSE product END AS operator, count(*) AS orders
FROM fact GROUP BY 1
""")
def n9(spark, d):
    f = orders_fact(spark, d, "order_id", "operator", "brand", "product")
    key = F.col("order_id").cast("bigint") % 3
    filled = E.operator_from_brand(F.when(key == 0, F.col("operator")),
                                   F.when(key == 1, F.col("brand")).otherwise(" "),
                                   F.concat("product", F.lit("话费")))
    return f.withColumn("operator", filled).groupBy("operator").agg(orders(f).alias("orders"))


@register("N10_flags", """
SELECT CASE WHEN okey % 7 = 0 THEN NULL WHEN coupon_used THEN 1 ELSE 0 END::BIGINT AS coupon_used,
  count(*) AS orders FROM fact GROUP BY 1
""")
def n10(spark, d):
    f = orders_fact(spark, d, "order_id", "coupon_used")
    text = F.when(F.col("order_id").cast("bigint") % 7 == 0, "junk").when(F.col("coupon_used"), " 是").otherwise("否")
    return f.withColumn("coupon_used", E.to_flag(text)).groupBy("coupon_used").agg(orders(f).alias("orders"))


@register("N11_package_volume", """
SELECT sku_name, volume_mb, count(*) AS orders
FROM fact GROUP BY 1, 2
""", "volume_mb:3")
def n11(spark, d):
    f = orders_fact(spark, d, "order_id", "sku_name", "product", "product_category")
    mb = E.package_mb(F.col("sku_name"), F.col("product"))
    return f.groupBy("sku_name", mb.alias("volume_mb")).agg(orders(f).alias("orders"))


@register("N12_N13_category_kind_and_label", """
SELECT CASE WHEN product_category IN ('充话费', '后付费') THEN 'Airtime'
  WHEN product_category IN ('买流量', '充流量-测试') THEN 'Data' ELSE 'Neither' END AS kind,
  CASE WHEN okey % 2 = 0 THEN sku_name ELSE denomination END AS label, count(*) AS orders
FROM fact GROUP BY 1, 2
""")
def n12(spark, d):
    f = orders_fact(spark, d, "order_id", "product_category", "sku_name", "denomination")
    c = F.col("product_category")
    kind = F.when(E.is_airtime_category(c), "Airtime").when(E.is_data_category(c), "Data").otherwise("Neither")
    sku = F.when(F.col("order_id").cast("bigint") % 2 == 0, F.col("sku_name")).otherwise("")
    label = E.denomination_label(sku, F.col("denomination"))
    return f.groupBy(kind.alias("kind"), label.alias("label")).agg(orders(f).alias("orders"))


@register("N14_N15_status_and_supplier_id", """
SELECT order_status, status_group, CASE WHEN interface_order_id <> '--' THEN 1 ELSE 0 END::BIGINT AS usable,
  count(*) AS orders FROM fact GROUP BY 1, 2, 3
""")
def n14(spark, d):
    f = orders_fact(spark, d, "order_id", "interface_order_id")
    usable = E.usable_supplier_id(F.col("interface_order_id")).isNotNull()
    return f.groupBy("order_status", E.status_group(F.col("order_status")).alias("status_group"),
                     usable.alias("usable")).agg(orders(f).alias("orders"))


# --- filters ---------------------------------------------------------------

@register("F1_sidebar_filter", """
SELECT country, category_class, count(*) AS orders, sum(sales) AS gmv FROM ok
WHERE segment = 'B2C' AND region = 'Africa' AND category_class IN ('话费充值', '账单缴费')
  AND category_class = '话费充值' AND day BETWEEN DATE '1999-01-01' AND DATE '2000-06-30' GROUP BY 1, 2
""", "gmv:2")
def f1(spark, d):
    f = orders_fact(spark, d, "order_id", "sales", "segment", "region", "country", "product_category",
                    "order_time")
    rows = f.filter(FL.sidebar(segment="B2C", region="Africa", category_class="话费充值",
                               start=date(1999, 1, 1), end=date(2000, 6, 30)))
    return D.add_category_class(rows).groupBy("country", "category_class").agg(
        orders(f).alias("orders"), gmv().alias("gmv"))


@register("F2_status_filter", """
SELECT count(*) FILTER (status_group = 'Successful') AS successful, count(*) AS all_orders,
  count(*) FILTER (status_group <> 'Successful') AS non_successful,
  count(*) FILTER (status_group = 'Refunded') AS refunded,
  count(*) FILTER (status_group = 'Cancelled') AS cancelled,
  count(*) FILTER (status_group = 'Pending') AS pending FROM fact
""")
def f2(spark, d):
    f = orders_fact(spark, d)
    names = {"Successful": "successful", "All": "all_orders", "Non-successful": "non_successful",
             "Refunded": "refunded", "Cancelled": "cancelled", "Pending": "pending"}
    return f.agg(*[F.count_if(FL.status(choice)).alias(name) for choice, name in names.items()])


@register("F3_quality_view", """
SELECT status_group, region, count(*) AS orders, sum(sales) AS gmv FROM fact GROUP BY 1, 2
""", "gmv:2")
def f3(spark, d):
    f = FL.quality_view(orders_fact(spark, d, "order_id", "sales", "region"))
    return f.groupBy("status_group", "region").agg(orders(f).alias("orders"), gmv().alias("gmv"))


@register("F4_category_selection", """
SELECT count(*) FILTER (category_class <> '其他') AS any_class,
  count(*) FILTER (category_class = '账单缴费') AS bills,
  count(*) FILTER (product_category = '后付费') AS postpaid_one,
  count(*) FILTER (product_category = 'none') AS foreign_sub FROM ok
""")
def f4(spark, d):
    f = successful(spark, d, "product_category")
    cases = {"any_class": FL.category(), "bills": FL.category("账单缴费"),
             "postpaid_one": FL.category("后付费", ["后付费", "充话费"]),
             "foreign_sub": FL.category("后付费", ["充话费"])}
    return f.agg(*[F.count_if(c).alias(n) for n, c in cases.items()])


@register("F5_ewallet_exclusion", """
SELECT count(*) FILTER (category_class NOT IN ('电子钱包/PIN', '电子钱包')) AS kept, count(*) AS overridden,
  sum(CASE WHEN category_class NOT IN ('电子钱包/PIN', '电子钱包') THEN sales ELSE 0 END) AS gmv FROM ok
""", "gmv:2")
def f5(spark, d):
    f = successful(spark, d, "sales", "product_category")
    return f.agg(F.count_if(FL.exclude_ewallet()).alias("kept"),
                 F.count_if(FL.exclude_ewallet("电子钱包")).alias("overridden"),
                 gmv(FL.exclude_ewallet()).alias("gmv"))


@register("F6_market_exclusion", """
SELECT sum(CASE WHEN country = 'Malaysia' THEN 0 ELSE sales END) AS rollup,
  sum(CASE WHEN country = 'Malaysia' THEN sales ELSE 0 END) AS single FROM ok
""", "rollup:2 single:2")
def f6(spark, d):
    f = successful(spark, d, "sales", "country")
    return f.agg(gmv(FL.exclude_markets("rollup")).alias("rollup"),
                 gmv(FL.exclude_markets("single") & (F.col("country") == "Malaysia")).alias("single"))


@register("F7_channel_mapping", """
SELECT CASE user_source WHEN 'BUILDING' THEN '微信小程序' WHEN 'FURNITURE' THEN '支付宝' ELSE user_source END
  AS member_source, count(*) AS orders FROM ok WHERE user_source <> 'MACHINERY' GROUP BY 1
""")
def f7(spark, d):
    f = successful(spark, d, "order_id", "user_source")
    mapping = D.local_table(spark, "source string, member string",
                            [("MACHINERY", "删除"), ("BUILDING", "微信小程序"), ("FURNITURE", "支付宝")])
    return FL.map_channels(f, mapping).groupBy("member_source").agg(orders(f).alias("orders"))


@register("F8_quick_and_previous_period", """
SELECT sum(sales) FILTER (day BETWEEN DATE '2000-06-01' AND DATE '2000-06-30') AS last_30_days,
  sum(sales) FILTER (day BETWEEN DATE '2000-05-02' AND DATE '2000-05-31') AS previous,
  sum(sales) FILTER (day BETWEEN DATE '2000-05-01' AND DATE '2000-05-31') AS last_month,
  sum(sales) FILTER (day BETWEEN DATE '2000-01-01' AND DATE '2000-06-30') AS this_year FROM ok
""", "last_30_days:2 previous:2 last_month:2 this_year:2")
def f8(spark, d):
    today = date(2000, 6, 30)
    f = successful(spark, d, "sales", "order_time")
    last30 = FL.quick_period("last_30_days", today)
    cases = {"last_30_days": last30, "previous": FL.previous_period(*last30),
             "last_month": FL.quick_period("last_month", today),
             "this_year": FL.quick_period("this_year", today)}
    return f.agg(*[gmv(FL.date_range(*p)).alias(n) for n, p in cases.items()])


@register("F9_product_tab_filter", """
SELECT product, count(*) AS orders, sum(sales) AS gmv FROM ok
WHERE operator IN ('Supplier#000000001', 'Supplier#000000002') AND category_class = '流量套餐' GROUP BY 1
""", "gmv:2")
def f9(spark, d):
    f = successful(spark, d, "order_id", "sales", "operator", "product", "product_category")
    rows = f.filter(FL.product_tab(["Supplier#000000001", "Supplier#000000002"], "流量套餐"))
    return rows.groupBy("product").agg(orders(f).alias("orders"), gmv().alias("gmv"))


# --- exchange rates --------------------------------------------------------

@register("J1_rate_asof_by_currency", """
SELECT settlement_iso, ym AS month, fx_rate AS rate, count(*) AS orders FROM cost GROUP BY 1, 2, 3
""", "rate:8")
def j1(spark, d):
    f = orders_fact(spark, d, "order_id", "settlement_iso", "order_time").withColumn(
        "month", E.month_text(F.col("order_time")))
    out = fx.rate_for_iso(f, dated_rates(spark, d), F.col("settlement_iso"), F.col("month"))
    return out.groupBy("settlement_iso", "month", "rate").agg(orders(f).alias("orders"))


@register("J1_latest_rate_by_currency", """
SELECT settlement_iso, coalesce((SELECT max_by(rate, month) FROM rates r WHERE r.iso = settlement_iso),
  any_value(snapshot)) AS rate, count(*) AS orders FROM fact GROUP BY 1
""", "rate:8")
def j1l(spark, d):
    f = orders_fact(spark, d, "order_id", "settlement_iso")
    out = fx.rate_for_iso(f, dated_rates(spark, d), F.col("settlement_iso"), None)
    return out.groupBy("settlement_iso", "rate").agg(orders(f).alias("orders"))


_J2 = """e AS (SELECT iso, min_by(rate, month) AS earliest, min(month) AS first FROM rates GROUP BY 1),
  c AS (SELECT f.*, CASE WHEN settlement_iso IN ('CDF', 'XXX') THEN NULL WHEN ym < e.first THEN e.earliest
      ELSE fx_rate END AS country_rate FROM cost f LEFT JOIN e ON e.iso = settlement_iso)"""


@register("J2_rate_asof_by_country", f"""
WITH {_J2} SELECT country, ym AS month, country_rate AS rate, count(*) AS orders FROM c GROUP BY 1, 2, 3
""", "rate:8")
def j2(spark, d):
    f = orders_fact(spark, d, "order_id", "country", "order_time").withColumn(
        "month", E.month_text(F.col("order_time")))
    out = fx.rate_for_country(f, dated_rates(spark, d), F.col("country"), F.col("month"))
    return out.groupBy("country", "month", "rate").agg(orders(f).alias("orders"))


@register("J3_settlement_in_rmb", """
SELECT settlement_iso, count(*) AS orders, sum(settlement_price) AS local, sum(settlement_rmb) AS rmb
FROM cost GROUP BY 1
""", "local:2 rmb:2")
def j3(spark, d):
    f = costed(spark, d, "order_id", every_status=True)
    return f.groupBy("settlement_iso").agg(
        orders(f).alias("orders"), gmv(column="settlement_price").alias("local"),
        gmv(column="settlement_rmb").alias("rmb"))


@register("J4_display_currency", """
WITH e AS (SELECT min_by(rate, month) AS earliest, min(month) AS first FROM rates WHERE iso = 'MYR'),
  c AS (SELECT f.*, CASE WHEN ym < e.first THEN e.earliest ELSE s.rate END AS r FROM ok f CROSS JOIN e
        LEFT JOIN spans s ON s.iso = 'MYR' AND ym >= s.month AND (s.nxt IS NULL OR ym < s.nxt)
        WHERE country = 'Malaysia')
SELECT strftime(mon, '%Y-%m-%d') AS month, sum(sales) AS rmb, sum(sales * 0.14::DOUBLE) AS usd,
  sum(sales * r) AS local FROM c GROUP BY 1
""", "rmb:2 usd:4 local:4")
def j4(spark, d):
    f = successful(spark, d, "sales", "country", "order_time").filter("country = 'Malaysia'")
    rates = dated_rates(spark, d)
    out = fx.display_currency(f, rates, "RMB", out="rmb")
    out = fx.display_currency(out, rates, "USD", out="usd")
    out = fx.display_currency(out, rates, "Local", "Malaysia", out="local")
    return out.groupBy(E.month(F.col("order_time")).alias("month")).agg(
        F.sum("rmb").alias("rmb"), F.sum("usd").alias("usd"), F.sum("local").alias("local"))


_DAILY_SQL = """daily AS (
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, settlement_iso AS iso,
      snapshot * (1.0::DOUBLE + dayofmonth(o_orderdate) / 997.0::DOUBLE) AS rate
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nat ON nation_key = c_nationkey
    WHERE c_nationkey < 20 AND c_nationkey NOT IN (4, 9) AND snapshot IS NOT NULL),
  pegs(iso, p) AS (VALUES ('SAR', 3.75), ('AED', 3.6725), ('QAR', 3.64), ('OMR', 0.3845), ('JOD', 0.709),
    ('BHD', 0.376), ('PAB', 1.0), ('BSD', 1.0), ('BMD', 1.0), ('XCD', 2.70), ('BBD', 2.0), ('BZD', 2.0),
    ('CUP', 24.0), ('DJF', 177.72), ('ERN', 15.0), ('LBP', 89500.0)),
  mean AS (SELECT iso, strftime(day, '%Y-%m') AS month, avg(rate) AS rate, 'ecb' AS source FROM daily
           WHERE iso <> 'CNY' GROUP BY 1, 2),
  pegged AS (SELECT pegs.iso, month, rate * CAST(p AS DOUBLE) AS rate, 'usd-peg' AS source
             FROM mean CROSS JOIN pegs WHERE mean.iso = 'USD'),
  rest AS (SELECT DISTINCT settlement_iso AS iso, (SELECT max(month) FROM mean) AS month, snapshot AS rate,
             'er-api-latest' AS source FROM nation JOIN nat ON nation_key = n_nationkey
           WHERE snapshot IS NOT NULL AND settlement_iso <> 'CNY'
             AND settlement_iso NOT IN (SELECT iso FROM mean) AND settlement_iso NOT IN (SELECT iso FROM pegs))"""


def daily_rates(spark, d):
    """Daily rates derived from the order days of each nation."""
    base = D.fx_snapshot(spark).groupBy("iso").agg(F.max("rate").alias("snapshot"))
    from orderflux.sources.orders import nations
    rows = (table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
            .filter("c_nationkey < 20 AND c_nationkey NOT IN (4, 9)")
            .join(nations(spark), F.col("nation_key") == F.col("c_nationkey"))
            .join(base, F.col("iso") == F.col("settlement_iso")))
    return rows.select(
        F.to_date("o_orderdate").alias("day"), "iso",
        (F.col("snapshot") * (1.0 + F.dayofmonth("o_orderdate") / 997.0)).alias("rate")).distinct()


def latest_rates(spark, d):
    from orderflux.sources.orders import nations
    base = D.fx_snapshot(spark).groupBy("iso").agg(F.max("rate").alias("rate"))
    return (table(spark, d, "nation").join(nations(spark), F.col("nation_key") == F.col("n_nationkey"))
            .join(base, F.col("iso") == F.col("settlement_iso")).select("iso", "rate").distinct())


@register("M13_U4_fx_table_derivation", f"""
WITH {_DAILY_SQL}
SELECT * FROM mean UNION ALL SELECT * FROM pegged UNION ALL SELECT * FROM rest
""", "rate:6")
def m13(spark, d):
    return fx.derive_rate_table(daily_rates(spark, d), latest_rates(spark, d))


@register("A8_newest_fx_month", "SELECT max(month) AS dated_max_month FROM rates")
def a8fx(spark, d):
    return fx.newest_month(dated_rates(spark, d))


@register("J10_market_matches_destination", """
SELECT CASE WHEN contains(lower(mapped_destination), lower(country))
    OR contains(lower(country), lower(mapped_destination))
    OR (country IN ('United States', 'Canada') AND mapped_destination = 'USA/Canada')
    OR (country = 'Democratic Republic of the Congo' AND mapped_destination = 'DR Congo')
    OR (country IN ('Russia', 'Kazakhstan') AND mapped_destination = 'Russia/Kazakhstan')
  THEN 1 ELSE 0 END::BIGINT AS same_market, count(*) AS orders FROM fact GROUP BY 1
""")
def j10(spark, d):
    f = orders_fact(spark, d, "order_id", "country", "area_code")
    out = geo.same_market(D.add_destination(f))
    return out.groupBy("same_market").agg(orders(f).alias("orders"))


@register("J11_ip_country_mismatch", """
SELECT CASE WHEN ip_country IS NULL OR country IS NULL THEN NULL WHEN ip_country <> country THEN 1 ELSE 0 END::BIGINT
  AS mismatch, count(*) AS orders FROM fact GROUP BY 1
""")
def j11(spark, d):
    f = orders_fact(spark, d, "order_id", "country", "ip_country")
    return f.groupBy(geo.ip_mismatch(F.col("ip_country"), F.col("country")).alias("mismatch")).agg(
        orders(f).alias("orders"))


# --- series and comparisons ------------------------------------------------

_SERIES = """ds AS (SELECT day, sum(sales) AS s FROM ok GROUP BY 1),
  cal AS (SELECT CAST(unnest(generate_series(min(day), max(day) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day
          FROM ds),
  filled AS (SELECT cal.day, coalesce(s, 0) AS revenue FROM cal LEFT JOIN ds USING (day)),
  series AS (SELECT day, revenue, row_number() OVER (ORDER BY day) - 1 AS t FROM filled
             WHERE day >= (SELECT min(day) FROM filled WHERE revenue > 0))"""


@register("M1_daily_series", f"""
WITH {_SERIES} SELECT strftime(day, '%Y-%m-%d') AS day, revenue, t FROM series
""", "revenue:2")
def m1(spark, d):
    return S.daily_series(successful(spark, d, "sales", "order_time"))


@register("M1_daily_series_by_market", """
WITH ds AS (SELECT country, day, sum(sales) AS s FROM ok GROUP BY 1, 2),
  b AS (SELECT country, min(day) AS lo, max(day) AS hi FROM ds GROUP BY 1),
  cal AS (SELECT country, CAST(unnest(generate_series(lo, hi - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
  filled AS (SELECT cal.country, cal.day, coalesce(s, 0) AS revenue FROM cal LEFT JOIN ds
             ON ds.day = cal.day AND ds.country = cal.country)
SELECT country, strftime(day, '%Y-%m-%d') AS day, revenue,
  row_number() OVER (PARTITION BY country ORDER BY day) - 1 AS t FROM filled
""", "revenue:2")
def m1m(spark, d):
    return S.daily_series(successful(spark, d, "sales", "order_time", "country"), "country")


@register("W1_lag_features", f"""
WITH {_SERIES}, l AS (SELECT *, coalesce(lag(revenue, 1) OVER w, 0) AS lag1, lag(revenue, 7) OVER w AS l7,
    lag(revenue, 14) OVER w AS l14, avg(revenue) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r7,
    avg(revenue) OVER (ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS r28
    FROM series WINDOW w AS (ORDER BY day))
SELECT strftime(day, '%Y-%m-%d') AS day, revenue, t, lag1, coalesce(l7, lag1) AS lag7,
  coalesce(l14, l7, lag1) AS lag14, CASE WHEN t >= 7 THEN r7 ELSE lag1 END AS roll7,
  CASE WHEN t >= 28 THEN r28 WHEN t >= 7 THEN r7 ELSE lag1 END AS roll28 FROM l
""", "revenue:2 lag1:2 lag7:2 lag14:2 roll7:4 roll28:4")
def w1(spark, d):
    return S.lag_features(S.daily_series(successful(spark, d, "sales", "order_time")))


@register("W3_seasonal_baseline", f"""
WITH {_SERIES}, l AS (SELECT *, lag(revenue, 7) OVER w AS a, lag(revenue, 14) OVER w AS b,
    lag(revenue, 21) OVER w AS c, lag(revenue, 28) OVER w AS e,
    avg(revenue) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r7
    FROM series WINDOW w AS (ORDER BY day))
SELECT strftime(day, '%Y-%m-%d') AS day, revenue, t, CASE WHEN a IS NULL THEN coalesce(r7, 0)
  ELSE (a + coalesce(b, 0) + coalesce(c, 0) + coalesce(e, 0))
    / (1 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (e IS NOT NULL)::INT) END AS baseline FROM l
""", "revenue:2 baseline:4")
def w3(spark, d):
    return S.seasonal_baseline(S.daily_series(successful(spark, d, "sales", "order_time")))


@register("M2_E3_model_features", f"""
WITH {_SERIES}, l AS (SELECT *, lag(revenue, 1) OVER w AS l1, lag(revenue, 7) OVER w AS l7,
    lag(revenue, 14) OVER w AS l14, avg(revenue) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r7,
    avg(revenue) OVER (ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS r28
    FROM series WINDOW w AS (ORDER BY day))
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(t AS DOUBLE) AS t, revenue, ln(1 + revenue) AS label,
  ln(1 + l1) AS lag1, ln(1 + l7) AS lag7, ln(1 + l14) AS lag14, ln(1 + r7) AS roll7, ln(1 + r28) AS roll28,
  sin(2 * pi() * (isodow(day) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(day) - 1) / 7) AS dow_cos,
  CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  sin(2 * pi() * month(day) / 12) AS month_sin, cos(2 * pi() * month(day) / 12) AS month_cos
FROM l WHERE t >= 28
""", "t:0 revenue:2 label:8 lag1:8 lag7:8 lag14:8 roll7:8 roll28:8 dow_sin:8 dow_cos:8 is_weekend:0 "
     "month_sin:8 month_cos:8")
def m2(spark, d):
    return S.model_features(S.daily_series(successful(spark, d, "sales", "order_time")))


_CMP = """sum(sales) FILTER (year(order_time) = 2000) AS g1, count(*) FILTER (year(order_time) = 2000) AS o1,
  sum(sales) FILTER (year(order_time) = 1999) AS g0, count(*) FILTER (year(order_time) = 1999) AS o0"""


@register("W2_period_over_period", f"""
WITH t AS (SELECT country, {_CMP} FROM ok WHERE year(order_time) IN (1999, 2000) GROUP BY 1)
SELECT country, coalesce(g1, 0) AS gmv, o1 AS orders, coalesce(g0, 0) AS previous_gmv, o0 AS previous_orders,
  coalesce(g1, 0) - coalesce(g0, 0) AS change, (coalesce(g1, 0) - coalesce(g0, 0)) / nullif(g0, 0) AS change_pct
FROM t
""", "gmv:2 previous_gmv:2 change:2 change_pct:8")
def w2(spark, d):
    return S.compare_periods(successful(spark, d, "order_id", "sales", "country", "order_time"),
                             NOW, BEFORE, "country")


@register("W2_L1_top_movers", f"""
WITH t AS (SELECT operator, {_CMP} FROM ok WHERE year(order_time) IN (1999, 2000) AND operator IS NOT NULL
  GROUP BY 1), u AS (SELECT operator, coalesce(g1, 0) AS gmv, o1 AS orders, coalesce(g0, 0) AS previous_gmv,
  o0 AS previous_orders, coalesce(g1, 0) - coalesce(g0, 0) AS change FROM t WHERE greatest(o1, o0) >= 10)
SELECT *, change / nullif(previous_gmv, 0) AS change_pct, CASE WHEN change >= 0 THEN 'up' ELSE 'down' END AS direction
FROM u ORDER BY abs(change) DESC, operator LIMIT 10
""", "gmv:2 previous_gmv:2 change:2 change_pct:8")
def w2m(spark, d):
    return S.top_movers(successful(spark, d, "order_id", "sales", "operator", "order_time"), NOW, BEFORE,
                        "operator", 10, min_orders=10)


@register("W5_week_on_week", """
WITH t AS (SELECT operator, CAST(date_trunc('week', order_time) AS DATE) AS week, count(*) AS orders FROM ok
           WHERE operator IS NOT NULL GROUP BY 1, 2),
  l AS (SELECT *, lag(orders) OVER (PARTITION BY operator ORDER BY week) AS p,
    avg(orders) OVER (PARTITION BY operator ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS avg4 FROM t)
SELECT operator, strftime(week, '%Y-%m-%d') AS week, orders,
  CASE WHEN p > 0 THEN (orders - p) / p * 100.0 END AS wow_pct, avg4 FROM l
""", "wow_pct:6 avg4:6")
def w5(spark, d):
    f = successful(spark, d, "order_id", "operator", "order_time").filter("operator IS NOT NULL")
    return S.week_on_week(f, "operator")


@register("W6_pareto_by_operator", """
WITH t AS (SELECT operator, sum(sales) AS gmv FROM ok WHERE operator IS NOT NULL GROUP BY 1)
SELECT operator, gmv, rank() OVER (ORDER BY gmv DESC) AS rank, gmv / (SELECT sum(gmv) FROM t) AS share,
  sum(gmv) OVER (ORDER BY gmv DESC) / (SELECT sum(gmv) FROM t) AS cumulative_share FROM t
""", "gmv:2 share:8 cumulative_share:8")
def w6(spark, d):
    f = successful(spark, d, "sales", "operator").filter("operator IS NOT NULL")
    return pareto(f.groupBy("operator").agg(gmv().alias("gmv")), "gmv")


@register("W12_rank_within_region", """
WITH t AS (SELECT region, country, sum(sales) AS gmv FROM ok GROUP BY 1, 2)
SELECT region, country, gmv, rank() OVER (PARTITION BY region ORDER BY gmv DESC) AS rank,
  gmv / sum(gmv) OVER (PARTITION BY region) AS share,
  sum(gmv) OVER (PARTITION BY region ORDER BY gmv DESC) / sum(gmv) OVER (PARTITION BY region) AS cumulative_share
FROM t
""", "gmv:2 share:8 cumulative_share:8")
def w12(spark, d):
    f = successful(spark, d, "sales", "country", "region")
    return pareto(f.groupBy("region", "country").agg(gmv().alias("gmv")), "gmv", ["region"])


@register("W6_W12_rank_with_gaps", """
WITH t AS (SELECT CASE WHEN region <> 'Africa' THEN region END AS region, country,
    CASE WHEN min(okey) % 3 > 0 THEN sum(sales) END AS gmv FROM ok GROUP BY 1, 2)
SELECT region, country, gmv, rank() OVER (PARTITION BY region ORDER BY gmv DESC) AS rank,
  gmv / sum(gmv) OVER (PARTITION BY region) AS share,
  sum(gmv) OVER (PARTITION BY region ORDER BY gmv DESC) / sum(gmv) OVER (PARTITION BY region) AS cumulative_share
FROM t
""", "gmv:2 share:8 cumulative_share:8")
def w6_gaps(spark, d):
    """Rows without a key or a measure keep their place."""
    f = successful(spark, d, "order_id", "sales", "country", "region")
    cells = f.groupBy(F.when(F.col("region") != "Africa", F.col("region")).alias("region"), "country").agg(
        F.when(F.min(F.col("order_id").cast("bigint")) % 3 > 0, gmv()).alias("gmv"))
    return pareto(cells, "gmv", ["region"])


@register("W8_weekly_rolling", """
WITH t AS (SELECT CAST(date_trunc('week', order_time) AS DATE) AS week, sum(sales) AS gmv FROM ok GROUP BY 1)
SELECT strftime(week, '%Y-%m-%d') AS week, gmv,
  avg(gmv) OVER (ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rolling FROM t
""", "gmv:2 rolling:4")
def w8(spark, d):
    return S.weekly_rolling(successful(spark, d, "sales", "order_time"))


@register("W9_day_over_day", """
WITH t AS (SELECT day, sum(sales) AS gmv FROM ok GROUP BY 1),
  l AS (SELECT *, lag(gmv) OVER (ORDER BY day) AS previous FROM t)
SELECT strftime(day, '%Y-%m-%d') AS day, gmv, previous, (gmv - previous) / nullif(previous, 0) AS change_pct FROM l
""", "gmv:2 previous:2 change_pct:8")
def w9(spark, d):
    return S.day_over_day(successful(spark, d, "sales", "order_time"))


@register("W10_anomaly_signals", """
WITH t AS (SELECT country, sum(CASE WHEN day BETWEEN DATE '2001-07-25' AND DATE '2001-07-31' THEN sales ELSE 0 END) / 7 AS recent,
    sum(CASE WHEN day BETWEEN DATE '2001-06-27' AND DATE '2001-07-24' THEN sales ELSE 0 END) / 28 AS baseline
  FROM ok WHERE day BETWEEN DATE '2001-06-27' AND DATE '2001-07-31' GROUP BY 1)
SELECT country, recent, baseline, (recent - baseline) / nullif(baseline, 0) AS change,
  CASE WHEN abs((recent - baseline) / nullif(baseline, 0)) > 0.3 THEN 1 ELSE 0 END::BIGINT AS anomaly FROM t
""", "recent:4 baseline:4 change:8")
def w10(spark, d):
    return S.anomaly_signals(successful(spark, d, "sales", "country", "order_time"), date(2001, 7, 31),
                             "country")


@register("W11_aligned_periods", """
SELECT CASE WHEN year(order_time) = 1999 THEN day - DATE '1999-01-01' ELSE day - DATE '2000-01-01' END AS day_of_period,
  sum(CASE WHEN year(order_time) = 1999 THEN sales ELSE 0 END) AS gmv_a,
  sum(CASE WHEN year(order_time) = 2000 THEN sales ELSE 0 END) AS gmv_b
FROM ok WHERE year(order_time) IN (1999, 2000) GROUP BY 1
""", "gmv_a:2 gmv_b:2")
def w11(spark, d):
    return S.aligned_periods(successful(spark, d, "sales", "order_time"), BEFORE, NOW)


@register("W13_month_pace", """
WITH t AS (SELECT max(day) AS a FROM ok), m AS (SELECT sum(sales) AS s FROM ok, t
  WHERE date_trunc('month', day) = date_trunc('month', a))
SELECT strftime(a, '%Y-%m-%d') AS as_of, s AS month_to_date, s / dayofmonth(a) * dayofmonth(last_day(a)) AS projection
FROM t, m
""", "month_to_date:2 projection:2")
def w13(spark, d):
    return S.month_pace(successful(spark, d, "sales", "order_time"))


# --- demand ----------------------------------------------------------------

_WEEKS = """wk AS (SELECT coalesce(operator, 'Unknown') AS operator, coalesce(product, denomination, 'Unknown') AS pg,
    CAST(date_trunc('week', order_time) AS DATE) AS week, order_time FROM ok),
  lim AS (SELECT max(week) AS last, max(order_time) AS latest, count(DISTINCT week) AS n FROM wk),
  kept AS (SELECT operator, pg, week, count(*) AS orders FROM wk, lim
    WHERE NOT (n >= 3 AND latest < CAST(last AS TIMESTAMP) + INTERVAL 156 HOUR AND week = last) GROUP BY 1, 2, 3)"""

_HISTORY = f"""{_WEEKS},
  best AS (SELECT operator, pg FROM kept GROUP BY 1, 2 ORDER BY sum(orders) DESC, 1, 2 LIMIT 60),
  cw AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS t FROM (SELECT DISTINCT week FROM kept
         ORDER BY week DESC LIMIT 12)),
  h AS (SELECT b.operator, b.pg, t, cw.week, CAST(coalesce(orders, 0) AS DOUBLE) AS y
        FROM best b CROSS JOIN cw LEFT JOIN kept k ON k.operator = b.operator AND k.pg = b.pg AND k.week = cw.week)"""


@register("M11_weekly_demand", f"""
WITH {_WEEKS} SELECT operator, pg AS product_group, strftime(week, '%Y-%m-%d') AS week, orders FROM kept
""")
def m11(spark, d):
    return DM.weekly_demand(successful(spark, d, "operator", "product", "denomination", "order_time"))


@register("M11_L2_demand_history", f"""
WITH {_HISTORY} SELECT operator, pg AS product_group, t, strftime(week, '%Y-%m-%d') AS week, y AS orders FROM h
""", "orders:0")
def m11h(spark, d):
    return DM.demand_history(successful(spark, d, "operator", "product", "denomination", "order_time"))


_WK = ",\n".join(f"""  round_even(greatest(0, a + b * ({i} + 11)), 0) AS wk{i}_forecast,
  round_even(greatest(0, greatest(0, a + b * ({i} + 11)) - 1.64 * sd), 0) AS wk{i}_low,
  round_even(greatest(0, a + b * ({i} + 11)) + 1.64 * sd, 0) AS wk{i}_high""" for i in (1, 2, 3, 4))


@register("M12_demand_forecast", f"""
WITH {_HISTORY}, f AS (SELECT operator, pg, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM h GROUP BY 1, 2),
  r AS (SELECT f.operator, f.pg, any_value(a) AS a, any_value(b) AS b, stddev_pop(y - (a + b * t)) AS sd,
    avg(y) FILTER (t >= 8) AS avg4, max(y) FILTER (t = 11) AS last, max(y) FILTER (t = 10) AS prev
    FROM h JOIN f ON f.operator = h.operator AND f.pg = h.pg GROUP BY 1, 2)
SELECT operator, pg AS product_group, round_even(avg4, 1) AS avg4,
  CASE WHEN prev > 0 THEN round_even((last - prev) / prev * 100, 0) END AS wow_pct,
  CASE WHEN b > avg4 * 0.02 THEN 'up' WHEN b < -avg4 * 0.02 THEN 'down' ELSE 'flat' END AS trend,
{_WK} FROM r
""", "avg4:1 wow_pct:0 " + " ".join(f"wk{i}_{k}:0" for i in (1, 2, 3, 4) for k in ("forecast", "low", "high")))
def m12(spark, d):
    return DM.forecast_demand(successful(spark, d, "operator", "product", "denomination", "order_time"))


# --- scalar expressions ----------------------------------------------------

@register("E1_E2_E4_scalar_expressions", """
SELECT CASE WHEN okey % 4 = 0 THEN NULL ELSE okey % 1000 + 0.5 END AS number, left('label ' || (okey % 5), 40) AS label,
  ym AS month, strftime(date_trunc('week', order_time), '%Y-%m-%d') AS week, isodow(order_time) - 1 AS weekday,
  hour(order_time) AS hour, strftime(last_day(day), '%Y-%m-%d') AS month_end,
  datediff('day', CAST(register_time AS DATE), day) AS age_days, coalesce(operator, brand, 'none') AS named,
  count(*) AS orders, round_even(avg(CAST(o8 AS DOUBLE)), 0) AS half_even
FROM (SELECT *, okey % 8 + 0.5 AS o8 FROM fact) GROUP BY ALL
""", "number:1 half_even:0")
def e1(spark, d):
    f = orders_fact(spark, d, "order_id", "segment", "order_time", "register_time", "operator", "brand")
    key, t = F.col("order_id").cast("bigint"), F.col("order_time")
    text = F.when(key % 4 != 0, F.concat(F.lit(" "), F.format_number((key % 1000).cast("double"), 0), F.lit(".5 ")))
    label = F.substring(E.strip_ws(F.concat(F.lit("\tlabel "), (key % 5).cast("string"))), 1, 40)
    return f.groupBy(
        E.to_number(text).alias("number"), label.alias("label"), E.month_text(t).alias("month"),
        F.date_trunc("week", t).cast("date").alias("week"), F.weekday(t).alias("weekday"), F.hour(t).alias("hour"),
        F.last_day(t).alias("month_end"), F.datediff(F.to_date(t), F.to_date("register_time")).alias("age_days"),
        F.coalesce("operator", "brand", F.lit("none")).alias("named")).agg(
        orders(f).alias("orders"), F.bround(F.avg((key % 8) + 0.5), 0).alias("half_even"))
