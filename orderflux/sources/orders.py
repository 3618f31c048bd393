"""The canonical order fact built from the TPC-H-like tables.

Only the joins that the requested columns need are planned, so a metric on order columns
reads one table and shuffles nothing but its own keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux.functions import expressions as E
from orderflux.functions.dimensions import local_table
from orderflux.functions.measures import mark_unique

# nation key -> raw market name, currency, calling code. Raw names are mixed Chinese and
# English as in the exports; '999', 'x' and NULL exercise the unmapped codes.
NATION_ROWS = [
    (0, "埃及", "Egypt", "Africa", "EGP", "20"),
    (1, "美国", "United States", "Americas", "USD", "1"),
    (2, "马来西亚", "Malaysia", "Asia", "MYR", "60"),
    (3, "英国", "United Kingdom", "Europe", "GBP", "44.0"),
    (4, "阿联酋", "United Arab Emirates", "Middle East", "AED", "971"),
    (5, "Morocco", "Morocco", "Africa", "MAD", "212"),
    (6, "巴西", "Brazil", "Americas", "BRL", "55"),
    (7, "印尼", "Indonesia", "Asia", "IDR", "62"),
    (8, "法国", "France", "Europe", "EUR", "33"),
    (9, "沙特", "Saudi Arabia", "Middle East", "SAR", "966"),
    (10, "刚果(金)", "Democratic Republic of the Congo", "Africa", "CDF", "243"),
    (11, "加拿大", "Canada", "Americas", "CAD", "1"),
    (12, "中国香港", "Hong Kong", "Asia", "HKD", "852"),
    (13, "俄罗斯", "Russia", "Europe", "RUB", "7"),
    (14, "伊拉克", "Iraq", "Middle East", "IQD", "964"),
    (15, "科特迪瓦", "Côte d'Ivoire", "Africa", "XOF", "225"),
    (16, "墨西哥", "Mexico", "Americas", "MXN", "52"),
    (17, "中国", "China", "Asia", "CNY", "86"),
    (18, "德国", "Germany", "Europe", "EUR", "49"),
    (19, "土耳其", "Turkey", "Middle East", "TRY", "90"),
    (20, "尼日利亚", "Nigeria", "Africa", "NGN", "234"),
    (21, "Atlantis", "Atlantis", "Other", "XXX", "999"),
    (22, "澳洲", "Australia", "Oceania", "AUD", "x"),
    (23, "新西兰", "New Zealand", "Oceania", "NZD", None),
    (24, "哈萨克斯坦", "Kazakhstan", "Asia", "KZT", "7"),
]

_CATEGORY = {"ECONOMY": "充话费", "LARGE": "买流量", "MEDIUM": "Touch'n Go", "PROMO": "电子钱包",
             "SMALL": "交电费", "STANDARD": "后付费"}

ORDER_COLUMNS = {
    "order_id", "segment", "user_id", "cust_key", "order_time", "sales_paid", "sales_listed", "sales",
    "order_status", "coupon_used", "coupon_name", "coupon_amount", "new_user_promo",
    "recharge_number", "interface_order_id", "ip_address", "pin_code", "gateway_order_id",
}
CUSTOMER_COLUMNS = {"agent_name", "raw_country", "country", "region", "user_source",
                    "settlement_iso", "settlement_price", "ip_country"}
SUPPLIER_COLUMNS = {"operator"}
DESTINATION_COLUMNS = {"area_code", "dest_country"}
PART_COLUMNS = {"product", "brand", "product_category", "sku_name", "denomination", "badge_product"}
LINE_COLUMNS = SUPPLIER_COLUMNS | DESTINATION_COLUMNS | PART_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    """Amount to whole cents with plain float steps, identical in any engine."""
    return F.floor(c * 100.0 + 0.5) / 100.0


def nations(spark: SparkSession) -> DataFrame:
    return local_table(
        spark,
        "nation_key int, raw_country string, country string, region string, "
        "settlement_iso string, area_code string", NATION_ROWS)


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    b2b = cust % 3 == 0
    status = (F.when(key % 100 < 91, "充值成功").when(key % 100 < 98, "已退款")
              .when(key % 500 < 499, "已取消").otherwise("等待支付"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    time = (F.col("o_orderdate").cast("timestamp")
            + F.make_dt_interval(F.lit(0), (key % 24).cast("int")))
    return o.select(
        key.cast("string").alias("order_id"),
        key.alias("_order_key"), cust.alias("cust_key"), price.alias("_price"),
        F.when(b2b, "B2B").otherwise("B2C").alias("segment"),
        F.when(~b2b, cust.cast("string")).alias("user_id"),
        time.alias("order_time"),
        F.when(key % 10 != 0, price).alias("sales_paid"),
        cents(price * 1.05).alias("sales_listed"),
        F.coalesce(F.when(key % 10 != 0, price), cents(price * 1.05)).alias("sales"),
        status.alias("order_status"),
        urgent.alias("coupon_used"),
        F.when(urgent, F.concat(F.lit("CAMP"), (cust % 5).cast("string"))).alias("coupon_name"),
        F.when(urgent, cents(price * 0.05)).otherwise(F.lit(0.0)).alias("coupon_amount"),
        (F.col("o_orderpriority") == "2-HIGH").alias("new_user_promo"),
        (cust * 7 + key % 6).cast("string").alias("recharge_number"),
        F.when(key % 9 == 0, "--").otherwise(F.concat(F.lit("S"), key.cast("string")))
        .alias("interface_order_id"),
        F.concat_ws(".", F.lit("10"), (cust % 4).cast("string"), (key % 256).cast("string"),
                    (cust % 256).cast("string")).alias("ip_address"),
        F.when(b2b & (key % 4 == 0), F.concat(F.lit("P"), key.cast("string"))).alias("pin_code"),
        F.when(~b2b & (key % 5 != 0), F.concat(F.lit("U"), key.cast("string")))
        .alias("gateway_order_id"),
    )


def _with_registration(orders: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """register_time = first order of the customer minus ``cust_key % 45`` days."""
    first = (_order_rows(spark, sf_dir).groupBy(F.col("cust_key").alias("_ck"))
             .agg(F.min("order_time").alias("_first")))
    shift = F.make_dt_interval((F.col("cust_key") % 45).cast("int"))
    return (orders.join(first, F.col("cust_key") == F.col("_ck"), "left")
            .withColumn("register_time", F.col("_first") - shift).drop("_ck", "_first"))


def _with_customer(orders: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_cust"), "c_name", "c_nationkey", "c_mktsegment")
    key, nation = F.col("_order_key"), F.col("c_nationkey")
    local = cents(F.col("_price") * (0.80 + (key % 20) / 100.0) * (1.0 + nation * 0.1))
    ip_country = F.when(key % 8 == 0, "Malaysia").otherwise(F.col("country"))
    return (
        orders.join(c, F.col("cust_key") == F.col("_cust"), "left")
        .join(nations(spark).drop("area_code"), F.col("c_nationkey") == F.col("nation_key"), "left")
        .withColumns({
            "agent_name": F.when(F.col("segment") == "B2B", F.col("c_name")),
            "user_source": F.col("c_mktsegment"),
            "settlement_price": local,
            "ip_country": F.when(key % 11 != 0, ip_country),
        })
        .drop("_cust", "c_name", "c_nationkey", "c_mktsegment", "nation_key")
    )


def _with_lines(orders: DataFrame, spark: SparkSession, sf_dir: str, wanted: set) -> DataFrame:
    lines = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_lk"))
             .agg(F.min("l_suppkey").alias("_sk"), F.min("l_partkey").alias("_pk")))
    df = orders.join(lines, F.col("_order_key") == F.col("_lk"), "left")
    if wanted & (SUPPLIER_COLUMNS | DESTINATION_COLUMNS):
        s = table(spark, sf_dir, "supplier").select(
            "s_suppkey", F.col("s_name").alias("operator"), "s_nationkey")
        df = df.join(s, F.col("_sk") == F.col("s_suppkey"), "left")
    if wanted & DESTINATION_COLUMNS:
        dest = nations(spark).select("nation_key", "area_code", F.col("country").alias("dest_country"))
        df = df.join(dest, F.col("s_nationkey") == F.col("nation_key"), "left")
    if wanted & PART_COLUMNS:
        df = df.join(_parts(spark, sf_dir), F.col("_pk") == F.col("p_partkey"), "left")
        if "badge_product" in wanted:
            df = df.withColumn("badge_product",
                               F.coalesce(F.col("brand") == "Brand#1", F.lit(False)))
    return df


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, part = F.col("p_size").cast("string"), F.col("p_partkey")
    category = reduce(lambda w, kv: w.when(F.col("p_type") == kv[0], kv[1]), _CATEGORY.items(),
                      F.when(part % 50 == 0, "充流量-测试"))
    sku = (F.when(F.col("p_type") != "LARGE", F.concat(F.lit("RM "), size))
           .when(F.col("p_size") == 50, "不限量，30天")
           .when(part % 7 == 0, "3.5G，30天")
           .when(part % 11 == 0, F.concat(size, F.lit("00MB")))
           .otherwise(F.concat(size, F.lit("GB，28天"))))
    return table(spark, sf_dir, "part").select(
        part, F.col("p_name").alias("product"), F.col("p_brand").alias("brand"),
        category.alias("product_category"), sku.alias("sku_name"), size.alias("denomination"))


def orders_fact(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The fact with the requested columns (``order_status`` always comes along)."""
    wanted = list(dict.fromkeys([*columns, "order_status"]))
    df = _order_rows(spark, sf_dir)
    if "register_time" in wanted:
        df = _with_registration(df, spark, sf_dir)
    if CUSTOMER_COLUMNS & set(wanted):
        df = _with_customer(df, spark, sf_dir)
    if LINE_COLUMNS & set(wanted):
        df = _with_lines(df, spark, sf_dir, set(wanted))
    # The primary key of the source table; every join above is with a table of one row per key.
    return mark_unique(df.select(*wanted)) if "order_id" in wanted else df.select(*wanted)


def successful(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return orders_fact(spark, sf_dir, *columns).filter(E.is_successful())


def user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered B2C users: id, register_time, source_country, member_source.

    Ids carry the spreadsheet's ``.0`` on every fourth row; every sixth user has no source
    country and every fifth comes through Alipay.
    """
    seen = (orders_fact(spark, sf_dir, "cust_key", "order_time", "segment")
            .filter("segment = 'B2C'").groupBy("cust_key").agg(F.min("order_time").alias("first")))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0")
    key = F.col("c_custkey")
    start = F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval((key % 2000).cast("int"))
    joined = (c.join(seen, key == F.col("cust_key"), "left")
              .join(nations(spark), F.col("c_nationkey") == F.col("nation_key"), "left"))
    registered = F.coalesce(F.col("first") - F.make_dt_interval((key % 45).cast("int")), start)
    return joined.select(
        F.concat(key.cast("string"), F.when(key % 4 == 0, ".0").otherwise("")).alias("user_list_id"),
        registered.alias("register_time"),
        F.when(key % 6 != 1, F.col("country")).alias("source_country"),
        F.when(key % 5 == 0, "支付宝小程序").otherwise("微信小程序").alias("member_source"),
        F.col("c_mktsegment").alias("user_source"),
    )
