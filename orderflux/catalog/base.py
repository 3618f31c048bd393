"""Registration of queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflux.functions import values as V
from orderflux.functions.dimensions import fx_snapshot
from orderflux.operators import fx
from orderflux.sources.orders import NATION_ROWS, nations, orders_fact, successful, table

REGISTRY: dict[str, "Query"] = {}


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    digits: dict[str, int] = field(default_factory=dict)


def register(name: str, sql: str | None = None, digits: str = ""):
    """Register a query. ``digits`` like ``"gmv:2 aov:6"`` rounds once, on both sides."""
    places = {p.split(":")[0].strip('"'): int(p.split(":")[1]) for p in digits.split()}

    def wrap(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(fn, sql, places)
        return fn

    return wrap


def spark_callable(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(query.run(spark, sf_dir), query.digits)

    return run


def present(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Uniform output types: rounded doubles, bigint counts, text dates."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in digits:
            c = F.round(c.cast("double"), digits[f.name])
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def oracle(query: Query) -> str | None:
    if query.sql is None:
        return None
    body = query.sql.strip()
    if query.digits:
        rounded = ", ".join(f'round(CAST("{c}" AS DOUBLE), {n}) AS "{c}"' for c, n in query.digits.items())
        body = f"SELECT * REPLACE ({rounded}) FROM ({body}) q"
    else:
        body = f"SELECT * FROM ({body}) q"
    return f"WITH {FACT_SQL} {body}"


# --- the fact in SQL -------------------------------------------------------

_SNAPSHOT = {iso: rate for _, _, iso, rate in V.SNAPSHOT_RATES}


def _text(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_NATION_VALUES = ",\n".join(
    f"({k}, {_text(raw)}, {_text(c)}, {_text(r)}, {_text(iso)}, {_text(code)}, "
    f"CAST({_SNAPSHOT.get(iso, 'NULL')} AS DOUBLE))" for k, raw, c, r, iso, code in NATION_ROWS)

FACT_SQL = f"""
nat(nation_key, raw_country, country, region, settlement_iso, area_code, snapshot) AS (VALUES
{_NATION_VALUES}),
base AS (
  SELECT *, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS ot,
         floor(o_totalprice * 1.05::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS listed
  FROM orders),
firsts AS (SELECT o_custkey AS ck, min(ot) AS first_time FROM base GROUP BY o_custkey),
lines AS (SELECT l_orderkey AS lk, min(l_suppkey) AS sk, min(l_partkey) AS pk
          FROM lineitem GROUP BY l_orderkey),
fact AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderkey AS okey, o_custkey AS ckey,
    CASE WHEN o_custkey % 3 = 0 THEN 'B2B' ELSE 'B2C' END AS segment,
    CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS user_id,
    CASE WHEN o_custkey % 3 = 0 THEN c_name END AS agent_name,
    ot AS order_time, first_time - to_days(CAST(o_custkey % 45 AS INTEGER)) AS register_time,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS sales_paid, listed AS sales_listed,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice ELSE listed END AS sales,
    floor(o_totalprice * (0.8::DOUBLE + (o_orderkey % 20) / 100.0::DOUBLE)
          * (1.0::DOUBLE + c_nationkey * 0.1::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE)
      / 100.0::DOUBLE AS settlement_price,
    cn.settlement_iso, cn.raw_country, cn.country, cn.region, cn.snapshot,
    CASE WHEN o_orderkey % 100 < 91 THEN '充值成功' WHEN o_orderkey % 100 < 98 THEN '已退款'
         WHEN o_orderkey % 500 < 499 THEN '已取消' ELSE '等待支付' END AS order_status,
    CASE WHEN o_orderkey % 100 < 91 THEN 'Successful' WHEN o_orderkey % 100 < 98 THEN 'Refunded'
         WHEN o_orderkey % 500 < 499 THEN 'Cancelled' ELSE 'Pending' END AS status_group,
    o_orderpriority = '1-URGENT' AS coupon_used,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'CAMP' || (o_custkey % 5) END AS coupon_name,
    CASE WHEN o_orderpriority = '1-URGENT'
         THEN floor(o_totalprice * 0.05::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE
         ELSE 0.0::DOUBLE END AS coupon_amount,
    o_orderpriority = '2-HIGH' AS new_user_promo,
    CAST(o_custkey * 7 + o_orderkey % 6 AS VARCHAR) AS recharge_number,
    CASE WHEN o_orderkey % 9 = 0 THEN '--' ELSE 'S' || o_orderkey END AS interface_order_id,
    '10.' || (o_custkey % 4) || '.' || (o_orderkey % 256) || '.' || (o_custkey % 256) AS ip_address,
    CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'P' || o_orderkey END AS pin_code,
    CASE WHEN o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN 'U' || o_orderkey END AS gateway_order_id,
    CASE WHEN o_orderkey % 11 <> 0
         THEN CASE WHEN o_orderkey % 8 = 0 THEN 'Malaysia' ELSE cn.country END END AS ip_country,
    c_mktsegment AS user_source, s_name AS operator, dn.area_code, dn.country AS dest_country,
    p_name AS product, p_brand AS brand, coalesce(p_brand = 'Brand#1', false) AS badge_product,
    CAST(p_size AS VARCHAR) AS denomination,
    CASE WHEN p_partkey % 50 = 0 THEN '充流量-测试' WHEN p_type = 'ECONOMY' THEN '充话费'
         WHEN p_type = 'LARGE' THEN '买流量' WHEN p_type = 'MEDIUM' THEN 'Touch''n Go'
         WHEN p_type = 'PROMO' THEN '电子钱包' WHEN p_type = 'SMALL' THEN '交电费'
         WHEN p_type = 'STANDARD' THEN '后付费' END AS product_category,
    CASE WHEN p_partkey % 50 = 0 THEN '其他' WHEN p_type = 'ECONOMY' THEN '话费充值'
         WHEN p_type = 'LARGE' THEN '流量套餐' WHEN p_type = 'MEDIUM' THEN '电子钱包/PIN'
         WHEN p_type = 'PROMO' THEN '电子钱包' WHEN p_type = 'SMALL' THEN '账单缴费'
         WHEN p_type = 'STANDARD' THEN '后付费' ELSE '其他' END AS category_class,
    CASE WHEN p_type <> 'LARGE' THEN 'RM ' || p_size WHEN p_size = 50 THEN '不限量，30天'
         WHEN p_partkey % 7 = 0 THEN '3.5G，30天' WHEN p_partkey % 11 = 0 THEN p_size || '00MB'
         WHEN p_partkey IS NOT NULL THEN p_size || 'GB，28天' END AS sku_name,
    CASE WHEN p_type <> 'LARGE' THEN NULL WHEN p_size = 50 THEN 1048576.0::DOUBLE
         WHEN p_partkey % 7 = 0 THEN 3584.0::DOUBLE WHEN p_partkey % 11 = 0 THEN p_size * 100.0::DOUBLE
         ELSE p_size * 1024.0::DOUBLE END AS volume_mb,
    CASE WHEN dn.area_code IS NULL OR dn.area_code = 'x' THEN 'Unknown'
         WHEN dn.area_code = '999' THEN '+999' WHEN dn.area_code = '1' THEN 'USA/Canada'
         WHEN dn.area_code = '7' THEN 'Russia/Kazakhstan' WHEN dn.area_code = '243' THEN 'DR Congo'
         ELSE dn.country END AS mapped_destination,
    strftime(ot, '%Y-%m') AS ym, CAST(date_trunc('month', ot) AS DATE) AS mon, CAST(ot AS DATE) AS day
  FROM base
  LEFT JOIN firsts ON ck = o_custkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nat cn ON cn.nation_key = c_nationkey
  LEFT JOIN lines ON lk = o_orderkey
  LEFT JOIN supplier ON s_suppkey = sk
  LEFT JOIN nat dn ON dn.nation_key = s_nationkey
  LEFT JOIN part ON p_partkey = pk),
ok AS (SELECT *, CASE WHEN lk_dest IS NULL THEN 'Unknown' ELSE lk_dest END AS destination
       FROM (SELECT *, mapped_destination AS lk_dest FROM fact) WHERE status_group = 'Successful'),
rates AS (
  SELECT DISTINCT settlement_iso AS iso, y || '-06' AS month,
         snapshot * (1.0::DOUBLE + (y - 1995) * 0.01::DOUBLE) AS rate
  FROM nation JOIN nat ON nation_key = n_nationkey, range(1996, 2002) r(y)
  WHERE n_nationkey % 5 <> 4 AND snapshot IS NOT NULL),
spans AS (SELECT iso, month, lead(month) OVER (PARTITION BY iso ORDER BY month) AS nxt, rate FROM rates),
cost AS (
  SELECT fact.*, coalesce(s.rate, snapshot) AS fx_rate,
         settlement_price / coalesce(nullif(coalesce(s.rate, snapshot), 0), 1) AS settlement_rmb
  FROM fact LEFT JOIN spans s
    ON s.iso = settlement_iso AND ym >= s.month AND (s.nxt IS NULL OR ym < s.nxt)),
okcost AS (SELECT * FROM cost WHERE status_group = 'Successful'),
userlist AS (
  SELECT c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '.0' ELSE '' END AS list_id,
    CAST(c_custkey AS VARCHAR) AS user_id,
    coalesce(first_time - to_days(CAST(c_custkey % 45 AS INTEGER)),
             TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2000 AS INTEGER))) AS register_time,
    CASE WHEN c_custkey % 6 <> 1 THEN country END AS source_country,
    CASE WHEN c_custkey % 5 = 0 THEN '支付宝小程序' ELSE '微信小程序' END AS member_source,
    c_mktsegment AS user_source
  FROM customer LEFT JOIN firsts ON ck = c_custkey LEFT JOIN nat ON nation_key = c_nationkey
  WHERE c_custkey % 3 <> 0)
"""


# --- inputs in Spark -------------------------------------------------------

def dated_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated rates of four nations in five, each June from 1996 to 2001."""
    base = fx_snapshot(spark).groupBy("iso").agg(F.max("rate").alias("snapshot"))
    rows = (table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 4")
            .join(nations(spark), F.col("n_nationkey") == F.col("nation_key"))
            .join(base, F.col("settlement_iso") == F.col("iso"))
            .withColumn("y", F.explode(F.sequence(F.lit(1996), F.lit(2001)))))
    return rows.select(
        "iso", F.lit(None).cast("string").alias("country"),
        F.concat(F.col("y").cast("string"), F.lit("-06")).alias("month"),
        (F.col("snapshot") * (1.0 + (F.col("y") - 1995) * 0.01)).alias("rate")).distinct()


def fact(*columns: str):
    return lambda spark, d: orders_fact(spark, d, *columns)


def ok(*columns: str):
    return lambda spark, d: successful(spark, d, *columns)


def costed(spark: SparkSession, sf_dir: str, *columns: str, every_status: bool = False) -> DataFrame:
    need = ("order_time", "settlement_iso", "settlement_price", *columns)
    df = orders_fact(spark, sf_dir, *need) if every_status else successful(spark, sf_dir, *need)
    return fx.settlement_in_rmb(df, dated_rates(spark, sf_dir))
