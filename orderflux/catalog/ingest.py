"""Cleaning, quarantine, merge and digest queries on rows derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux.catalog.base import register
from orderflux.operators import merge as M
from orderflux.operators.cleaning import clean, split_at_import
from orderflux.sources.orders import orders_fact, table
from orderflux.streaming.digest import exception_digest
from orderflux.streaming.ingest import daily_event_counts


def raw_export(spark: SparkSession, d: str) -> DataFrame:
    """The orders as four raw export files, all text.

    File 1 writes dates day-first; ids carry a TAB, amounts thousands commas; some amounts are negative or
    unreadable, some dates blank, some texts missing.
    """
    o = table(spark, d, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    stamp = F.col("o_orderdate").cast("timestamp")
    when = (F.when(k % 77 == 0, "  ").when(k % 4 == 1, F.date_format(stamp, "dd/MM/yyyy HH:mm:ss"))
            .otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")))
    amount = F.regexp_replace(F.format_number(F.floor(price), 0), "$", ".50")
    paid = (F.when(k % 50 == 0, F.concat(F.lit("-"), amount)).when(k % 51 == 0, "abc")
            .when(k % 52 != 0, F.concat(F.lit(" "), amount)))
    return o.select(
        F.concat(F.lit("\t"), k.cast("string")).alias("订单号"), when.alias("订单时间"), paid.alias("实际支付"),
        amount.alias("售价"), F.when(k % 5 != 0, F.lit(" 充值成功 ")).alias("订单状态"),
        F.when(k % 6 == 0, "  ").when(k % 6 != 1, "埃及").alias("国家"),
        F.when(k % 3 == 0, "CAMP").alias("优惠券名称"), F.when(k % 3 == 0, "1,000").alias("优惠券金额"),
        F.col("o_custkey").cast("string").alias("用户ID"),
        F.concat(F.lit("file"), (k % 4).cast("string")).alias("_file"))


_RAW = """raw AS (SELECT o_orderkey AS k, 'file' || (o_orderkey % 4) AS f,
    CASE WHEN o_orderkey % 77 <> 0 THEN o_orderdate END AS t, floor(o_totalprice) + 0.5::DOUBLE AS listed,
    CASE WHEN o_orderkey % 50 = 0 THEN -(floor(o_totalprice) + 0.5::DOUBLE) WHEN o_orderkey % 51 = 0 THEN NULL
         WHEN o_orderkey % 52 <> 0 THEN floor(o_totalprice) + 0.5::DOUBLE END AS paid, o_custkey AS c FROM orders),
  marked AS (SELECT *, coalesce(paid < 0, false) OR t IS NULL AS bad FROM raw)"""


@register("C1_C7_clean_rows", f"""
WITH {_RAW} SELECT CAST(k AS VARCHAR) AS order_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS order_time, paid, listed,
  CASE WHEN k % 5 <> 0 THEN '充值成功' ELSE 'Unknown' END AS status,
  CASE WHEN k % 6 = 0 THEN '' WHEN k % 6 <> 1 THEN '埃及' ELSE 'Unknown' END AS country,
  CASE WHEN k % 3 = 0 THEN 'CAMP' ELSE '' END AS coupon, CASE WHEN k % 3 = 0 THEN 1000.0 ELSE 0.0 END AS coupon_amount,
  CAST(c AS VARCHAR) AS user_id FROM marked WHERE NOT bad
""", "paid:2 listed:2 coupon_amount:2")
def c_rows(spark, d):
    good = clean(raw_export(spark, d), "master").good
    names = {"订单号": "order_id", "订单时间": "order_time", "实际支付": "paid", "售价": "listed", "订单状态": "status",
             "国家": "country", "优惠券名称": "coupon", "优惠券金额": "coupon_amount", "用户id": "user_id"}
    return good.select(*[F.col(c).alias(n) for c, n in names.items()])


@register("Q2_K5_quarantined_rows", f"""
WITH {_RAW} SELECT CAST(k AS VARCHAR) AS order_id, f AS file,
  CASE WHEN paid < 0 THEN 'negative amount' ELSE 'order time missing' END AS reason FROM marked WHERE bad
""")
def q2(spark, d):
    return clean(raw_export(spark, d), "master").quarantined.select(
        F.col("订单号").alias("order_id"), F.col("_file").alias("file"), "reason")


@register("C2_C3_C8_clean_report", f"""
WITH {_RAW} SELECT f AS file, count(*) AS rows_in, count(*) FILTER (NOT bad) AS rows_out,
  count(*) FILTER (bad) AS quarantined, strftime(min(t), '%Y-%m-%d') AS first_day,
  strftime(max(t), '%Y-%m-%d') AS last_day, CASE WHEN f = 'file1' THEN 1 ELSE 0 END::BIGINT AS day_first,
  CASE WHEN bool_and(dayofmonth(t) <= 12) THEN 1 ELSE 0 END::BIGINT AS ambiguous,
  count(*) FILTER (NOT bad AND k % 5 = 0) AS status_filled, count(*) FILTER (NOT bad AND k % 6 = 1) AS country_filled,
  count(*) FILTER (NOT bad AND k % 3 <> 0) AS coupon_filled FROM marked GROUP BY 1
""")
def c_report(spark, d):
    r = clean(raw_export(spark, d), "master").report
    return r.select("file", "rows_in", "rows_out", "quarantined",
                    F.to_date("订单时间_min").alias("first_day"), F.to_date("订单时间_max").alias("last_day"),
                    F.col("订单时间_day_first").alias("day_first"), F.col("订单时间_ambiguous").alias("ambiguous"),
                    F.col("订单状态_filled").alias("status_filled"), F.col("国家_filled").alias("country_filled"),
                    F.col("优惠券名称_filled").alias("coupon_filled"))


@register("C8_renamed_and_unreadable", f"""
WITH {_RAW} SELECT f AS file, '用户ID>用户id' AS renamed, '订单时间,售价,实际支付,优惠券金额' AS coerced,
  0::BIGINT AS time_unreadable, count(*) FILTER (k % 51 = 0 AND k % 50 <> 0) AS paid_unreadable,
  0::BIGINT AS listed_unreadable FROM raw GROUP BY 1
""")
def c8(spark, d):
    """Headings that got another name, columns read as dates or numbers, and texts that are neither, per file."""
    r = clean(raw_export(spark, d), "master").report
    return r.select("file", F.array_join(F.transform(F.map_entries("renamed"), lambda e: F.concat_ws(">", e["key"], e["value"])),
                                         ",").alias("renamed"),
                    F.array_join("coerced", ",").alias("coerced"), F.col("订单时间_unreadable").alias("time_unreadable"),
                    F.col("实际支付_unreadable").alias("paid_unreadable"),
                    F.col("售价_unreadable").alias("listed_unreadable"))


@register("Q1_import_split", f"""
WITH {_RAW} SELECT CASE WHEN coalesce(paid < 0, false) THEN 'negative amount' WHEN t IS NULL THEN 'order time missing'
  ELSE 'kept' END AS outcome, count(*) AS rows FROM raw GROUP BY 1
""")
def q1(spark, d):
    raw = raw_export(spark, d).withColumn("实际支付", F.replace("实际支付", F.lit(","), F.lit("")))
    raw = raw.withColumn("订单时间", F.regexp_replace("订单时间", r"^(\d\d)/(\d\d)/(\d{4})", "$3-$2-$1"))
    good, bad = split_at_import(raw)
    return good.select(F.lit("kept").alias("outcome")).unionByName(
        bad.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


# --- merge -----------------------------------------------------------------

def _store_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = orders_fact(spark, d, "order_id", "sales_paid", "order_time")
    k = F.col("订单号").cast("bigint")
    rows = f.select(F.col("order_id").alias("订单号"), F.col("order_status").alias("订单状态"),
                    F.col("sales_paid").alias("实际支付"), F.col("order_time").alias("订单时间"))
    existing = rows.filter(k % 3 < 2)
    changed = (rows.filter(k % 3 > 0)
               .withColumn("订单状态", F.when(k % 7 == 0, "已退款").otherwise(F.col("订单状态")))
               .withColumn("实际支付", F.when(k % 11 == 0, F.col("实际支付") + 1).otherwise(F.col("实际支付")))
               .withColumn("渠道", F.lit("new")))
    return existing, changed


_STORE = """ex AS (SELECT okey, order_id, order_status AS st, sales_paid AS paid FROM fact WHERE okey % 3 < 2),
  inc AS (SELECT okey, order_id, CASE WHEN okey % 7 = 0 THEN '已退款' ELSE order_status END AS st,
    CASE WHEN okey % 11 = 0 THEN sales_paid + 1 ELSE sales_paid END AS paid FROM fact WHERE okey % 3 > 0)"""


@register("A1_keep_last", """
SELECT CAST(o_custkey AS VARCHAR) AS cust, count(*) AS one, CAST(max(o_orderkey) AS VARCHAR) AS order_id
FROM (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders
      GROUP BY 1) GROUP BY 1
""")
def a1(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("cust"),
                                         F.col("o_orderkey").alias("k"), "o_orderdate")
    last = M.keep_last(o, "cust", ["o_orderdate", "k"])
    return last.groupBy("cust").agg(F.count(F.lit(1)).alias("one"),
                                    F.max("k").cast("string").alias("order_id"))


@register("A2_U1_U3_upsert", f"""
WITH {_STORE} SELECT order_id, st AS status, paid, CAST(NULL AS VARCHAR) AS channel FROM ex
  WHERE okey NOT IN (SELECT okey FROM inc) UNION ALL SELECT order_id, st, paid, 'new' FROM inc
""", "paid:2")
def a2(spark, d):
    out = M.upsert(*_store_rows(spark, d))
    return out.select(F.col("订单号").alias("order_id"), F.col("订单状态").alias("status"),
                      F.col("实际支付").alias("paid"), F.col("渠道").alias("channel"))


@register("A3_merge_counts", f"""
WITH {_STORE}, twice AS (SELECT okey FROM inc UNION ALL SELECT okey FROM inc WHERE okey % 2 = 0)
SELECT count(*) AS rows, count(*) FILTER (okey NOT IN (SELECT okey FROM ex)) AS added,
  count(DISTINCT okey) FILTER (okey NOT IN (SELECT okey FROM ex)) AS distinct_new,
  count(*) - count(*) FILTER (okey NOT IN (SELECT okey FROM ex)) AS duplicates FROM twice
""")
def a3(spark, d):
    existing, incoming = _store_rows(spark, d)
    twice = incoming.unionByName(incoming.filter("cast(`订单号` as bigint) % 2 = 0"))
    return M.merge_counts(existing, twice)


@register("A4_J8_U2_restatements", f"""
WITH {_STORE}, j AS (SELECT ex.order_id, ex.st AS s0, inc.st AS s1, ex.paid AS p0, inc.paid AS p1
  FROM ex JOIN inc USING (okey))
SELECT order_id, CASE WHEN s0 IS DISTINCT FROM s1 THEN '订单状态' ELSE '实际支付' END AS field,
  CASE WHEN s0 IS DISTINCT FROM s1 THEN s0 ELSE '' END AS old_status,
  CASE WHEN s0 IS DISTINCT FROM s1 THEN s1 ELSE '' END AS new_status
FROM j WHERE s0 IS DISTINCT FROM s1 OR p0 IS DISTINCT FROM p1
""")
def a4(spark, d):
    out = M.restatements(*_store_rows(spark, d))
    status = F.col("field") == "订单状态"
    return out.select("order_id", "field", F.when(status, F.col("old")).otherwise("").alias("old_status"),
                      F.when(status, F.col("new")).otherwise("").alias("new_status"))


@register("A4_E6_restatement_summary", f"""
WITH {_STORE}, j AS (SELECT ex.order_id FROM ex JOIN inc USING (okey)
  WHERE ex.st IS DISTINCT FROM inc.st OR ex.paid IS DISTINCT FROM inc.paid)
SELECT count(*) AS restated, (SELECT string_agg(order_id, ',' ORDER BY order_id)
  FROM (SELECT order_id FROM j ORDER BY order_id LIMIT 25)) AS sampled FROM j
""")
def a4s(spark, d):
    out = M.restatement_summary(M.restatements(*_store_rows(spark, d)))
    return out.select("restated", F.array_join("restatement_samples.order_id", ",").alias("sampled"))


_PRINT = """sha256(concat_ws('|', '{columns}', count(*), coalesce(sum(('0x' || left(md5(concat_ws(chr(31), {texts})), 15))::BIGINT), 0)))"""


def _print_sql(*columns: tuple[str, str]) -> str:
    """The fingerprint of columns, given with the SQL of their texts."""
    return _PRINT.format(columns=",".join(c for c, _ in columns), texts=", ".join(f"coalesce({t}, '')" for _, t in columns))


_PRINTED = [("实际支付", "cents"), ("订单号", "order_id"), ("订单时间", "stamp"), ("订单状态", "st")]


@register("A5_fingerprint", f"""
WITH f AS (SELECT okey, order_id, order_status AS st, sales_paid AS paid, strftime(order_time, '%Y-%m-%d %H:%M:%S') AS stamp FROM fact),
ex AS (SELECT *, CAST(CAST(round(paid * 100) AS BIGINT) AS VARCHAR) AS cents FROM f WHERE okey % 3 < 2),
inc AS (SELECT okey, order_id, stamp, CASE WHEN okey % 7 = 0 THEN '已退款' ELSE st END AS st,
  CAST(CAST(round((CASE WHEN okey % 11 = 0 THEN paid + 1 ELSE paid END) * 100) AS BIGINT) AS VARCHAR) AS cents FROM f WHERE okey % 3 > 0)
SELECT left({_print_sql(*_PRINTED)}, 16) AS file_hash, 'existing' AS side FROM ex
UNION ALL SELECT left({_print_sql(_PRINTED[0], ("渠道", "'new'"), *_PRINTED[1:])}, 16), 'incoming' FROM inc
""")
def a5(spark, d):
    """Fingerprints of texts, amounts in cents."""
    def told(df):
        return df.withColumns({"实际支付": F.round(F.col("实际支付") * 100).cast("bigint"),
                               "订单时间": F.date_format("订单时间", "yyyy-MM-dd HH:mm:ss")})

    existing, incoming = _store_rows(spark, d)
    return M.fingerprint(told(existing)).withColumn("side", F.lit("existing")).unionByName(
        M.fingerprint(told(incoming)).withColumn("side", F.lit("incoming")))


@register("A6_validate", """
SELECT strftime(min(order_time), '%Y-%m-%d %H:%M:%S') AS date_min,
  strftime(max(order_time), '%Y-%m-%d %H:%M:%S') AS date_max, '渠道' AS unknown_columns, '' AS missing
FROM fact WHERE okey % 3 > 0
""")
def a6(spark, d):
    dates, unknown, missing = M.validate(_store_rows(spark, d)[1])
    return dates.withColumn("unknown_columns", F.lit(",".join(unknown))).withColumn(
        "missing", F.lit(",".join(missing)))


@register("A8_freshness", """
SELECT segment, count(*) AS rows, strftime(max(order_time), '%Y-%m-%d %H:%M:%S') AS latest,
  datediff('day', max(day), DATE '2001-08-05') AS age_days,
  CASE WHEN datediff('day', max(day), DATE '2001-08-05') >= 7 THEN 'red'
       WHEN datediff('day', max(day), DATE '2001-08-05') >= 2 THEN 'amber' ELSE 'green' END AS colour
FROM fact GROUP BY 1
""")
def a8(spark, d):
    return M.freshness(orders_fact(spark, d, "order_time", "segment"), F.lit("2001-08-05").cast("date"),
                       "order_time", "segment")


_COVER = ("order_id", "user_id", "agent_name", "sales_paid", "operator", "ip_country", "coupon_name", "area_code")


@register("A9_column_coverage", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS filled, count({c}) / count(*) AS coverage FROM fact"
    for c in (*_COVER, "order_status")), "coverage:8")
def a9(spark, d):
    return M.coverage(orders_fact(spark, d, *_COVER))


@register("A10_reconcile", """
SELECT segment, count(*) AS store_rows, count(*) FILTER (okey % 100 <> 0) AS fact_rows,
  count(*) - count(*) FILTER (okey % 100 <> 0) AS difference FROM fact GROUP BY 1
""")
def a10(spark, d):
    f = orders_fact(spark, d, "order_id", "segment")
    stores = {s: f.filter(F.col("segment") == s) for s in ("B2B", "B2C")}
    return M.reconcile(stores, f.filter("cast(order_id as bigint) % 100 <> 0"))


@register("A11_K2_distinct_fact", """
SELECT segment, count(*) AS rows, sum(sales) AS gmv FROM fact GROUP BY 1
""", "gmv:2")
def a11(spark, d):
    f = orders_fact(spark, d, "order_id", "segment", "sales", "order_time")
    doubled = f.unionByName(f)
    return doubled.distinct().groupBy("segment").agg(F.count(F.lit(1)).alias("rows"),
                                                     F.sum("sales").alias("gmv"))


@register("T3_exception_digest", """
SELECT 'refund rate' AS signal, operator AS subject, count(*) FILTER (status_group = 'Refunded') / count(*) AS value,
  0.10 AS "limit" FROM fact WHERE operator IS NOT NULL GROUP BY 2
  HAVING count(*) FILTER (status_group = 'Refunded') / count(*) > 0.10
UNION ALL SELECT 'routing gap', operator, count(*) FILTER (status_group = 'Successful' AND interface_order_id = '--'), 20
  FROM fact WHERE operator IS NOT NULL GROUP BY 2
  HAVING count(*) FILTER (status_group = 'Successful' AND interface_order_id = '--') > 20
UNION ALL SELECT 'data age', 'fact', datediff('day', max(day), DATE '2001-08-05'), 2 FROM fact
  HAVING datediff('day', max(day), DATE '2001-08-05') > 2
""", "value:8 \"limit\":2")
def t3(spark, d):
    f = orders_fact(spark, d, "order_id", "operator", "interface_order_id", "order_time")
    return exception_digest(f, F.lit("2001-08-05").cast("date"), routing_gap=20)


@register("T3_daily_event_counts", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS events, sum(value) AS value
FROM events GROUP BY 1, 2
""", "value:2")
def t3e(spark, d):
    return daily_event_counts(table(spark, d, "events"))
