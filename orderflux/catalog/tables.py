"""Sources and sinks end to end: the driver tables are written as raw exports, imported and read back.

Working files go to a folder of their own beside the checkpoints.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux.catalog.base import dated_rates, register
from orderflux.catalog.ingest import raw_export
from orderflux.operators import fx
from orderflux.operators.cleaning import clean
from orderflux.plans import imports as I
from orderflux.plans.revenue import discount_depth
from orderflux.session import ensure_checkpoint_dir
from orderflux.sources import files as S
from orderflux.sources.orders import orders_fact, table
from orderflux.sources import key_index as K
from orderflux.sources.storage import (
    MONTH, Conflict, glob_paths, manifest, manifest_names, month_of, read_months, rename, retain, write_months)
from orderflux.streaming.digest import streamed_digest
from orderflux.streaming.ingest import ingest_folder


def scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/orderflux-{uuid.uuid4().hex}"


def _export(df: DataFrame, folder: str, encoding: str = "UTF-8", sep: str = ",") -> None:
    df.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    (df.write.mode("overwrite").option("header", True).option("encoding", encoding).option("sep", sep)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(folder))


@register("S1_S2_S5_read_exports", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 6 = 0 THEN '  ' WHEN o_orderkey % 6 <> 1
  THEN '埃及' END AS country, CAST(o_custkey AS VARCHAR) AS user_id, o_orderkey % 4 AS source FROM orders
""")
def s1(spark, d):
    """Four exports in different encodings and separators come back as one table of text."""
    base, raw = scratch(spark), raw_export(spark, d)
    layouts = [("UTF-8", ","), ("GB18030", ","), ("UTF-8", "\t"), ("GB18030", ";")]
    paths = []
    for i, (encoding, sep) in enumerate(layouts):
        _export(raw.filter(F.col("_file") == f"file{i}").drop("_file"), f"{base}/{i}", encoding, sep)
        paths += glob_paths(spark, f"{base}/{i}/*.csv")
    rows = next(iter(S.read_exports(spark, paths).values()))
    source = F.regexp_extract(F.col(S.FILE), r"/(\d)/[^/]*$", 1).cast("bigint")
    return rows.select(F.col("订单号").alias("order_id"), F.col("国家").alias("country"),
                       F.col("用户ID").alias("user_id"), source.alias("source"))


@register("S7_unprocessed_files", """
SELECT 'file' || (o_orderkey % 4) AS file, count(*) AS rows, sum(o_orderkey) AS ids FROM orders
WHERE o_orderkey % 4 > 0 GROUP BY 1
""")
def s7(spark, d):
    """What is left when the first of four files is known; its rows, read back."""
    base, raw = scratch(spark), raw_export(spark, d)
    for i in range(4):
        _export(raw.filter(F.col("_file") == f"file{i}").drop("_file").coalesce(1), f"{base}/file{i}")
    paths = glob_paths(spark, f"{base}/*/*.csv")
    done = S.file_hashes(spark, paths).orderBy("path").limit(1)
    left = [r["path"] for r in S.unprocessed(spark, paths, done).orderBy("path").collect()]
    rows = next(iter(S.read_exports(spark, left).values()))
    file = F.regexp_extract(F.col(S.FILE), r"/(file\d)/[^/]*$", 1)
    return rows.groupBy(file.alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("订单号").cast("bigint")).alias("ids"))


@register("S3_period_folders", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN '2' ELSE '1' END AS coupon
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
""")
def s3(spark, d):
    """Two period folders that count and one that does not; the later row of an order stays."""
    base, raw = scratch(spark), raw_export(spark, d).drop("_file")
    k = F.regexp_replace("订单号", "\t", "").cast("bigint")
    for folder, rows, mark in (("whole a", k % 2 == 0, "1"), ("whole b", k % 3 == 0, "2"), ("draft", F.lit(True), "3")):
        _export(raw.filter(rows).withColumn("优惠券金额", F.lit(mark)), f"{base}/book/{folder}")
    return S.read_periods(spark, base, "book").select(
        F.col("订单号").alias("order_id"), F.col("优惠券金额").alias("coupon"))


@register("S9_newest_user_list", """
SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_mktsegment AS source FROM customer WHERE c_custkey % 2 = 0
""")
def s9(spark, d):
    """The list whose name sorts last, ids without the ending a spreadsheet adds."""
    from orderflux.plans.customers import clean_user_list
    base, c = scratch(spark), table(spark, d, "customer")
    users = c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("ID"),
                     F.lit("2026-01-01").alias("注册时间"), F.col("c_mktsegment").alias("来源国家"),
                     F.lit("x").alias("会员来源"))
    for name, rows in (("users 1", users), ("users 2", users.filter(F.col("ID").cast("double") % 2 == 0))):
        _export(rows.coalesce(1), f"{base}/{name}")
        old = glob_paths(spark, f"{base}/{name}/*.csv")[0]
        rename(spark, old, f"{base}/{name}.csv")
    return clean_user_list(S.newest_user_list(spark, f"{base}/*.csv"), "ID").select(
        "user_id", F.col("来源国家").alias("source"))


@register("S6_C2_mixed_delivery", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN 'B2B' ELSE 'B2C' END AS segment,
  strftime(o_orderdate + INTERVAL 13 HOUR, '%Y-%m-%d %H:%M:%S') AS order_time,
  CASE WHEN o_orderkey % 3 = 1 THEN 'two' || chr(10) || 'lines, "quoted"' END AS remark
FROM orders
""")
def s6(spark, d):
    """A master folder with an agent file, a file of quoted line breaks, one of 12-hour dates and one without an order id."""
    data, root, o = scratch(spark), scratch(spark), table(spark, d, "orders")
    k, stamp = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    common = [k.cast("string").alias("订单号"), F.lit("1").alias("售价")]
    parts = {
        "agents": o.filter(k % 3 == 0).select(*common, F.concat(stamp, F.lit(" 13:00:00")).alias("订单时间"),
                                              F.lit("A").alias("代理商名称"), F.lit("B").alias("批次号")),
        "lines": o.filter(k % 3 == 1).select(*common, F.concat(stamp, F.lit(" 13:00:00")).alias("订单时间"),
                                             F.lit("7").alias("用户ID"), F.lit('two\nlines, "quoted"').alias("备注")),
        "hours": o.filter(k % 3 == 2).select(
            *common, F.concat(F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" 1:00:00 PM")).alias("订单时间"),
            F.lit("7").alias("用户ID")),
        "broken": o.select(k.cast("string").alias("no order id"))}
    for name, rows in parts.items():
        _export(rows.coalesce(1), f"{data}/{name}")
        rename(spark, glob_paths(spark, f"{data}/{name}/*.csv")[0], f"{data}/Master Data/{name}.csv")
    done = I.import_new_daily(spark, data, root, dry_run=False)
    assert len(done["errors"]) == 1
    remark = F.col("备注") if "备注" in I.read_fact(spark, root).columns else F.lit(None).cast("string")
    return I.read_fact(spark, root).select("order_id", "segment", "order_time", remark.alias("remark"))


@register("A8_import_status", f"""
WITH raw AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS t FROM orders
  WHERE o_orderkey % 77 <> 0 AND o_orderkey % 50 <> 0)
SELECT 'master' AS segment, count(*) AS rows, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS latest, 0::BIGINT AS fact_stale FROM raw
""")
def a8_status(spark, d):
    root = scratch(spark)
    _two_batches(spark, d, root)
    return I.import_status(spark, root)


def _two_batches(spark: SparkSession, d: str, root: str) -> None:
    """Import two thirds of the orders, then two thirds with some status changes and prices."""
    raw = raw_export(spark, d)
    k = F.col("用户ID").cast("bigint")
    later = raw.withColumn("订单状态", F.when(k % 7 == 0, "已退款").otherwise(F.col("订单状态")))
    for name, rows in (("one", raw.filter(k % 3 < 2)), ("two", later.filter(k % 3 > 0))):
        I.append_batch(spark, root, clean(rows, "master").rows, "master", name)


_TWO = """raw AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 77 <> 0 THEN o_orderdate END AS t,
    CASE WHEN o_orderkey % 50 = 0 THEN -1.0 WHEN o_orderkey % 51 = 0 OR o_orderkey % 52 = 0
      THEN floor(o_totalprice) + 0.5 ELSE floor(o_totalprice) + 0.5 END AS sales, o_orderkey % 50 = 0 AS neg FROM orders),
  good AS (SELECT *, CASE WHEN c % 3 > 0 AND c % 7 = 0 THEN '已退款' WHEN k % 5 <> 0 THEN '充值成功' ELSE 'Unknown' END
    AS status FROM raw WHERE NOT neg AND t IS NOT NULL)"""


@register("A7_K1_K2_K3_import_cycle", f"""
WITH {_TWO} SELECT strftime(t, '%Y-%m') AS order_month, status AS order_status, 'B2C' AS segment, count(*) AS orders,
  sum(sales) AS sales FROM good GROUP BY 1, 2
""", "sales:2")
def a7(spark, d):
    root = scratch(spark)
    _two_batches(spark, d, root)
    fact = I.read_fact(spark, root)
    return fact.groupBy(MONTH, "order_status", "segment").agg(
        F.count("order_id").alias("orders"), F.sum(F.coalesce("sales", F.lit(0.0))).alias("sales"))


@register("A7_key_index", f"""
WITH {_TWO} SELECT CAST(k AS VARCHAR) AS order_id, 'master' AS segment, strftime(t, '%Y-%m') AS order_month FROM good
""")
def a7_index(spark, d):
    """Segment and month of every order id, from the index that two batches have left."""
    root = scratch(spark)
    _two_batches(spark, d, root)
    ids = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return K.lookup(spark, root, ids)[0].select(F.col("id").alias("order_id"), "segment", F.col("month").alias("order_month"))


@register("K1_two_writers", """
SELECT strftime(o_orderdate, '%Y-%m') AS order_month, count(*) AS orders, count(*) FILTER (o_orderkey % 7 = 0) AS marked FROM orders
WHERE year(o_orderdate) >= 1996 OR o_orderkey % 2 = 0 GROUP BY 1
""")
def k1_writers(spark, d):
    """Three writers that have read the same version: the second one's months are its own, the third merges again."""
    path = f"{scratch(spark)}/t"
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), month_of(F.col("o_orderdate")).alias(MONTH))
    o = o.withColumn("marked", F.lit(False))
    write_months(o.where("year < 1996 and o_orderkey % 2 = 0"), path)
    base = manifest(spark, path)
    write_months(o.where("year between 1996 and 1997"), path, base=base)
    write_months(o.where("year > 1997"), path, base=base)
    marked = read_months(spark, path, entry=base).withColumn("marked", F.expr("o_orderkey % 7 = 0"))
    months = set(base["partitions"])
    mine = o.where("year >= 1996").withColumn("marked", F.expr("o_orderkey % 7 = 0"))
    try:
        write_months(marked.unionByName(mine), path, months=months, base=base)
    except Conflict:
        newest = manifest(spark, path)
        again = read_months(spark, path, entry=newest).withColumn("marked", F.expr("o_orderkey % 7 = 0"))
        write_months(again, path, months=set(newest["partitions"]), base=newest)
    return read_months(spark, path).groupBy(MONTH).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("marked").alias("marked"))


@register("K1_K2_retained_versions", """
SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS orders, 5::BIGINT AS version, 1::BIGINT AS manifests FROM orders GROUP BY 1
""")
def k1_retained(spark, d):
    """A table rewritten five times, of which the newest version is all that stays."""
    path = f"{scratch(spark)}/t"
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias(MONTH)).withColumn("version", F.lit(0))
    for k in range(1, 6):
        write_months(o.withColumn("version", F.lit(k)), path, batch=f"b{k}")
    retain(spark, path, versions=1, seconds=0)
    left = len(manifest_names(spark, path))
    return read_months(spark, path).groupBy(F.col(MONTH).alias("year")).agg(
        F.count(F.lit(1)).alias("orders"), F.max("version").cast("bigint").alias("version"),
        F.lit(left).cast("bigint").alias("manifests"))


@register("A8_source_freshness", """
SELECT CASE WHEN k = 1 THEN 'agent' ELSE 'master' END AS segment, CASE WHEN k = 1 THEN 2 ELSE 1 END::BIGINT AS files,
  CASE WHEN k = 1 THEN 1 ELSE 0 END::BIGINT AS newer, CASE WHEN k = 1 THEN 1 ELSE 0 END::BIGINT AS stale
FROM (SELECT DISTINCT o_orderkey % 2 AS k FROM orders)
""")
def a8_sources(spark, d):
    """One file of each segment is imported; then the agents deliver another."""
    data, root, o = scratch(spark), scratch(spark), table(spark, d, "orders")
    k = F.col("o_orderkey")
    common = [k.cast("string").alias("订单号"), F.lit("1").alias("售价"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("订单时间")]
    agents = o.where(k % 2 == 1).select(*common, F.lit("A").alias("代理商名称"), F.lit("B").alias("批次号"))
    parts = {"Agent Data/1": agents.where(k % 3 > 0), "Master Data/1": o.where(k % 2 == 0).select(*common, F.lit("7").alias("用户ID")),
             "Agent Data/2": agents.where(k % 3 == 0)}
    for name, rows in parts.items():
        if name == "Agent Data/2":
            I.import_new_daily(spark, data, root, dry_run=False)
        _export(rows.coalesce(1), f"{data}/out/{name}")
        rename(spark, glob_paths(spark, f"{data}/out/{name}/*.csv")[0], f"{data}/{name}.csv")
    return I.source_freshness(spark, data, root).select("segment", "files", "newer", "stale")


@register("G45_discount_depth_published", """
SELECT 'B2C' AS segment, avg(1 - round((floor(o_totalprice) + 0.5) * (1 - (o_orderkey % 4) / 10.0), 2) / (floor(o_totalprice) + 0.5))
  FILTER (o_orderkey % 9 > 0) AS discount_depth, count(*) FILTER (o_orderkey % 9 > 0) AS rows FROM orders WHERE o_orderkey % 77 > 0
""", "discount_depth:6")
def g45p(spark, d):
    """Discount depth on a fact that went through the import."""
    root, raw = scratch(spark), raw_export(spark, d)
    k, listed = F.regexp_replace("订单号", "\t", "").cast("bigint"), F.replace("售价", F.lit(","), F.lit("")).cast("double")
    paid = F.when(k % 9 > 0, F.round(listed * (1 - (k % 4) / 10.0), 2).cast("string"))
    I.append_batch(spark, root, clean(raw.withColumn("实际支付", paid), "master").rows, "master", "one")
    return discount_depth(I.read_fact(spark, root), "segment")


@register("K4_audit_log", f"""
WITH {_TWO}, a AS (SELECT 'one' AS batch_id, count(*) FILTER (NOT neg AND t IS NOT NULL) AS added,
    count(*) FILTER (neg OR t IS NULL) AS quarantined, 0::BIGINT AS duplicates, 0::BIGINT AS restated FROM raw WHERE c % 3 < 2
  UNION ALL SELECT 'two', count(*) FILTER (c % 3 = 2 AND NOT neg AND t IS NOT NULL),
    count(*) FILTER (neg OR t IS NULL), count(*) FILTER (c % 3 = 1 AND NOT neg AND t IS NOT NULL),
    count(*) FILTER (c % 3 = 1 AND c % 7 = 0 AND NOT neg AND t IS NOT NULL) FROM raw WHERE c % 3 > 0)
SELECT * FROM a
""")
def k4(spark, d):
    root = scratch(spark)
    _two_batches(spark, d, root)
    return I.read_audit(spark, root).select("batch_id", "added", "quarantined", "duplicates", "restated")


@register("K5_quarantine_table", f"""
WITH {_TWO} SELECT 'master' AS segment, batch_id, CASE WHEN neg THEN 'negative amount' ELSE 'order time missing' END
  AS reason, count(*) AS rows
FROM (SELECT *, 'one' AS batch_id FROM raw WHERE c % 3 < 2 UNION ALL SELECT *, 'two' FROM raw WHERE c % 3 > 0)
WHERE neg OR t IS NULL GROUP BY 1, 2, 3
""")
def k5(spark, d):
    root = scratch(spark)
    _two_batches(spark, d, root)
    return I.read_quarantine(spark, root).groupBy("segment", "batch_id", "reason").agg(
        F.count(F.lit(1)).alias("rows"))


@register("K8_full_rebuild", f"""
WITH {_TWO} SELECT strftime(t, '%Y-%m') AS order_month, count(*) AS orders, sum(sales) AS sales,
  sum(CASE WHEN k % 3 = 0 THEN 1000.0 ELSE 0.0 END) AS coupons FROM good GROUP BY 1
""", "sales:2 coupons:2")
def k8(spark, d):
    """History first, daily files later; the later row of an order wins."""
    data, root, raw = scratch(spark), scratch(spark), raw_export(spark, d)
    old = raw.filter(F.col("_file") != "file1").withColumn("优惠券金额", F.lit("9"))
    _export(old.drop("_file"), f"{data}/History")
    _export(raw.filter("_file = 'file1'").drop("_file"), f"{data}/Master Data (RM)/part")
    _export(raw.filter("_file <> 'file1'").drop("_file"), f"{data}/Master Data/part")
    history = {"master": ["History/*.csv", "Master Data (RM)/part/*.csv", "Master Data/part/*.csv"]}
    I.full_rebuild(spark, data, root, history, dry_run=False)
    fact = I.read_fact(spark, root, [MONTH, "order_id", "sales", "coupon_amount"])
    return fact.groupBy(MONTH).agg(
        F.count("order_id").alias("orders"), F.sum(F.coalesce("sales", F.lit(0.0))).alias("sales"),
        F.sum("coupon_amount").alias("coupons"))


@register("S4_pruned_read", """
SELECT strftime(o_orderdate, '%Y-%m') AS order_month, count(*) AS orders FROM orders
WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'
  AND o_orderkey % 77 <> 0 AND o_orderkey % 50 <> 0 GROUP BY 1
""")
def s4(spark, d):
    """Column and month pruning on the published fact; a column that does not exist is tolerated."""
    root = scratch(spark)
    I.append_batch(spark, root, clean(raw_export(spark, d), "master").rows, "master", "one")
    months = {m for m in manifest(spark, f"{root}/fact")["partitions"] if m.startswith("2000-")}
    fact = I.read_fact(spark, root, [MONTH, "order_id", "not_there"], months=months)
    return fact.groupBy(MONTH).agg(F.count("order_id").alias("orders"))


@register("K6_export_csv", """
SELECT country, count(*) AS orders, sum(sales) AS sales FROM fact WHERE region = 'Africa' GROUP BY 1
""", "sales:2")
def k6(spark, d):
    path = scratch(spark)
    view = orders_fact(spark, d, "order_id", "country", "region", "sales").filter("region = 'Africa'")
    I.export_csv(view, path)
    back = spark.read.schema(view.schema).option("header", True).csv(path)
    return back.groupBy("country").agg(F.count("order_id").alias("orders"), F.sum("sales").alias("sales"))


@register("S8_K7_rate_file", "SELECT iso, month, rate FROM rates", "rate:6")
def s8(spark, d):
    path = scratch(spark)
    fx.write_rates(dated_rates(spark, d).withColumn("source", F.lit("ecb")), path)
    return fx.read_rates(spark, path).select("iso", "month", "rate")


@register("T1_T2_streaming_import", f"""
WITH {_TWO} SELECT status AS order_status, count(*) AS orders, sum(sales) AS sales FROM good
WHERE c % 3 < 2 OR c % 3 > 0 GROUP BY 1
""", "sales:2")
def t1(spark, d):
    """Two drops into a watched folder, the second restating orders, and one run with nothing new.

    The second drop has its columns in another order and is in GB18030.
    """
    base, raw = scratch(spark), raw_export(spark, d)
    k = F.col("用户ID").cast("bigint")
    later = raw.withColumn("订单状态", F.when(k % 7 == 0, "已退款").otherwise(F.col("订单状态")))
    later = later.select(*reversed(later.columns))
    iso = F.regexp_replace("订单时间", r"^(\d\d)/(\d\d)/(\d{4})", "$3-$2-$1")
    for name, rows, encoding in (("one", raw.filter(k % 3 < 2), "UTF-8"), ("two", later.filter(k % 3 > 0), "GB18030")):
        _export(rows.withColumn("订单时间", iso).drop("_file").coalesce(4), f"{base}/in/{name}", encoding)
        ingest_folder(spark, f"{base}/in/*", f"{base}/db", f"{base}/state")
    ingest_folder(spark, f"{base}/in/*", f"{base}/db", f"{base}/state")
    return I.read_fact(spark, f"{base}/db").groupBy("order_status").agg(
        F.count("order_id").alias("orders"), F.sum(F.coalesce("sales", F.lit(0.0))).alias("sales"))


@register("T3_streamed_digest", f"""
WITH {_TWO}, f AS (SELECT 'Op ' || (c % 5) AS op, status, k % 6 = 0 AS missing, t FROM good)
SELECT 'refund rate' AS signal, op AS subject, count(*) FILTER (status = '已退款') / count(*) AS value, 0.01 AS "limit" FROM f GROUP BY op
  HAVING count(*) FILTER (status = '已退款') / count(*) > 0.01
UNION ALL SELECT 'routing gap', op, count(*) FILTER (status = '充值成功' AND missing), 5 FROM f GROUP BY op
  HAVING count(*) FILTER (status = '充值成功' AND missing) > 5
UNION ALL SELECT 'data age', 'fact', datediff('day', max(CAST(t AS DATE)), DATE '2001-08-05'), 1 FROM f
  HAVING datediff('day', max(CAST(t AS DATE)), DATE '2001-08-05') > 1
""", "value:8 \"limit\":2")
def t3d(spark, d):
    """The exception digest of a watched folder, the second drop of which restates orders."""
    base, raw = scratch(spark), raw_export(spark, d)
    k, c = F.regexp_replace("订单号", "\t", "").cast("bigint"), F.col("用户ID").cast("bigint")
    raw = raw.withColumns({"运营商": F.concat(F.lit("Op "), (c % 5).cast("string")),
                           "接口商订单号": F.when(k % 6 == 0, "--").otherwise("s1")})
    later = raw.withColumn("订单状态", F.when(c % 7 == 0, "已退款").otherwise(F.col("订单状态")))
    iso = F.regexp_replace("订单时间", r"^(\d\d)/(\d\d)/(\d{4})", "$3-$2-$1")
    for name, rows in (("one", raw.filter(c % 3 < 2)), ("two", later.filter(c % 3 > 0))):
        _export(rows.withColumn("订单时间", iso).drop("_file"), f"{base}/in/{name}")
        ingest_folder(spark, f"{base}/in/*", f"{base}/db", f"{base}/state")
    return streamed_digest(spark, f"{base}/db", F.lit("2001-08-05").cast("date"), 0.01, 5, 1)


@register("T3_streaming_event_counts", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS events, sum(value) AS value,
  CASE WHEN CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events) THEN 0 ELSE 1 END::BIGINT AS open
FROM events GROUP BY 1, 2, 5
""", "value:2")
def t3s(spark, d):
    """The event counts as a stream: days closed by the watermark are appended to a table, the others counted beside."""
    from orderflux.streaming.ingest import daily_event_counts, with_open_days
    base = scratch(spark)
    events = table(spark, d, "events")
    events.write.parquet(f"{base}/in")
    counts = daily_event_counts(spark.readStream.schema(events.schema).parquet(f"{base}/in"))
    query = (counts.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return with_open_days(spark.read.schema(counts.schema).parquet(f"{base}/out"), events)
