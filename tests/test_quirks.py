"""One small case per rule that is easy to get wrong."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderflux import config
from orderflux.functions import dimensions as D
from orderflux.functions import expressions as E
from orderflux.functions import values as V
from orderflux.operators import filters as FL
from orderflux.operators import fx, geo
from orderflux.operators import merge as M
from orderflux.operators import ordering as O
from orderflux.operators.cleaning import clean
from orderflux.operators.normalise import enrich, normalise
from orderflux.plans import churn, demand, forecast, series
from orderflux.plans import forecast as FC
from orderflux.plans.customers import customer_type, retention_rate, scope_user_list
from orderflux.sources.files import detect_stream


def texts(spark, values, name="c"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_ids(spark):
    df = texts(spark, ["\t123", "123", "nan", "None", "  ", "2026080112345678901", None])
    assert column(df, E.clean_id(F.col("c"))) == ["123", "123", None, None, None, "2026080112345678901", None]
    assert column(texts(spark, ["7.0", "70", "7.05"]), E.normalise_user_id(F.col("c"))) == ["7", "70", "7.05"]


def test_numbers_and_flags(spark):
    assert column(texts(spark, ["1,234.50", "abc", " 5 ", ""]), E.to_number(F.col("c"))) == [1234.5, None, 5.0, None]
    assert column(texts(spark, ["是", " 否", "x", None]), E.to_flag(F.col("c"))) == [True, False, None, None]


@pytest.mark.parametrize("day_first,expected", [(False, [None, datetime(2024, 1, 2)]),
                                                (True, [datetime(2024, 2, 13), datetime(2024, 2, 1)])])
def test_date_order(spark, day_first, expected):
    got = column(texts(spark, ["13/02/2024", "01/02/2024"]), E.parse_timestamp(F.col("c"), day_first))
    assert got == expected


def test_date_layouts(spark):
    df = texts(spark, ["2024-02-13 10:11:12", "2024/2/3 4:05", "20240213", "2024-13-40", "junk", "", None, "5"])
    assert column(df, E.parse_timestamp(F.col("c"))) == [
        datetime(2024, 2, 13, 10, 11, 12), datetime(2024, 2, 3, 4, 5), datetime(2024, 2, 13), None, None, None, None,
        None]


def raw(spark, dates, **extra):
    rows = [(str(i), d, extra.get("paid", "5"), "f") for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "`订单号` string, `订单时间` string, `实际支付` string, `_file` string")


def test_day_first_needs_more_than_a_fifth(spark):
    fifth = raw(spark, ["13/02/2024"] + ["01/02/2024"] * 4)             # exactly 20% fail: stays month-first
    assert clean(fifth, "master").quarantined.count() == 1
    more = clean(raw(spark, ["13/02/2024"] * 2 + ["01/02/2024"] * 4), "master")
    assert more.quarantined.count() == 0
    report = more.report.first()
    assert report["订单时间_day_first"] and not report["订单时间_ambiguous"]
    assert clean(raw(spark, ["01/02/2024", "03/04/2024"]), "master").report.first()["订单时间_ambiguous"]


def test_cleaner_quarantine_and_fills(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01", "-1", "5", None, "  "), ("2", "2024-01-01", None, "0", None, None),
         ("3", "2024-01-01", "4", "-5", "x", " a "), ("4", None, "4", "5", None, None)],
        "`订单号` string, `订单时间` string, `实际支付` string, `售价` string, `优惠券金额` string, `国家` string")
    out = clean(df, "master")
    assert {r["订单号"]: r["reason"] for r in out.quarantined.collect()} == {
        "1": "negative amount", "3": "negative amount", "4": "order time missing"}
    kept = out.good.first()
    assert (kept["订单号"], kept["实际支付"], kept["售价"], kept["优惠券金额"], kept["国家"]) == (
        "2", None, 0.0, 0.0, "Unknown")
    r = out.report.first()
    assert (r["rows_in"], r["rows_out"], r["quarantined"], r["国家_filled"]) == (4, 1, 3, 1)


def test_whitespace_country_stays_blank(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "  ")], "`订单号` string, `订单时间` string, `国家` string")
    assert clean(df, "master").good.first()["国家"] == ""


def test_streams():
    assert detect_stream(["下单时间", "x"]) == "master_rm"
    assert detect_stream(["批次号"]) == "agent"
    assert detect_stream(["商品信息"]) == "agent"
    assert detect_stream(["商品信息", "用户ID"]) == "master"


def test_local_currency_headings(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "3", "9")],
                               "`订单号` string, `下单时间` string, `实际支付(当地币)` string, `用户ID` string")
    assert {"订单时间", "实际支付", "用户id"} <= set(clean(df, "master_rm").good.columns)


def test_normalise_sales_and_duplicate_headings(spark):
    df = spark.createDataFrame(
        [("1", None, "10", "A", "B", "埃及"), ("2", "abc", "10", "A", "B", "Mars"), ("3", "4", "10", None, "B", None)],
        "`订单号` string, `实际支付` string, `售价` string, `商品分类` string, `分类` string, `国家` string")
    rows = normalise(df).orderBy("order_id").collect()
    assert [r["sales"] for r in rows] == [10.0, None, 4.0]
    assert [r["sales_listed"] for r in rows] == [10.0] * 3
    assert [r["product_category"] for r in rows] == ["A", "A", None]
    assert [r["country"] for r in rows] == ["Egypt", "Mars", None]


def test_enrich(spark):
    df = spark.createDataFrame([("2026-01-01 00:00", None, "", "Digi话费", "是"), ("Egypt", "Orange", "b", "p", "?")],
                               "country string, operator string, brand string, product string, coupon_used string")
    rows = enrich(df).collect()
    assert [(r["country"], r["region"], r["operator"], r["coupon_used"]) for r in rows] == [
        (None, "Other", "Digi", True), ("Egypt", "Africa", "Orange", None)]


def test_dimensions(spark):
    df = texts(spark, ["60", "999", "x", None, "44.0", " 1 "], "area_code")
    assert [r["destination"] for r in D.add_destination(df).collect()] == [
        "Malaysia", "+999", "Unknown", "Unknown", "United Kingdom", "USA/Canada"]
    classes = D.add_category_class(texts(spark, [" 买流量", "充流量-测试", None], "product_category"))
    assert [r["category_class"] for r in classes.collect()] == ["流量套餐", "其他", "其他"]
    nullable = D.add_category_class(texts(spark, ["充流量-测试"], "product_category"), default=None)
    assert nullable.first()["category_class"] is None
    assert [r["iso3"] for r in D.add_iso3_from_iso2(texts(spark, ["my", "ZZ"], "iso2")).collect()] == ["MYS", None]
    names = {r["name_cn"]: r["name_en"] for r in D.country_names(spark).collect()}
    assert (names["刚果金"], names["韩国"], names["未知"], names["缅甸"], names["香港"]) == (
        "Democratic Republic of the Congo", "South Korea", "Unknown", "Myanmar", "Hong Kong")
    assert D.regions(spark).count() == 200 and len(V.CALLING_CODES) == 108


def test_package_volume(spark):
    df = texts(spark, ["50GB，28天", "3.5G，30天", "500MB", "不限量", "1TB", "RM 50", "无限流量 10GB"])
    assert column(df, E.package_mb(F.col("c"), F.lit(None).cast("string"))) == [
        51200.0, 3584.0, 500.0, config.UNLIMITED_MB, 1048576.0, None, config.UNLIMITED_MB]
    assert column(texts(spark, ["RM 5"]), E.package_mb(F.col("c"), F.lit("Plan 2GB"))) == [2048.0]


def test_supplier_id_and_status(spark):
    assert column(texts(spark, ["--", "-", " ", "NaN", "S1", None]), E.usable_supplier_id(F.col("c"))) == [
        None, None, None, None, "S1", None]
    assert column(texts(spark, ["充值成功", "充值中", "?"]), E.status_group(F.col("c"))) == [
        "Successful", "Pending", None]


def test_filters(spark):
    df = texts(spark, ["买流量", "充流量-测试", "电子钱包", None], "product_category")
    count = lambda c: df.filter(c).count()                              # noqa: E731
    assert count(FL.category()) == 2 and count(FL.category("流量套餐")) == 1
    assert count(FL.exclude_ewallet()) == 3 and count(FL.exclude_ewallet("电子钱包")) == 4
    assert FL.raw_categories("后付费", ["后付费", "买流量"]) == ["后付费"]
    assert FL.previous_period(date(2024, 3, 1), date(2024, 3, 31)) == (date(2024, 1, 30), date(2024, 2, 29))
    assert FL.quick_period("last_month", date(2024, 3, 5)) == (date(2024, 2, 1), date(2024, 2, 29))


RATES = "iso string, country string, month string, rate double"


def test_rates_by_currency_and_country(spark):
    rates = spark.createDataFrame([("MYR", None, "1996-06", 0.6), (None, "Malaysia", "1999-02", 0.7)], RATES)
    q = spark.createDataFrame([("MYR", "1995-01"), ("myr ", "1996-06"), ("MYR", "1998-03"), ("MYR", "2024-01"),
                               ("MYR", None), ("USD", "2000-01"), ("QQQ", "2000-01")], "i string, m string")
    given = [tuple(r) for r in q.collect()]                    # rows come back in any order
    got = {(r["i"], r["m"]): r["rate"] for r in fx.rate_for_iso(q, rates, F.col("i"), F.col("m")).collect()}
    assert [got[k] for k in given] == [0.66, 0.6, 0.6, 0.7, 0.7, 0.14, None]
    q = spark.createDataFrame([("Malaysia", "1995-01"), ("Malaysia", "1998-03"), ("Malaysia", "2024-01"),
                               ("Malaysia", None), ("Mars", "2000-01")], "c string, m string")
    given = [tuple(r) for r in q.collect()]
    got = {(r["c"], r["m"]): r["rate"] for r in fx.rate_for_country(q, rates, F.col("c"), F.col("m")).collect()}
    assert [got[k] for k in given] == [0.6, 0.6, 0.7, 0.66, None]
    none = spark.createDataFrame([], RATES)
    assert fx.rate_for_iso(q.limit(1), none, F.lit("MYR"), F.lit("2000-01")).first()["rate"] == 0.66


def test_bad_rate_rows_are_skipped(spark):
    raw_rates = spark.createDataFrame([(" myr", "2024-01", "0.6"), ("USD", "", "1"), ("USD", "2024-01", "x")],
                                      "iso string, month string, rate string")
    assert [tuple(r) for r in fx.clean_rates(raw_rates).collect()] == [("MYR", None, "2024-01", 0.6)]


def test_rate_derivation(spark):
    daily = spark.createDataFrame([(date(2024, 1, 1), "USD", 0.1), (date(2024, 1, 2), "USD", 0.2),
                                   (date(2024, 2, 1), "USD", 0.1), (date(2024, 1, 1), "CNY", 1.0),
                                   (date(2024, 1, 1), "SAR", 9.0)], "day date, iso string, rate double")
    latest = spark.createDataFrame([("KZT", 70.0), ("USD", 5.0), ("CNY", 1.0)], "iso string, rate double")
    rows = {(r["iso"], r["month"]): (round(r["rate"], 6), r["source"])
            for r in fx.derive_rate_table(daily, latest).collect()}
    assert rows[("USD", "2024-01")] == (0.15, "ecb") and rows[("SAR", "2024-01")] == (0.5625, "usd-peg")
    assert rows[("KZT", "2024-02")] == (70.0, "er-api-latest") and ("KZT", "2024-01") not in rows
    assert not any(k[0] == "CNY" for k in rows)


def test_keep_last_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "p"), (None, 2, "q")], "k string, r int, v string")
    assert sorted(r["v"] for r in M.keep_last(df, "k", ["r"]).collect()) == ["p", "q", "y"]
    assert sorted(r["v"] for r in M.keep_last(df, "k", ["r"], collapse_nulls=True).collect()) == ["q", "y"]


def test_merge_counts(spark):
    schema = "`订单号` string"
    old = spark.createDataFrame([("1",), (None,)], schema)
    new = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], schema)
    r = M.merge_counts(old, new).first()
    assert (r["rows"], r["added"], r["duplicates"], r["distinct_new"]) == (4, 2, 2, 1)
    r = M.merge_counts(None, new).first()
    assert (r["added"], r["duplicates"]) == (3, 1)


def test_restatement_counts_first_field_once(spark):
    schema = "`订单号` string, `订单状态` string, `实际支付` double"
    old = spark.createDataFrame([("1", "a", 1.0), ("2", "a", 12.0), ("3", "a", None)], schema)
    new = spark.createDataFrame([("1", "b", 2.0), ("2", "a", 12.0), ("3", "a", 3.0)], schema)
    rows = M.restatements(old, new)
    assert sorted((r["order_id"], r["field"]) for r in rows.collect()) == [("1", "订单状态"), ("3", "实际支付")]
    summary = M.restatement_summary(rows, 1).first()
    assert summary["restated"] == 2 and [s["order_id"] for s in summary["restatement_samples"]] == ["1"]


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    same = spark.createDataFrame([(2, "y"), (1, "x")], "a int, b string")
    other = spark.createDataFrame([(2, "y"), (1, "z")], "a int, b string")
    f = [M.fingerprint(d).first()[0] for d in (a, same, other)]
    assert f[0] == f[1] != f[2] and len(f[0]) == 16


def test_running_totals_with_ties_and_keys(spark):
    df = spark.createDataFrame([("a", "p", 5.0), ("a", "q", 5.0), ("a", "r", 1.0), ("b", "s", 0.0), ("b", "t", -2.0)],
                               "g string, k string, v double")
    rows = {r["k"]: (r["rank"], r["cumulative"]) for r in O.running_totals(df, "v", ["g"]).collect()}
    assert rows == {"p": (1, 10.0), "q": (1, 10.0), "r": (3, 11.0), "s": (1, 0.0), "t": (2, -2.0)}


def test_running_totals_and_median_against_brute_force(spark):
    import random
    rng = random.Random(7)
    data = [(rng.choice("ab"), float(rng.choice([0, 1, 1, 2, 1000.5, -3, rng.random() * 1e6]))) for _ in range(400)]
    df = spark.createDataFrame([(g, i, v) for i, (g, v) in enumerate(data)], "g string, i int, v double")
    got = {r["i"]: (r["rank"], round(r["cumulative"], 6)) for r in O.running_totals(df, "v", ["g"]).collect()}
    for i, (g, v) in enumerate(data):
        mine = [x for h, x in data if h == g]
        assert got[i] == (1 + sum(x > v for x in mine), round(sum(x for x in mine if x >= v), 6))
    import statistics
    medians = {r["g"]: r["median"] for r in O.exact_median(df, ["g"], "v").collect()}
    assert medians == {g: statistics.median(x for h, x in data if h == g) for g in "ab"}


def test_median_of_one_crowded_bucket(spark):
    """Distinct values that all lie in one bucket, ties, NULLs and a NULL key; the part that is ordered stays small."""
    import statistics
    from pyspark.sql import functions as F
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"),
        F.when(F.col("id") % 1000 != 7, F.when(F.col("id") % 3 == 1, F.floor(F.col("id") / 5_000) / 1e6).otherwise(
            F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e12) + 1000.0).alias("v"))
    values = {}
    for r in rows.collect():
        values.setdefault(r["g"], []).append(r["v"])
    assert rows.where("v is not null").select(O.value_bucket(F.col("v"))).distinct().count() == 1
    for most in (100_000, 40):
        got = {r["g"]: (r["median"], r["rows"]) for r in O.exact_median(rows, ["g"], "v", most=most).collect()}
        assert got == {g: (statistics.median(x for x in v if x is not None), len(v)) for g, v in values.items()}


def test_refinement_leaves_bounded_buckets(spark):
    rows = spark.range(50_000).select(F.lit("a").alias("g"), F.lit(0).alias("_b"), F.exp(F.col("id") / 100.0).alias("v"),
                                      F.lit(1).alias("_n"), F.lit(0).alias("_before"), F.lit(25_000).alias("_low"),
                                      F.lit(25_001).alias("_high"))
    left = O.refined(rows, ["g"], "v", 200)
    assert left.groupBy("_b").count().agg(F.max("count")).first()[0] <= 200 and left.count() <= 400


def test_ip_lookup_takes_the_most_specific_range(spark):
    ranges = spark.createDataFrame(
        [(10 << 24, (11 << 24) - 1, 8, "AA", "A", "wide", None, 0.0, 0.0),
         (10 << 24, (10 << 24) + 255, 24, "AA", "A", "narrow", None, 0.0, 0.0)],
        "start_ip long, end_ip long, prefix int, iso2 string, country string, subdivision string, city string, "
        "lat double, lon double")
    df = texts(spark, ["10.0.0.7", "10.9.9.9", "11.0.0.0", "10.0.0.256", "bad", None], "ip_address")
    got = {r["ip_address"]: r["geo"] and r["geo"]["subdivision"] for r in geo.locate_ips(df, ranges).collect()}
    assert got == {"10.0.0.7": "narrow", "10.9.9.9": "wide", "11.0.0.0": None, "10.0.0.256": None, "bad": None,
                   None: None}


def test_customer_type_and_retention(spark):
    rows = [("u", "B2C", "2024-01-05", "2024-01-01"), ("u", "B2C", "2024-02-05", "2024-01-01"),
            ("v", "B2C", "2024-01-06", "2024-01-02"), ("w", "B2C", "2024-01-06", "2024-03-01")]
    df = spark.createDataFrame(rows, "user_id string, segment string, o string, r string").select(
        "user_id", "segment", F.col("o").cast("timestamp").alias("order_time"),
        F.col("r").cast("timestamp").alias("register_time"))
    assert [r[0] for r in df.select(customer_type()).collect()] == ["New", "Returning", "New", "Unknown"]
    r = retention_rate(df).filter("month = '2024-02-01'").first()
    assert (r["previous_new"], r["retained"]) == (2, 1)


def test_user_list_scope(spark):
    df = spark.createDataFrame([("微信", "X"), ("微信", " "), ("支付宝", None)], "member_source string, source_country string")
    assert scope_user_list(df).count() == 1 and scope_user_list(df, "all").count() == 2


def days(spark, n, hot=1):
    start = date(2024, 1, 1).toordinal()
    rows = [(f"u{i % 40}", "B2C", datetime.combine(date.fromordinal(start + i), datetime.min.time()), 10.0 + i % 7)
            for i in range(n) for _ in range(hot)]
    return spark.createDataFrame(rows, "user_id string, segment string, order_time timestamp, sales double")


def test_series_needs_42_days_without_the_last(spark):
    assert series.daily_series(days(spark, 42)).count() == 0            # 41 once the last day is left out
    assert series.daily_series(days(spark, 43)).count() == 42
    assert forecast.forecast_revenue(days(spark, 42)) is None


def test_series_fills_gaps_and_drops_dead_days(spark):
    df = days(spark, 60).filter("day(order_time) not in (10, 11)").withColumn(
        "sales", F.when(F.col("order_time") < "2024-01-03", 0.0).otherwise(F.col("sales")))
    rows = series.daily_series(df).orderBy("day").collect()
    assert str(rows[0]["day"]) == "2024-01-03" and len(rows) == 57
    assert [r["revenue"] for r in rows if r["day"].day in (10, 11)] == [0.0] * 4


def test_linear_forecast_matches_closed_form(spark):
    df = days(spark, 100)
    rows = forecast.linear_forecasts(series.daily_series(df), horizon_weeks=1)
    kinds = {(r["kind"], r["model"]): r["n"] for r in rows.groupBy("kind", "model").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("validation", "Ridge"): 28, ("validation", "Seasonal Baseline"): 28,
                     ("forecast", "Ridge"): 14, ("forecast", "Seasonal Baseline"): 14}
    acc = {r["model"]: r["mape"] for r in forecast.accuracy(rows).collect()}
    assert acc["Seasonal Baseline"] == pytest.approx(0.0, abs=1e-9)     # the pattern repeats weekly
    assert forecast.fold_bounds(200) == [(158, 172), (172, 186), (186, 200)]
    assert forecast.fold_bounds(20) == [(6, 20)]
    plain = forecast.baseline_validation(series.daily_series(df))
    assert plain.count() == 28


def test_features_do_not_look_ahead(spark):
    df = days(spark, 120)
    ref = datetime(2024, 3, 1)
    a = {r["user_id"]: r for r in churn.customer_features(df, ref).collect()}
    b = {r["user_id"]: r for r in churn.customer_features(df.filter(F.col("order_time") <= ref), ref).collect()}
    assert a == b
    one = a["u0"]                                                        # days 0 and 40
    assert (one["frequency"], one["tenure_days"], one["interval_mean"], one["interval_std"]) == (2.0, 40.0, 40.0, 0.0)


def test_risk_tiers(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.31,), (0.6,), (0.61,)], "p double")
    assert column(df, churn.risk_tier(F.col("p"))) == [
        "Low Risk", "Low Risk", "Medium Risk", "Medium Risk", "High Risk"]


def test_auc_against_pair_counting(spark):
    rows = [("m", 1, 0.9), ("m", 0, 0.9), ("m", 1, 0.7), ("m", 0, 0.2), ("m", 0, 0.1), ("m", 1, 0.1)]
    df = spark.createDataFrame(rows, "model string, churn int, score double")
    pos, neg = ([s for _, c, s in rows if c == k] for k in (1, 0))
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert churn.classifier_metrics(churn.roc_points(df)).first()["auc"] == pytest.approx(want)


def test_demand_short_and_long_history(spark):
    def weeks(n):
        start = date(2024, 1, 1).toordinal()
        rows = [("op", "p", datetime.combine(date.fromordinal(start + 7 * w + d), datetime.max.time()))
                for w in range(n) for d in range(7) for _ in range(w + 1)]
        return spark.createDataFrame(rows, "operator string, product string, order_time timestamp")

    short = demand.forecast_demand(weeks(7)).first()
    assert short["trend"] == "flat" and short["wk1_forecast"] == round(7 * (4 + 5 + 6 + 7) / 4)
    long = demand.forecast_demand(weeks(8)).first()
    assert long["trend"] == "up" and long["wk1_forecast"] == 63.0 and long["wk1_low"] == 63.0


def test_hot_key_is_reduced_before_the_shuffle(spark):
    plan = M.keep_last(spark.range(10).select(F.lit("k").alias("k"), "id"), "k", ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in text and "Window" not in text


def test_addresses_against_the_standard_library(spark):
    import ipaddress
    import random
    from pyspark.sql import functions as F
    rng = random.Random(5)
    texts_ = ["::", "::1", "1::", "::ffff:1.2.3.4", "2001:db8::1.2.3.4", "1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "FE80::A",
              "1:2:3:4:5:6:7", "1::2::3", ":::", "12345::", "g::", "1.2.3", "256.1.1.1", "", "x", None, "1:2:3:4:5:6:7:8:9", ":1", "1:",
              "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4.5"]
    for _ in range(200):
        whole = ipaddress.IPv6Address(rng.getrandbits(128) & ~(rng.getrandbits(1) * (0xFFFF << 16 * rng.randrange(8))))
        texts_ += [whole.compressed, whole.exploded.upper()]

    def plain(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        return int(ip) if ip.version == 6 else int(ip) | 0xFFFF << 32

    df = texts(spark, texts_)
    bits = {r["c"]: r for r in df.select("c", E.ip_halves(F.col("c")).alias("h"), *[
        E.network_of(E.ip_halves(F.col("c")), F.lit(n)).alias(f"n{n}") for n in (0, 1, 33, 64, 65, 127, 128)]).collect()}

    def joined(x, low):
        return ((x["hi"] & (1 << 64) - 1) << low) | (x["lo"] & (1 << 64) - 1)

    for text in texts_:
        got, want = bits[text], plain(text)
        assert (got["h"] and joined(got["h"], 64)) == want, text
        if want is not None:
            assert all(joined(got[f"n{n}"], max(0, n - 64)) == want >> 128 - n for n in (0, 1, 33, 64, 65, 127, 128))


def test_bitmaps_against_sets(spark):
    import random
    from pyspark.sql import functions as F
    from orderflux.plans import bitmaps as B
    rng = random.Random(6)
    data = [(rng.choice(["a", "b"]), f"u{rng.randrange(900)}" if rng.random() < 0.95 else None, f"2026-0{rng.randrange(1, 6)}-{rng.randrange(10, 28)}")
            for _ in range(3000)]
    # Numbers far apart, so that users lie in several buckets.
    df = spark.createDataFrame(data, "m string, user_id string, d string").withColumn("order_time", F.col("d").cast("timestamp"))
    numbers = B.user_numbers(df)
    got = sorted(r["number"] for r in numbers.collect())
    assert got == list(range(1, len({u for _, u, _ in data if u}) + 1))
    bits = B.user_bitmaps(df, numbers.withColumn("number", F.col("number") * 100), "m")
    assert bits.select("bucket").distinct().count() > 2

    def users(match):
        return len({u for m, u, d in data if u and match(m, d)})

    assert {r["period"].isoformat(): r["users"] for r in B.distinct_users(bits, grain="month").collect()} == {
        f"2026-0{k}-01": users(lambda m, d: d[6] == str(k)) for k in range(1, 6)}
    assert {(r["m"], r["period"].isoformat()): r["users"] for r in B.distinct_users(bits, "m", grain="day").collect()} == {
        (m, d): users(lambda a, b: (a, b) == (m, d)) for m, u, d in data if u}
    for r in B.returning_users(bits, "m").collect():
        k = r["month"].month
        now, before = ({u for m, u, d in data if u and m == r["m"] and d[6] == str(x)} for x in (k, k - 1))
        assert (r["users"], r["repeat_users"]) == (len(now), len(now & before))


def test_bitmaps_of_thinly_spread_users_are_small(spark):
    """A day with one user of many takes a few bytes, and the sixty-fourth bit of a row counts like any other."""
    from pyspark.sql import functions as F
    from orderflux.plans import bitmaps as B
    df = spark.range(1, 2001).select(F.col("id").cast("string").alias("user_id"), F.lit("a").alias("m"),
                                     F.timestamp_seconds(F.col("id") * 86_400).alias("order_time"))
    numbers = df.select("user_id", F.col("user_id").cast("long").alias("number"))
    bits = B.user_bitmaps(df, numbers, "m")
    assert sum(len(r["users"]) if isinstance(r["users"], (bytes, bytearray)) else 8 for r in bits.collect()) <= 2000 * 8
    assert B.distinct_users(bits).first()["users"] == 2000
    assert {r["users"] for r in B.distinct_users(bits, grain="day").collect()} == {1}


def plain_ridge(x, y, alpha=1.0):
    """Ridge on standardised features with a free intercept; returns a predictor."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std == 0] = 1.0
    z = (x - mean) / std
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda row: float(((row - mean) / std) @ beta + y.mean())


def plain_forecast(pdf, horizon_days):
    """Validation and forecast rows of ridge and baseline for one series."""
    pdf = pdf.sort_values("day")
    days, values = pd.to_datetime(pdf["day"]).reset_index(drop=True), pdf["revenue"].to_numpy(float)
    x = np.array([FC._features(values[:i], i, days[i]) for i in range(FC.OFFSET, len(values))])
    y = np.log1p(values[FC.OFFSET:])
    out = []
    for start, end in FC.fold_bounds(len(x)):
        predict = plain_ridge(x[:start], y[:start])
        for i in range(start, end):
            out.append(("validation", days[i + FC.OFFSET], FC.RIDGE, values[i + FC.OFFSET],
                        max(0.0, np.expm1(predict(x[i])))))
            same = [values[j] for j in (i + FC.OFFSET - k for k in (28, 21, 14, 7)) if j >= 0]
            out.append(("validation", days[i + FC.OFFSET], FC.BASELINE, values[i + FC.OFFSET], float(np.mean(same))))
    predict, path, base = plain_ridge(x, y), list(values), list(values)
    for step in range(1, horizon_days + 1):
        day = days.iloc[-1] + pd.Timedelta(days=step)
        path.append(max(0.0, np.expm1(predict(FC._features(np.array(path[-28:]), len(values) + step - 1, day)))))
        base.append(float(np.mean([base[-k] for k in (7, 14, 21, 28)])))
        out.append(("forecast", day, FC.RIDGE, np.nan, path[-1]))
        out.append(("forecast", day, FC.BASELINE, np.nan, base[-1]))
    return {(kind, day.date(), model): value for kind, day, model, _, value in out}


def test_ridge_and_steps_against_the_series_by_series_way(spark):
    """Gram sums and steps for all series at once, against the forecasts that one task makes for one series."""
    import math
    from pyspark.sql import functions as F
    days = spark.range(140).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("m"), F.col("id"))
    value = F.when(F.col("m") == "c", 100.0).otherwise(500 + 90 * F.sin(F.col("id") / 3.0) + F.pmod(F.xxhash64("id", "m"), F.lit(997)) / 9.0)
    series = days.where("m <> 'b' or id < 61").select("m", F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
                                                      value.alias("revenue"), F.col("id").cast("int").alias("t"))

    def rows(df):
        return {(r["m"], r["kind"], r["day"], r["model"]): r["predicted"] for r in df.collect()}

    want = {(m, *key): value for m, pdf in series.toPandas().groupby("m") for key, value in plain_forecast(pdf, 28).items()}
    got = rows(FC.linear_forecasts(series, "m", horizon_weeks=3))
    assert set(got) == set(want)
    for key, value in got.items():
        assert math.isclose(value, want[key], rel_tol=1e-6), key
