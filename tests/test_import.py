"""Files to fact, end to end: encodings, cleaning, merge, publication, replay, streaming."""

from pyspark.sql import functions as F

from orderflux.plans import imports as I
from orderflux.sources import files as S
from orderflux.sources.storage import manifest
from orderflux.streaming.ingest import ingest_folder

MASTER = ["用户ID", "国家", "订单时间", "注册时间", "订单号", "商品分类", "售价", "实际支付", "结算价", "订单状态", "优惠券金额"]
AGENT = ["批次号", "订单号", "订单时间", "运营商", "面额", "售价", "结算价", "订单状态", "代理商名称", "国家"]


def write(path, headings, rows, encoding="utf-8", sep=","):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [sep.join(headings)] + [sep.join(f'"{v}"' if sep in v else v for v in r) for r in rows]
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))


def master_row(oid, time="2026-01-05 10:00:00", paid="10", status="充值成功", listed="12", country="埃及"):
    return ["77.0", country, time, "2026-01-01 00:00:00", oid, "充话费", listed, paid, "8", status, ""]


def agent_row(oid, time="2026-02-03 09:00:00", listed="1,500.5"):
    return ["B1", oid, time, "Orange", "50", listed, "40", "充值成功", "Agent A", "印尼"]


def day_one(root):
    write(root / "Master Data" / "2026-01-05.csv", MASTER, [
        master_row("\t2026080112345678901"), master_row("2"), master_row("3", paid="-4"),
        master_row("4", time="junk"), master_row("5", paid="", listed="30")], "utf-8-sig")
    write(root / "Agent Data" / "2026-02-03.csv", AGENT, [agent_row("900"), agent_row("901")], "gb18030")


def test_probe_reads_encodings_separators_and_bom(spark, tmp_path):
    write(tmp_path / "a.csv", MASTER, [master_row("1")], "utf-8-sig")
    write(tmp_path / "b.csv", MASTER, [master_row("2")], "gb18030")
    write(tmp_path / "c.csv", MASTER, [master_row("3")], "utf-8", ";")
    layouts = S.read_exports(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv", "c.csv")])
    assert list(layouts) == [tuple(MASTER)]
    rows = {r["订单号"]: r for r in next(iter(layouts.values())).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert {r["国家"] for r in rows.values()} == {"埃及"}
    assert [rows[k][S.RANK] for k in "123"] == [0, 1, 2]


def test_unknown_extension_is_refused(spark, tmp_path):
    try:
        S.read_exports(spark, [str(tmp_path / "x.xlsx")])
    except ValueError as exc:
        assert "unsupported" in str(exc)
    else:
        raise AssertionError


def test_period_selection():
    assert S.select_periods(["Jul - Dec 2025", "2026", "2027", "Sheet1"], "Master Data") == [
        "Jul - Dec 2025", "2026", "2027"]
    assert S.select_periods(["Whole", "whole 2", "Jul - Dec 2025", "x"]) == ["Whole", "whole 2", "Jul - Dec 2025"]
    assert S.select_periods(["a", "b"], "Agent Data") == ["a"]


def test_read_periods_keeps_last(spark, tmp_path):
    write(tmp_path / "Master Data" / "2026" / "x.csv", MASTER, [master_row("1", paid="5")])
    write(tmp_path / "Master Data" / "2027" / "y.csv", MASTER, [master_row("1", paid="6")])
    write(tmp_path / "Master Data" / "Sheet1" / "z.csv", MASTER, [master_row("9")])
    rows = S.read_periods(spark, str(tmp_path), "Master Data").select("订单号", "实际支付").collect()
    assert [tuple(r) for r in rows] == [("1", "6")]


def test_daily_import_publish_restate_and_replay(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "db")
    day_one(data)
    dry = I.import_new_daily(spark, str(data), root)
    assert dry["import"] == {} and manifest(spark, f"{root}/fact") is None
    done = I.import_new_daily(spark, str(data), root, dry_run=False)
    m = done["import"]["master"]
    assert (m["added"], m["quarantined"], m["duplicates"], m["total_rows"]) == (3, 2, 0, 3)
    assert done["import"]["agent"]["added"] == 2

    fact = I.read_fact(spark, root)
    assert fact.schema["order_id"].metadata == {"unique": True}
    rows = {r["order_id"]: r for r in fact.collect()}
    assert set(rows) == {"2026080112345678901", "2", "5", "900", "901"}
    assert rows["2"]["country"] == "Egypt" and rows["900"]["country"] == "Indonesia"
    assert rows["5"]["sales"] == 30.0 and rows["2"]["sales"] == 10.0 and rows["900"]["sales"] == 1500.5
    assert rows["900"]["segment"] == "B2B" and rows["2"]["segment"] == "B2C"
    reasons = {r["reason"]: r["n"] for r in I.read_quarantine(spark, root).groupBy("reason").agg(
        F.count("*").alias("n")).collect()}
    assert reasons == {"negative amount": 1, "order time missing": 1}

    # unchanged files are skipped
    again = I.import_new_daily(spark, str(data), root, dry_run=False)
    assert again["import"] == {}

    # next day: one restated, one moved to another month, one new
    january = manifest(spark, f"{root}/store/agent")["partitions"]
    write(data / "Master Data" / "2026-01-06.csv", MASTER, [
        master_row("2", status="已退款"), master_row("5", time="2026-03-01 00:00:00", paid="", listed="30"),
        master_row("6", time="2026-03-02 00:00:00")])
    second = I.import_new_daily(spark, str(data), root, dry_run=False)["import"]["master"]
    assert (second["added"], second["duplicates"], second["restated"], second["total_rows"]) == (1, 2, 1, 4)
    assert second["restatement_samples"] == [
        {"order_id": "2", "field": "订单状态", "old": "充值成功", "new": "已退款"}]
    assert manifest(spark, f"{root}/store/agent")["partitions"] == january
    fact = {r["order_id"]: r for r in I.read_fact(spark, root).collect()}
    assert fact["2"]["order_status"] == "已退款" and fact["5"]["order_month"] == "2026-03" and len(fact) == 6
    months = {r[0] for r in I.read_fact(spark, root, months={"2026-03"}).select("order_id").collect()}
    assert months == {"5", "6"}
    assert I.read_fact(spark, root, ["order_id", "no_such_column"]).columns == ["order_id"]

    # the same batch id changes nothing
    version = manifest(spark, f"{root}/store/master")["version"]
    batch = manifest(spark, f"{root}/store/master")["batches"][-1]
    rows = S.read_exports(spark, [str(data / "Master Data" / "2026-01-06.csv")])
    from orderflux.operators.cleaning import clean
    skipped = I.append_batch(spark, root, clean(next(iter(rows.values())), "master").good, "master", batch)
    assert skipped["skipped"] and manifest(spark, f"{root}/store/master")["version"] == version

    # the same content under a new id is flagged, adds nothing and leaves the fact as it was
    rows = S.read_exports(spark, [str(data / "Master Data" / "2026-01-06.csv")])
    twice = I.append_batch(spark, root, clean(next(iter(rows.values())), "master").good, "master", "other")
    assert twice["duplicate_file"] and twice["added"] == 0 and twice["restated"] == 0
    assert {r["order_id"]: r["order_status"] for r in I.read_fact(spark, root).collect()} == {
        k: v["order_status"] for k, v in fact.items()}
    audit = I.read_audit(spark, root)
    assert audit.count() == 4 and audit.filter("duplicate_file").count() == 1
    status = {r["segment"]: r for r in I.import_status(spark, root).collect()}
    assert status["master"]["rows"] == 4 and not status["master"]["fact_stale"]


def test_overlapping_ids_clear_the_unique_mark(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "db")
    day_one(data)
    write(data / "Agent Data" / "b.csv", AGENT, [agent_row("2")])
    I.import_new_daily(spark, str(data), root, dry_run=False)
    assert I.read_fact(spark, root).schema["order_id"].metadata == {"unique": False}


def test_full_rebuild_equals_incremental(spark, tmp_path):
    data = tmp_path / "data"
    day_one(data)
    I.import_new_daily(spark, str(data), str(tmp_path / "a"), dry_run=False)
    write(data / "Master Data" / "2026-01-06.csv", MASTER, [master_row("2", status="已退款"), master_row("6")])
    I.import_new_daily(spark, str(data), str(tmp_path / "a"), dry_run=False)
    dry = I.full_rebuild(spark, str(data), str(tmp_path / "b"))
    assert dry["master"]["rows"] == 4 and not dry["applied"]
    assert I.full_rebuild(spark, str(data), str(tmp_path / "b"), dry_run=False)["applied"]
    a, b = (I.read_fact(spark, str(tmp_path / x)) for x in "ab")
    columns = sorted(set(a.columns))
    assert sorted(set(b.columns)) == columns
    assert a.select(columns).exceptAll(b.select(columns)).count() == 0
    assert b.select(columns).exceptAll(a.select(columns)).count() == 0
    assert I.import_new_daily(spark, str(data), str(tmp_path / "b"), dry_run=False)["import"] == {}


def test_streaming_ingest_is_incremental_and_replay_safe(spark, tmp_path):
    folder, root, ckpt = tmp_path / "in", str(tmp_path / "db"), str(tmp_path / "ckpt")
    write(folder / "1.csv", MASTER, [master_row("1"), master_row("2")])
    ingest_folder(spark, str(folder), root, ckpt)
    assert I.read_fact(spark, root).count() == 2
    write(folder / "2.csv", MASTER, [master_row("2", status="已退款"), master_row("3")])
    ingest_folder(spark, str(folder), root, ckpt)
    rows = {r["order_id"]: r["order_status"] for r in I.read_fact(spark, root).collect()}
    assert rows == {"1": "充值成功", "2": "已退款", "3": "充值成功"}
    version = manifest(spark, f"{root}/store/master")["version"]
    ingest_folder(spark, str(folder), root, ckpt)               # nothing new
    ingest_folder(spark, str(folder), root, str(tmp_path / "lost"), max_files=1)   # ids replayed
    assert manifest(spark, f"{root}/store/master")["version"] == version
    assert I.read_audit(spark, root).count() == 2


def test_user_list_newest_file(spark, tmp_path):
    for name, user in (("用户列表 20260101.csv", "1"), ("用户列表 20260623.csv", "2.0")):
        write(tmp_path / name, ["ID", "注册时间", "来源国家", "会员来源"], [[user, "2026-01-01", "埃及", "微信"]])
    from orderflux.plans.customers import clean_user_list
    rows = clean_user_list(S.newest_user_list(spark, str(tmp_path / "*.csv")), "ID").collect()
    assert [r["user_id"] for r in rows] == ["2"]


def test_batch_of_rejected_rows_only(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "db")
    write(data / "Master Data" / "a.csv", MASTER, [master_row("1", paid="-4"), master_row("2", time="")])
    out = I.import_new_daily(spark, str(data), root, dry_run=False)["import"]["master"]
    assert (out["added"], out["quarantined"], out["total_rows"]) == (0, 2, 0)
    assert I.read_fact(spark, root) is None
    write(data / "Master Data" / "b.csv", MASTER, [master_row("3")])
    I.import_new_daily(spark, str(data), root, dry_run=False)
    assert I.read_fact(spark, root).count() == 1


def test_bad_files_do_not_hold_up_the_others(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "db")
    write(data / "Master Data" / "a.csv", MASTER, [master_row("1")])
    write(data / "Master Data" / "b.csv", ["x", "y"], [["1", "2"]])
    write(data / "Master Data" / "c.csv", AGENT, [agent_row("900")])
    done = I.import_new_daily(spark, str(data), root, dry_run=False)
    assert [e["file"].rsplit("/", 1)[1] for e in done["errors"]] == ["b.csv"]
    rows = {r["order_id"]: r["segment"] for r in I.read_fact(spark, root).collect()}
    assert rows == {"1": "B2C", "900": "B2B"}
    write(data / "Master Data" / "b.csv", MASTER, [master_row("2")])
    I.import_new_daily(spark, str(data), root, dry_run=False)
    assert {r["order_id"] for r in I.read_fact(spark, root).collect()} == {"1", "2", "900"}


def test_late_bytes_decide_the_encoding_and_quoted_lines_stay_whole(spark, tmp_path):
    rows = [master_row(str(k), country="Egypt") for k in range(20_000)] + [master_row("last", country="埃及")]
    write(tmp_path / "a.csv", MASTER, rows, "gb18030")
    (tmp_path / "b.csv").write_text(",".join(MASTER) + "\n" + ",".join(
        '"line one\nline two"' if h == "国家" else "7" for h in MASTER) + "\n")
    got = next(iter(S.read_exports(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).values()))
    assert (tmp_path / "a.csv").stat().st_size > 1 << 20
    assert [r["国家"] for r in got.where("`订单号` = 'last'").collect()] == ["埃及"]
    assert [r["国家"] for r in got.where("`订单号` = '7' and `售价` = '7'").collect()] == ["line one\nline two"]
    assert got.count() == 20_002


def test_rebuild_forgets_files_that_were_absent(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "db")
    write(data / "Master Data" / "a.csv", MASTER, [master_row("1")])
    write(data / "Master Data" / "b.csv", MASTER, [master_row("2")])
    I.import_new_daily(spark, str(data), root, dry_run=False)
    text = (data / "Master Data" / "b.csv").read_bytes()
    (data / "Master Data" / "b.csv").unlink()
    I.full_rebuild(spark, str(data), root, dry_run=False)
    assert I.read_fact(spark, root).count() == 1
    (data / "Master Data" / "b.csv").write_bytes(text)
    I.import_new_daily(spark, str(data), root, dry_run=False)
    assert I.read_fact(spark, root).count() == 2


def test_two_writers_lose_no_row(spark, tmp_path, monkeypatch):
    from orderflux.sources import storage
    table = str(tmp_path / "t")
    rows = [spark.createDataFrame([(k, "2026-01")], f"id long, {storage.MONTH} string") for k in range(3)]
    storage.write_months(rows[0], table, months=[])
    real = storage.create_text

    def late(session, path, text):
        """The other writer publishes while this one has only written its files."""
        monkeypatch.setattr(storage, "create_text", real)
        storage.write_months(rows[2], table, replace=True)
        real(session, path, text)
    monkeypatch.setattr(storage, "create_text", late)
    try:
        storage.write_months(rows[1], table, replace=True)
        raise AssertionError
    except AssertionError:
        raise
    except Exception as exc:
        assert "exist" in str(exc).lower()
    assert [r["id"] for r in storage.read_months(spark, table).collect()] == [2]


def test_stream_reads_each_file_by_its_own_headings(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "db")
    write(folder / "1.csv", MASTER, [master_row("1", paid="10", listed="12")])
    write(folder / "2.csv", MASTER[::-1], [master_row("2", paid="10", listed="12")[::-1]], "gb18030")
    write(folder / "3.csv", AGENT, [agent_row("900")], "gb18030", ";")
    write(folder / "4.csv", ["nothing"], [["x"]])
    ingest_folder(spark, str(folder), root, str(tmp_path / "ckpt"))
    rows = {r["order_id"]: (r["sales_paid"], r["sales_listed"], r["country"]) for r in I.read_fact(spark, root).collect()}
    assert rows["1"] == rows["2"] == (10.0, 12.0, "Egypt") and rows["900"][2] == "Indonesia"
    assert spark.read.json(f"{root}/errors").count() == 1
