"""Order id index, commits of two writers at once, retention, freshness of the sources."""

import os

import pytest

from orderflux.plans import imports as I
from orderflux.plans import revenue as R
from orderflux.sources import key_index as K
from orderflux.sources import storage
from test_import import AGENT, MASTER, agent_row, day_one, master_row, write

SCHEMA = "`订单号` string, `订单时间` string, `实际支付` string, `订单状态` string"


def batch(spark, *rows):
    """Rows (order id, month, paid, status)."""
    return spark.createDataFrame([(o, f"{m}-05 10:00:00", p, s) for o, m, p, s in rows], SCHEMA)


def one(spark, oid, month, paid="1", status="充值成功"):
    return batch(spark, (oid, month, paid, status))


def ids(spark, root):
    return {r["order_id"]: r["order_month"] for r in I.read_fact(spark, root).collect()}


def test_lookup_reads_only_buckets_that_may_hold_an_id(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(f"k{i}", "master", f"2026-{i % 12 + 1:02d}") for i in range(500)],
                                 "id string, segment string, month string")
    K.add(spark, root, rows.limit(400), {"master": 1}, follows=True)
    K.add(spark, root, rows.where("id >= 'k400'"), {"master": 2}, follows=True)
    n = storage.manifest(spark, K.table_of(root))["n_buckets"]
    buckets = {r["id"]: r["bucket"] for r in K.bucketed(rows.select("id"), n, 8).collect()}

    def look(*wanted):
        found, read = K.lookup(spark, root, spark.createDataFrame([(i,) for i in wanted], "id string"))
        return {(r["id"], r["month"]) for r in found.collect()}, read

    for some in (["k7"], ["k7", "k499", "k8"], ["k7", "new", None, "k7"]):
        found, read = look(*some)
        known = [i for i in some if i in buckets]
        assert found == {(i, f"2026-{int(i[1:]) % 12 + 1:02d}") for i in known}
        assert set(read) <= {buckets[i] for i in known} and len(read) < n
    assert look("new", "other", "third") == (set(), [])               # filters rule them out: no entry is read

    # A newer entry of an id wins, also after its bucket was merged.
    for version in range(3, 13):
        K.add(spark, root, spark.createDataFrame([("k7", "master", f"2030-{version - 2:02d}")], rows.schema),
              {"master": version}, follows=True)
    assert look("k7")[0] == {("k7", "2030-10")}
    assert buckets["k7"] in K.compact(spark, root, 8)
    entry = storage.manifest(spark, K.table_of(root))
    assert len(entry["buckets"][str(buckets["k7"])]) == 1 and entry["sources"] == {"master": 12}
    assert look("k7")[0] == {("k7", "2030-10")} and look("k499")[0] == {("k499", "2026-08")}
    # An addition out of turn does not claim what it does not hold.
    K.add(spark, root, rows.limit(1), {"master": 14}, follows=True)
    assert storage.manifest(spark, K.table_of(root))["sources"] == {"master": 12}


def test_batch_reads_only_the_months_it_changes(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    I.append_batch(spark, root, batch(spark, *[(f"o{m}", f"2025-{m:02d}", "5", "充值成功") for m in range(1, 13)]), "master", "a")
    read = []
    real = storage.read_months

    def seen(session, table, columns=None, months=None, entry=None):
        read.append((table, months))
        return real(session, table, columns, months, entry)

    for module in (I, K, storage):
        monkeypatch.setattr(module, "read_months", seen)
    out = I.append_batch(spark, root, batch(spark, ("o3", "2025-03", "6", "充值成功"), ("new", "2025-05", "1", "充值成功")), "master", "b")
    assert (out["added"], out["duplicates"], out["restated"], out["total_rows"]) == (1, 1, 1, 13)
    assert {t for t, _ in read} == {f"{root}/store/master"}
    assert all(months <= {"2025-03", "2025-05"} for _, months in read)
    assert len(out["buckets_read"]) <= 2


def test_index_after_a_crash_and_a_rebuild(spark, tmp_path, monkeypatch):
    data, root = tmp_path / "data", str(tmp_path / "db")
    I.append_batch(spark, root, one(spark, "1", "2026-01"), "master", "a")
    monkeypatch.setattr(K, "add", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        I.append_batch(spark, root, one(spark, "2", "2026-02"), "master", "b")
    monkeypatch.undo()
    assert ids(spark, root) == {"1": "2026-01"}                       # in the store, not yet in index and fact
    assert I.append_batch(spark, root, one(spark, "2", "2026-02"), "master", "b")["skipped"]
    out = I.append_batch(spark, root, one(spark, "2", "2026-03"), "master", "c")
    assert out["added"] == 0 and ids(spark, root) == {"1": "2026-01", "2": "2026-03"}
    day_one(data)
    I.full_rebuild(spark, str(data), root, dry_run=False)             # order 1 is gone, 2 is another one
    out = I.append_batch(spark, root, batch(spark, ("1", "2026-01", "1", "x"), ("900", "2026-01", "1", "x")), "master", "d")
    assert (out["added"], out["total_rows"]) == (2, 5)
    assert not storage.manifest(spark, f"{root}/fact")["unique"]      # 900 is an agent's order as well


@pytest.mark.parametrize("theirs, merges", [
    ([("9", "2026-07")], 1), ([("9", "2026-01")], 2), ([("2", "2026-07")], 2), ([("1", "2026-02"), ("8", "2026-08")], 2)])
def test_two_batches_at_once(spark, tmp_path, monkeypatch, theirs, merges):
    """The other batch commits between this one's reading and its own commit."""
    root = str(tmp_path)
    I.append_batch(spark, root, batch(spark, ("1", "2026-01", "1", "x"), ("5", "2026-05", "1", "x")), "master", "start")
    real, calls = I.write_months, []

    def late(df, table, **options):
        if table.endswith("store/master"):
            calls.append(table)
            if len(calls) == 1:
                monkeypatch.setattr(I, "write_months", real)
                I.append_batch(spark, root, batch(spark, *[(o, m, "7", "x") for o, m in theirs]), "master", "other")
                monkeypatch.setattr(I, "write_months", late)
        return real(df, table, **options)

    monkeypatch.setattr(I, "write_months", late)
    I.append_batch(spark, root, batch(spark, ("1", "2026-01", "3", "x"), ("2", "2026-02", "3", "x")), "master", "mine")
    assert len(calls) == merges
    want = {"1": "2026-01", "5": "2026-05", **dict(theirs), "2": "2026-02"} | {"1": "2026-01"}
    assert ids(spark, root) == want
    entry = storage.manifest(spark, f"{root}/store/master")
    assert entry["batches"] == ["start", "other", "mine"] and sum(entry["rows"].values()) == len(want)
    found, _ = K.lookup(spark, root, spark.createDataFrame([(k,) for k in want], "id string"))
    assert {r["id"]: r["month"] for r in found.collect()} == want


def test_store_stays_bounded_over_fifty_batches(spark, tmp_path):
    table = str(tmp_path / "t")
    sizes = []
    for k in range(50):
        rows = spark.createDataFrame([(k, f"2026-{k % 3 + 1:02d}")], f"id long, {storage.MONTH} string").coalesce(1)
        storage.write_months(rows, table, batch=f"b{k}")
        storage.retain(spark, table, versions=4, seconds=0)
        sizes.append(sum(len(files) for _, _, files in os.walk(table)))
    # One small marker a batch is all that grows once the manifests no longer list it.
    assert max(sizes[20:50]) <= max(sizes[10:20])
    assert len(os.listdir(f"{table}/_manifest")) <= 8 and len(os.listdir(f"{table}/data")) <= 7
    assert sorted(r["id"] for r in storage.read_months(spark, table).collect()) == [47, 48, 49]


def test_batch_ids_outlive_the_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "LISTED_BATCHES", 2)
    table = str(tmp_path / "t")
    for k in range(5):
        storage.write_months(spark.createDataFrame([(k, "2026-01")], f"id long, {storage.MONTH} string"), table, batch=f"b{k}")
    head = storage.manifest(spark, table)
    assert head["batches"] == ["b3", "b4"]
    assert [storage.holds_batch(spark, table, head, f"b{k}") for k in range(6)] == [True] * 5 + [False]


def test_readers_and_young_writers_are_left_alone(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = [spark.createDataFrame([(k, "2026-01")], f"id long, {storage.MONTH} string") for k in range(3)]
    storage.write_months(rows[0], table)
    reader = storage.read_months(spark, table)
    storage.write_months(rows[1], table)
    rows[2].write.partitionBy(storage.MONTH).parquet(f"{table}/data/version=00000003-young")
    assert storage.retain(spark, table, versions=1, seconds=3600) == 0
    assert [r["id"] for r in reader.collect()] == [0]
    assert storage.retain(spark, table, versions=1, seconds=0) == 2
    assert [r["id"] for r in storage.read_months(spark, table).collect()] == [1]


def test_maintenance_keeps_every_row(spark, tmp_path):
    root = str(tmp_path)
    for k in range(3):
        I.append_batch(spark, root, one(spark, str(k), "2026-01"), "master", f"b{k}")
    removed = I.maintain(spark, root, versions=1, seconds=0)
    assert removed["master"] == 2 and removed["fact"] == 2
    assert I.append_batch(spark, root, one(spark, "0", "2026-02"), "master", "b9")["added"] == 0
    assert ids(spark, root) == {"0": "2026-02", "1": "2026-01", "2": "2026-01"}


def test_source_freshness(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "db")
    day_one(data)

    def fresh():
        return {r["segment"]: (r["files"], r["newer"], r["stale"]) for r in I.source_freshness(spark, str(data), root).collect()}

    assert fresh() == {"agent": (1, 1, True), "master": (1, 1, True)}
    I.import_new_daily(spark, str(data), root, dry_run=False)
    assert fresh() == {"agent": (1, 0, False), "master": (1, 0, False)}
    path = data / "Agent Data" / "2026-02-04.csv"
    write(path, AGENT, [agent_row("902")])
    os.utime(path, (2_000_000_000, 2_000_000_000))
    assert fresh() == {"agent": (2, 1, True), "master": (1, 0, False)}
    I.full_rebuild(spark, str(data), root, dry_run=False)
    assert fresh() == {"agent": (2, 0, False), "master": (1, 0, False)}


def test_discount_depth_of_the_published_fact(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "db")
    write(data / "Master Data" / "a.csv", MASTER, [
        master_row("1", paid="9", listed="12"), master_row("2", paid="6", listed="12"), master_row("3", paid="", listed="12")])
    I.import_new_daily(spark, str(data), root, dry_run=False)
    row = R.discount_depth(I.read_fact(spark, root), "segment").first()
    assert (row["discount_depth"], row["rows"]) == (0.375, 2)


def test_hash_sees_the_order_of_lines_and_not_the_splits(spark, tmp_path):
    from orderflux.sources import files as S
    lines = [master_row(str(k)) for k in range(400)]
    write(tmp_path / "a.csv", MASTER, lines)
    write(tmp_path / "b.csv", MASTER, [lines[1], lines[0], *lines[2:]])
    write(tmp_path / "c.csv", MASTER, lines)

    def hashes():
        return {r["path"][-5:]: r["file_hash"] for r in S.file_hashes(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv", "c.csv")]).collect()}

    whole = hashes()
    assert whole["a.csv"] == whole["c.csv"] != whole["b.csv"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert hashes() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("line, multiline", [
    ('1,"5"" screen",x', False), ("1,5\" screen,x", False), ('1,"two\nlines",x', True), ('"a,""b""",2,3', False), ('1,2,"x\n"', True)])
def test_only_fields_with_line_breaks_keep_a_file_whole(spark, tmp_path, line, multiline):
    from orderflux.sources import files as S
    path = tmp_path / "a.csv"
    path.write_text(f"订单号,a,b\n{line}\n3,4,5\n")
    assert next(iter(S.probe(spark, [str(path)]).values()))["multiline"] is multiline


def test_streamed_digest_follows_restatements(spark, tmp_path):
    from pyspark.sql import functions as F
    from orderflux.streaming.digest import exception_digest, streamed_digest
    from orderflux.streaming.ingest import ingest_folder
    root = str(tmp_path / "db")
    heads = [*MASTER, "运营商", "接口商订单号"]
    drops = [[(str(k), "充值成功", f"2026-01-{k % 9 + 1:02d} 10:00:00", f"Op{k % 3}", "--" if k % 2 else "x") for k in range(30)],
             [(str(k), "已退款", f"2026-02-{k % 9 + 1:02d} 10:00:00", "Op9", "x") for k in range(0, 30, 4)] + [("", "充值成功", "2026-03-01", "Op0", "--")],
             [(str(k), "充值成功", "2026-01-02 10:00:00", "Op1", "--") for k in range(0, 12, 4)]]
    for n, rows in enumerate(drops):
        write(tmp_path / "in" / f"{n}.csv", heads, [[*master_row(o, time=t, status=s), op, i] for o, s, t, op, i in rows])
        ingest_folder(spark, str(tmp_path / "in"), root, str(tmp_path / "state"))
        limits = (F.lit("2026-04-01").cast("date"), 0.0, 0, 0)
        fact = I.read_fact(spark, root, enriched=True)
        want = {tuple(r) for r in exception_digest(fact, *limits).collect()}
        assert {tuple(r) for r in streamed_digest(spark, root, *limits).collect()} == want and len(want) > 3
