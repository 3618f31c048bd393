"""Large files: no step puts all rows of one file into one task, or sorts all lines of it."""

from contextlib import contextmanager

from orderflux.plans import imports as I
from orderflux.sources import files as S


@contextmanager
def settings(spark, **values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def delivered(tmp_path, name, remark):
    lines = [f'{k},1,2024-01-{k % 28 + 1:02d} 13:00:00,7,{remark}' for k in range(300)]
    path = tmp_path / name
    path.write_text("\n".join(["订单号,售价,订单时间,用户ID,备注", *lines, ""]), "utf-8")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probe_sorts_no_lines(spark, tmp_path):
    paths = [delivered(tmp_path, "a.csv", "x"), delivered(tmp_path, "b.csv", '"two\nlines"')]
    seen = S._looked_over(spark, paths)
    assert "ObjectHashAggregate" in plan(seen) and "Sort" not in plan(seen)
    assert [(r["open"], r["plain"]) for r in seen.orderBy("path").collect()] == [(False, True), (True, True)]


def test_date_choice_moves_no_rows(spark, tmp_path):
    path = delivered(tmp_path, "a.csv", "x")
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "1000"}):
        rows = I.clean_files(spark, [path])[0][0].rows.rows
        assert "SortMergeJoin" not in plan(rows)
        assert rows.count() == 300


def test_rows_of_a_file_of_quoted_line_breaks_are_dealt_out(spark, tmp_path):
    path = delivered(tmp_path, "a.csv", '"two\nlines"')
    with settings(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        rows = S.read_data_file(spark, path)
        held = [n for n in rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
        assert sum(held) == 300 and len(held) > 1
        assert rows.filter("`备注` = 'two\nlines'").count() == 300


def test_last_row_is_kept_without_helpers(spark):
    rows = spark.createDataFrame([("1", "old", 0, 0, "f"), ("1", "new", 1, 0, "f"), (None, "x", 0, 1, "f")],
                                 f"`{I.KEY}` string, v string, {S.RANK} int, {S.SEQ} int, {S.FILE} string")
    out = I._latest(rows)
    assert out.columns == [I.KEY, "v"]
    assert sorted(map(tuple, out.collect()), key=str) == [("1", "new"), (None, "x")]


def test_cleaning_runs_in_methods_that_the_jvm_compiles(spark, tmp_path):
    with settings(spark, **{"spark.sql.codegen.hugeMethodLimit": "65535"}):
        I.clean_files(spark, [delivered(tmp_path, "a.csv", "x")])
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
