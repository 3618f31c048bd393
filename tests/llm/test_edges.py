"""Every corpus operator on odd rows, clashing names and empty tables."""

import pytest

from llm_tables import LABELS
from orderflux.llm import (chunks, decontaminate, edit_fingerprint, language, licenses, line_dedup, mixing, pii, quality,
                           simhash)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0), (5, 0, 1), (6, 7, 0)],
                                 LABELS)


def items(spark):
    return spark.createDataFrame([(1, "one plain line of text and a second line here"), (2, None), (None, ""),
                                  (3, "two words")], "item_id long, text string")


def scored(docs):
    return quality.score_quality(docs, quality.train(docs, labels(docs.sparkSession)))


REPORTS = {
    "simhash": simhash.near_copies,
    "lines": lambda d: line_dedup.dedup_lines(d, report=True),
    "licences": licenses.scan_licenses,
    "chunks": chunks.passage_report,
    "pii": pii.find_pii,
    "language": lambda d: language.identify(d, language.train(d)),
    "benchmark": lambda d: decontaminate.contamination(d, items(d.sparkSession)),
    "quality": scored,
    "mix": mixing.mix,
    "fingerprints": edit_fingerprint.edited_fingerprints,
}
TABLES = {
    "lines": line_dedup.dedup_lines,
    "chunks": chunks.dedup_substrings,
    "copies": simhash.keep_one,
    "benchmark": lambda d: decontaminate.clean(d, items(d.sparkSession)),
    "quality": lambda d: quality.accepted(d, quality.train(d, labels(d.sparkSession))),
    "mix": mixing.mixed,
}


@pytest.mark.parametrize("name", REPORTS)
def test_report_has_a_row_for_each_row(odd, name):
    out = REPORTS[name](odd)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", REPORTS)
def test_report_of_nothing(empty, name):
    assert REPORTS[name](empty).collect() == []


@pytest.mark.parametrize("name", TABLES)
def test_table_keeps_its_columns(odd, empty, name):
    out = TABLES[name](odd)
    assert out.columns == odd.columns and out.count() > 0
    assert TABLES[name](empty).collect() == []


def test_null_texts_stay_null(odd):
    for name in ("lines", "chunks"):
        out = TABLES[name](odd)
        assert out.where("text is null").count() == 3 and out.where("doc_id = 4 and text = ''").count() == 1


def test_equal_rows_get_equal_results(odd):
    for name in ("simhash", "licences", "pii", "language", "quality", "lines"):
        rows = [tuple(map(str, r)) for r in REPORTS[name](odd).where("doc_id = 2").collect()]
        assert len(rows) == 3 and max(map(rows.count, rows)) >= 2, name


def test_unknown_texts(odd):
    got = {r["doc_id"]: r for r in REPORTS["language"](odd).collect() if r["doc_id"] in (3, 4, 6, 8)}
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got.values()) and len(got) == 4
