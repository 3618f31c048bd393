"""Small tables for the tests of the corpus operators."""

SF_DIR = "/root/testdata/sf0.001"
LONG = "long words run on and on in this text " * 30_000
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, mark long, id long, _id string, "
          "code long, fingerprint string, size long, words string, range int, k int, spans string, label int")
LABELS = "doc_id long, quality int, toxic int"
EXTRA = (7, 7, "x", 7, "x", 7, "x", 7, 7, "x", 7)


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in rows], SCHEMA)
