"""Line de-duplication over three-line windows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflux.llm.common import col, fresh, text_of

BLANKS = " \t\r"


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Lines that later occurrences of repeated windows cover: rows (id, mark, covered).

    Lines end at ``\\n``; they are compared without blanks at their ends, and blank lines take no part. Every run of
    ``window`` consecutive lines is a window. Windows are ordered by id (null first), text hash and position; the
    first of equal windows stays and each later one covers its lines. ``mark`` is the hash of the text, which tells
    rows of one id apart, and ``covered`` the merged line numbers from 0. Rows alike in id and text count as one.
    Texts with fewer than ``window`` lines, empty and null ones have no window.

    One aggregate (reduced before its shuffle) finds the first of each repeated window, one join on the window's hash
    finds the later ones; only hashes and numbers are shuffled, and a hot window is split by the skew join.
    """
    lines = F.transform(F.split(text_of(text_col), "\n", -1), lambda x, i: F.struct(
        F.btrim(x, F.lit(BLANKS)).alias("line"), i.alias("n")))
    full = F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: F.struct(
        F.xxhash64(x["line"]).alias("h"), x["n"].alias("n")))
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("mark"),
                       F.explode(F.array(full)).alias("full"))
    each = F.when(F.size("full") >= window, F.transform(
        F.sequence(F.lit(0), F.size("full") - window),
        lambda i: F.struct(*[F.get("full", i + k)["h"].alias(f"h{k}") for k in range(window)],
                           F.transform(F.slice("full", i + 1, window), lambda x: x["n"]).alias("lines"))))
    flat = rows.select("id", "mark", F.explode(each).alias("w"))
    hashes = [F.col(f"w.h{k}") for k in range(window)]
    windows = flat.select(
        "id", "mark", "w.lines", F.xxhash64(*hashes).alias("k1"), F.xxhash64(F.lit(1), *hashes[::-1]).alias("k2"))
    place = F.struct("id", "mark", F.get("lines", F.lit(0)).alias("at"))
    first = (windows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("times"))
             .where("times > 1").select("k1", "k2", "first"))
    later = windows.join(first, ["k1", "k2"]).where(place > F.col("first"))
    return later.groupBy("id", "mark").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3,
                report: bool = False) -> DataFrame:
    """``docs`` without the lines that :func:`repeated_lines` covers; every row and column stays.

    A text that loses all its lines becomes empty, a null text stays null. With ``report`` the result is the id, the
    new text and the number of removed lines instead of the columns of ``docs``.
    """
    hits = repeated_lines(docs, id_col, text_col, window)
    cover = fresh(docs, "covered")
    hits = hits.select(F.col("id").alias(fresh(docs, "id")), F.col("mark").alias(fresh(docs, "mark")),
                       F.col("covered").alias(cover))
    joined = docs.join(hits, col(id_col).eqNullSafe(F.col(hits.columns[0]))
                       & (F.xxhash64(text_of(text_col)) == F.col(hits.columns[1])), "left")
    lines = F.split(text_of(text_col), "\n", -1)
    name = fresh(docs, "lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(name) - 1), F.col(cover))
    # The exploded array keeps the split from being repeated for every line of the lambda.
    cut = (joined.withColumn(name, F.explode(F.array(F.when(F.col(cover).isNotNull(), lines))))
           .withColumn(text_col, F.when(F.col(cover).isNull(), col(text_col)).otherwise(
               F.array_join(F.transform(kept, lambda i: F.get(name, i)), "\n"))))
    if report:
        return cut.select(
            col(id_col).alias("doc_id"), col(text_col).alias("text"),
            F.coalesce(F.size(F.col(cover)), F.lit(0)).cast("bigint").alias("n_removed"))
    return cut.select(*[col(c) for c in docs.columns])
