"""Substring de-duplication by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from orderflux.llm.common import col, fresh, text_of

#: One byte in so many may end a chunk, unless another such byte stands among the ``GAP`` before it.
RARE, GAP = 24, 16
#: Of a passage: bytes of its repeated whole chunks, and words of these and the two chunks that it may reach into.
LEAST_BYTES, LEAST_WORDS = 24, 51
#: Bytes at the beginning of a passage within which the text before it can set other ends of chunks.
SHIFT = 16 + GAP
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_GEAR = np.random.default_rng(4).integers(0, 1 << 16, 256, np.uint16)


def chunk_ends(data: bytes) -> np.ndarray:
    """Ends of the chunks of a text in UTF-8, the last being its length.

    The gear hash ``h = (h << 1) + gear[byte]`` has 16 bits, so it depends on the last 16 bytes alone. It is summed for
    all places at once by doubling. A chunk ends where the hash is small, and before a whole character; whether it does
    follows from the bytes close by, so that insertions elsewhere do not shift it.
    """
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        more = h.copy()
        more[k:] += h[:-k] << np.uint16(k) if len(h) > k else 0
        h = more
    small = np.flatnonzero(h < (1 << 16) // RARE) + 1
    small = small[np.diff(small, prepend=-GAP) >= GAP]
    small = small[small < len(raw)]
    return np.r_[small[(raw[small] & 0xC0) != 0x80], len(raw)] if len(raw) else np.zeros(0, int)


def words_around(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words between blanks that begin in each chunk, in what may belong to a passage before it, and in the chunk after it.

    Near the beginning of a passage the bytes before it can move an end of a chunk by ``SHIFT``; so what a passage may reach
    into is the chunk before and so many bytes more.
    """
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    begun = np.r_[0, np.cumsum(~blank & np.r_[True, blank[:-1]])] if len(blank) else np.zeros(1, int)
    words = begun[ends] - begun[starts]
    if not len(ends):
        return np.zeros((3, 0), int)
    reach = np.maximum(np.r_[0, starts[:-1]] - SHIFT, 0)
    return np.stack([words, begun[starts] - begun[reach], np.r_[words[1:], 0]])


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All chunks: (id, mark, k, start, size, words, before, after, d1, d2): number, first byte, bytes, words that begin in
    the chunk and in its neighbours, and its 128-bit digest; ``mark`` is the text's hash."""
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("mark"),
                       text_of(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                owner, parts, digests = [], [], []
                for n, text in enumerate(part.column("text")):
                    data = text.as_py().encode("utf-8", "surrogatepass")
                    ends = chunk_ends(data)
                    starts = np.r_[0, ends[:-1]] if len(ends) else ends
                    size = ends - starts
                    owner += [n] * len(ends)
                    parts.append(np.concatenate([np.stack([np.arange(len(ends)), starts, size]),
                                                 words_around(data, starts, ends)]))
                    digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                values = np.concatenate(parts, axis=1).astype(np.int32)
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                own = part.select(["id", "mark"]).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *map(pa.array, values), pa.array(both[:, 0]), pa.array(both[:, 1])],
                    names=["id", "mark", "k", "start", "size", "words", "before", "after", "d1", "d2"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, mark long, k int, start int, size int, words int, before int, "
                                "after int, d1 long, d2 long")


def _runs(kind):
    """Passages from the repeated chunks of a text: runs of consecutive chunks that are long enough."""
    schema = StructType([StructField("spans", ArrayType(StructType([
        StructField("start", LongType()), StructField("end", LongType())]))), StructField("earlier", ArrayType(kind))])

    @F.pandas_udf(schema)
    def runs(found: pd.Series) -> pd.DataFrame:
        all_spans, all_ids = [], []
        for chunks in found:
            spans, ids, run = [], [], []
            for c in [*chunks, None]:
                if run and (c is None or c["k"] != run[-1]["k"] + 1):
                    words = sum(r["words"] for r in run) + run[0]["before"] + run[-1]["after"]
                    if sum(r["size"] for r in run) >= LEAST_BYTES and words >= LEAST_WORDS:
                        spans.append({"start": run[0]["start"], "end": run[-1]["start"] + run[-1]["size"]})
                        ids += [r["first"] for r in run if r["first"] is not None]
                    run = []
                if c is not None:
                    run.append(c)
            all_spans.append(spans)
            all_ids.append(sorted(set(ids)))
        return pd.DataFrame({"spans": all_spans, "earlier": all_ids})
    return runs


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of each text that stand earlier in some text: (id, mark, spans, earlier), texts with any only.

    Chunks are ordered by id (null first), text hash and place. Of equal chunks the first stays; runs of
    later ones that come to ``LEAST_BYTES``, and with the chunks on both sides to ``LEAST_WORDS``, are passages.
    ``spans`` are their places in bytes and ``earlier`` the ids of the first chunks (the text's own id where it repeats
    itself). Rows alike in id and text count as one; null and empty texts have no chunk.

    Equal digests are counted before the shuffle and only the first of each repeated digest meets the chunks again, so a
    passage that a third of all texts share costs one row a text, and its join can be split.
    """
    chunks = chunk_rows(docs, id_col, text_col)
    place = F.struct("id", "mark", "k")
    first = chunks.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = chunks.join(first, ["d1", "d2"]).where(place > F.col("first"))
    found = later.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct(
        "k", "start", "size", "words", "before", "after", F.col("first.id").alias("first")))).alias("chunks"))
    runs = _runs(docs.schema[id_col].dataType)
    return found.withColumn("x", runs("chunks")).select("id", "mark", "x.spans", "x.earlier").where(F.size("spans") > 0)


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, earlier_ids) for every row: see :func:`repeated_passages`.

    ``spans`` is a text of ``start:end`` in bytes, comma-joined, and empty where nothing is repeated.
    """
    found = repeated_passages(docs, id_col, text_col)
    found = found.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans"), "earlier")
    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"),
                       F.octet_length(text_of(text_col)).cast("bigint").alias("n_bytes"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    none = F.array().cast(dict(found.dtypes)["earlier"])
    return joined.select(
        "doc_id", "n_bytes",
        F.coalesce(F.aggregate("_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]),
                   F.lit(0)).alias("n_removed"),
        F.coalesce(F.array_join(F.transform("_spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ","),
                   F.lit("")).alias("spans"), F.coalesce("earlier", none).alias("earlier_ids"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans):
        if text is not None and found is not None:
            data, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
            for x in found:
                kept.append(data[at:x["start"]])
                at = x["end"]
            text = b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")
        out.append(text)
    return pd.Series(out, dtype=object)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages of :func:`repeated_passages`; every row and column stays, null texts stay null."""
    found = repeated_passages(docs, id_col, text_col)
    spans = fresh(docs, "spans")
    found = found.select(F.col("id").alias(fresh(docs, "id")), F.col("mark").alias(fresh(docs, "mark")),
                         F.col("spans").alias(spans))
    joined = docs.join(found, col(id_col).eqNullSafe(F.col(found.columns[0]))
                       & (F.xxhash64(text_of(text_col)) == F.col(found.columns[1])), "left")
    return joined.withColumn(text_col, _without(col(text_col), F.col(spans))).select(*[col(c) for c in docs.columns])
