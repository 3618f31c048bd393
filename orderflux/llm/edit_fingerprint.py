"""Document fingerprints by a randomised edit embedding with bit-sampled banding."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from orderflux.llm.common import col, stable, text_of

#: Sampled places of the embedding (one byte of the fingerprint each).
SAMPLES = 64
LIKENESS = 0.8
#: Samples in which near fingerprints may differ; they agree on one of one more bands.
UNLIKE = int(SAMPLES * (1 - LIKENESS) + 1e-9)
#: Fingerprints beyond which a bucket is dealt again by bands of the other samples, and side by side in a tile.
LARGE, TILE = 2048, 256
#: Steps after which the random walk's choices repeat, and classes of characters that share them.
PERIOD, CLASSES = 1 << 12, 256
#: Characters whose steps are held at once, and texts on the way below which each goes alone.
CELLS, FEW = 1 << 20, 24
_rng = np.random.default_rng(20)
#: moves[c, s]: whether the walk leaves a character of class c at step s.
_MOVES = _rng.integers(0, 2, (CLASSES, PERIOD), np.uint8).astype(bool)
_SYMBOL = _rng.integers(0, 256, (SAMPLES, CLASSES), np.uint8)


def _stays() -> np.ndarray:
    """Steps the walk spends on a character of each class that it reaches at each step of the period."""
    twice = np.concatenate([_MOVES, _MOVES], axis=1)
    left = np.full((CLASSES, 2 * PERIOD + 1), PERIOD, np.int64)
    for s in range(2 * PERIOD - 1, -1, -1):
        left[:, s] = np.where(twice[:, s], 1, left[:, s + 1] + 1)
    return left[:, :PERIOD].ravel()


def _records() -> list[list[int]]:
    """For each sample the steps at which a stream of random values has a new minimum, in rising order.

    The last of them below T is the place of the smallest of the first T values: uniform over the steps of a walk of T
    steps, and the same for walks of nearly the same length.
    """
    out = []
    for _ in range(SAMPLES):
        at, value, steps = 0, _rng.random(), []
        while at < 1 << 40:
            steps.append(at)
            at += int(_rng.geometric(max(value, 1e-15)))
            value *= _rng.random()
        out.append(steps)
    return out


_STAYS, _RECORDS = _stays(), _records()
_STAY_LIST, _EACH, _TURNED = _STAYS.tolist(), np.arange(SAMPLES), np.roll(_SYMBOL, 1, axis=1)


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((codes * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int32) * np.int32(PERIOD)


def fingerprints(texts: list[str]) -> list[bytes]:
    """Fingerprint of each text, ``SAMPLES`` bytes.

    All texts walk through the same random choices: at each step the embedding shows the current character, and
    the choice for that step and character decides whether the walk goes on to the next one (Chakraborty, Goldenberg and
    Koucky, 2016). A text of n characters takes about 2n steps. Each sample shows the pair of the embedding's character
    at its step and the one that follows it in the text, as a byte. An empty text has only zeros.
    """
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    if not len(texts) or not sizes[0]:
        return [row.tobytes() for row in out]
    codes = [_classes(texts[k]) for k in order]
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    # While many texts are on the way they step together, a row of characters at a time; the rest of the longest ones
    # goes text by text.
    shared = int(np.searchsorted(-live, -FEW, "right"))
    starts = np.r_[0, np.cumsum(live[:shared])]
    rows = np.empty(starts[-1], np.int32)
    for r, own in enumerate(codes):
        rows[starts[:min(len(own), shared)] + r] = own[:shared]
    step, cell = np.zeros(len(texts), np.int64), np.empty(len(texts), np.int64)
    reached = np.empty(starts[-1], np.int64)
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        now, at = step[:b - a], cell[:b - a]
        reached[a:b] = now
        np.bitwise_and(now, PERIOD - 1, out=at)
        at += rows[a:b]
        now += _STAYS[at]
    for r, row in enumerate(order):
        own = codes[r]
        if not len(own):
            continue
        seen, end = [reached[starts[:min(len(own), shared)] + r]], int(step[r])
        for piece in range(shared, len(own), 1 << 20):
            late = []
            for c in own[piece:piece + (1 << 20)].tolist():
                late.append(end)
                end += _STAY_LIST[c + (end & PERIOD - 1)]
            seen.append(np.array(late, np.int64))
        seen = np.concatenate(seen)
        places = np.array([records[bisect_left(records, end) - 1] for records in _RECORDS])
        at, own = np.searchsorted(seen, places, "right") - 1, own // PERIOD
        after = own[np.minimum(at + 1, len(own) - 1)]
        out[row] = _SYMBOL[_EACH, own[at]] ^ _TURNED[_EACH, after]
    return [row.tobytes() for row in out]


@F.pandas_udf(BinaryType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """Texts are taken by some million characters at once, or alone where longer."""
    texts, out, at, size = texts.tolist(), [], 0, 0
    for k, text in enumerate(texts):
        if k > at and size + len(text) > CELLS:
            out += fingerprints(texts[at:k])
            at, size = k, 0
        size += len(text)
    return pd.Series(out + fingerprints(texts[at:]), dtype=object)


def likeness(a: Column, b: Column) -> Column:
    """Share of the samples in which two fingerprints agree."""
    same = F.filter(F.sequence(F.lit(1), F.lit(SAMPLES)), lambda k: a.substr(k, F.lit(1)) == b.substr(k, F.lit(1)))
    return F.size(same) / SAMPLES


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint); the next row has the next smaller id.

    Null ids come after all others, rows of one id by the hash of their text, and the first row follows the last. Ids are
    cut at approximate quantiles into ranges, one for each shuffle partition; each range also gets the first row of the
    range that follows, so no row has to look beyond its range. Texts move once. The ranges do not change the result.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(col(id_col).cast("double").alias("v")).approxQuantile(
        "v", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    # Plain numbers rather than a UDF: a Python worker for them alone would take memory from the fingerprints.
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(
        F.size(F.filter(cuts, lambda c: c < F.col("doc_id")))).cast("bigint"))
    top = rows.groupBy("range").agg(F.max(F.struct("doc_id", "mark")).alias("top")).orderBy("range").collect()
    goes = [(r["range"], r["top"]["doc_id"], r["top"]["mark"], top[(k + 1) % len(top)]["range"])
            for k, r in enumerate(top)]
    # One row a range, so its size is bounded by the number of ranges.
    goes = F.broadcast(spark.createDataFrame(goes, "f long, i long, m long, target long"))
    copies = rows.join(goes, (F.col("range") == F.col("f")) & F.col("doc_id").eqNullSafe(F.col("i"))
                       & (F.col("mark") == F.col("m"))).dropDuplicates(["range"])
    both = rows.withColumn("copy", F.lit(0)).union(copies.select(
        "doc_id", "text", "mark", F.col("target").alias("range"), F.lit(1).alias("copy")))
    both = both.withColumn("fingerprint", fingerprint("text"))
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("mark").desc())
    return both.withColumn("next_text", F.lead("text").over(order)).withColumn(
        "next_fingerprint", F.lead("fingerprint").over(order)).where("copy = 0").drop("copy", "range", "mark")


def _bands(samples: list[int]) -> list[list[int]]:
    """``samples`` in so many bands that near fingerprints agree on one of them."""
    return [part.tolist() for part in np.array_split(samples, UNLIKE + 1)]


def _keys(fingerprint: Column, bands: list[list[int]], *salt: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *salt, *[F.substring(fingerprint, p + 1, 1) for p in row])
                     for b, row in enumerate(bands)])


def first_near(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint (a row of bytes) the first one that is near; itself where none before is.

    Rows that have found theirs are compared no more; tiles bound the memory.
    """
    out, left = np.arange(len(prints)), np.arange(len(prints))
    for at in range(0, len(prints), TILE):
        left = left[left > at]
        still = []
        for k in range(0, len(left), TILE):
            own = left[k:k + TILE]
            near = (prints[own, None] == prints[None, at:at + TILE]).sum(2, np.uint8) >= SAMPLES - UNLIKE
            first = np.minimum(at + near.argmax(1), own)
            found = near.any(1) & (first < own)
            out[own[found]] = first[found]
            still.append(own[~found])
        left = np.concatenate([*still, np.zeros(0, int)]).astype(int)
    return out


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, head, code, fingerprint) sorted by these; gives (head, code, near) where another head is near."""
    def found(rows: pa.Table) -> pa.RecordBatch:
        band, head = rows["band"].to_numpy(), rows["head"].to_numpy()
        prints = np.frombuffer(b"".join(rows["fingerprint"].to_pylist()), np.uint8).reshape(-1, SAMPLES)
        cuts = np.r_[0, np.flatnonzero(np.diff(band)) + 1, len(band)]
        first = np.concatenate([a + first_near(prints[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
        tied = np.flatnonzero(first != np.arange(len(band)))
        return pa.RecordBatch.from_arrays([pa.array(head[tied]), pa.array(rows["code"].to_numpy()[tied]),
                                           pa.array(head[first[tied]])], names=["head", "code", "near"])

    held = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            last = np.flatnonzero(held["band"].to_numpy() != held["band"][-1].as_py())
            if len(last):
                yield found(held.slice(0, last[-1] + 1))
                held = held.slice(last[-1] + 1)
    if held is not None:
        yield found(held)


def near_heads(codes: DataFrame) -> DataFrame:
    """(fingerprint, near_id) from rows (doc_id, fingerprint): the smallest id of all near fingerprints, its own included.

    Equal fingerprints are reduced to their smallest id. Near ones agree in ``LIKENESS`` of all samples, so they differ in
    ``UNLIKE`` at most and agree on one of ``UNLIKE`` + 1 bands: no pair is missed. Within a bucket each is held against
    all with smaller ids until one is near. Buckets of over ``LARGE`` are dealt again by bands of the other samples,
    where the same holds.
    """
    classes = codes.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("head"))
    every = np.random.default_rng(21).permutation(SAMPLES).tolist()
    coarse = _bands(every)
    fine = [_bands([p for p in every if p not in row]) for row in coarse]
    # A repeated id may be the head of unlike fingerprints, so their hash goes with it.
    classes = classes.withColumn("code", F.xxhash64("fingerprint"))
    met = classes.select("head", "code", F.posexplode(_keys(F.col("fingerprint"), coarse)).alias("b", "band"))
    sizes = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = met.join(sizes, "band").join(classes, ["head", "code"])
    again = met.where(F.col("n") > LARGE)
    parts = [again.where(F.col("b") == b).select(F.explode(_keys(F.col("fingerprint"), bands, F.col("band"))).alias("band"),
                                                 "head", "code", "fingerprint") for b, bands in enumerate(fine)]
    rows = met.where(F.col("n") <= LARGE).select("band", "head", "code", "fingerprint")
    if not sizes.where(F.col("n") > LARGE).isEmpty():
        for part in parts:
            rows = rows.union(part)
    near = rows.repartition("band").sortWithinPartitions("band", "head", "code").mapInArrow(
        _nearest, "head long, code long, near long").groupBy("head", "code").agg(F.min("near").alias("near"))
    return classes.join(near, ["head", "code"], "left").select("fingerprint", F.coalesce("near", "head").alias("near_id"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last half (rounded down) replaced by as many first characters of the next row, or all it has.
    Columns: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hexadecimal), near_edited and
    near_next (share of equal samples), near_id (see :func:`near_heads`; null only where all equal rows lack an id).
    Null texts are empty texts; equal texts have equal fingerprints, so near_next of equal rows is 1. A single row is
    its own next one; repeated rows each get their row.
    """
    rows = with_next(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.length("text") - half),
                                              F.col("next_text").substr(F.lit(1), half)))
    rows = stable(rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"),
        "fingerprint", fingerprint("edited").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")))
    near = near_heads(rows.select("doc_id", "fingerprint"))

    def digits(c):
        return F.lower(F.hex(c))

    # Apart from the digits below: inside the lambda their names would be taken for these columns.
    rows = rows.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
    return rows.join(near, "fingerprint", "left").select(
        "doc_id", "n_chars", digits("sha").alias("edited_sha256"), digits("fingerprint").alias("fingerprint"),
        digits("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited", "near_next", "near_id")
