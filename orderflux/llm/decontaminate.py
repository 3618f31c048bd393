"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflux.llm.common import col, fresh, text_of

#: Letters of scripts that are written without blanks: each is a word of its own.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]")
#: Words of the shortest tile (of items that are shorter, all their words), and the share of a test item that tiles must
#: cover.
LEAST, COVERAGE = 5, 0.6
#: Bytes of benchmark items that one pass over the documents looks for; more items are more passes.
BLOCK_BYTES = 12 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolled(ids: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``least`` ids, modulo 2**64."""
    n = len(ids) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(least):
        out = out * BASE + ids[k:k + n].astype(np.uint64)
    return out


def tiled(doc_at: np.ndarray, item_at: np.ndarray, least: int, item_len: int) -> int:
    """Words of the item that greedy tiling covers, from all seeds: equal runs of ``least`` words at both places.

    Seeds that follow each other on a diagonal are one match. The longest match whose words are all free is marked
    again and again; what others leave of a match is matched in turn while it has ``least`` words.
    """
    order = np.lexsort((doc_at, doc_at - item_at))
    i, j = doc_at[order], item_at[order]
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    starts, ends = np.r_[0, cut], np.r_[cut, len(i)]
    heap = [(-(e - s + least - 1), int(j[s]), int(i[s])) for s, e in zip(starts, ends)]
    heapq.heapify(heap)
    used, marked, covered = np.zeros(item_len, bool), set(), 0
    while heap and covered < item_len:
        length, b, a = heapq.heappop(heap)
        free = [not used[b + k] and a + k not in marked for k in range(-length)]
        if all(free):
            used[b:b - length] = True
            marked.update(range(a, a - length))
            covered -= length
            continue
        k = 0
        while k < len(free):
            if not free[k]:
                k += 1
                continue
            end = k
            while end < len(free) and free[end]:
                end += 1
            if end - k >= least:
                heapq.heappush(heap, (-(end - k), b + k, a + k))
            k = end
    return covered


class Items:
    """A block of benchmark items with an index of their seeds, one for each length of seeds."""

    def __init__(self, rows: list[tuple], least: int):
        self.ids, self.words = [r[0] for r in rows], {}
        texts = [[self.words.setdefault(w, len(self.words) + 1) for w in WORD.findall((r[1] or "").lower())]
                 for r in rows]
        self.tokens = [np.array(t, np.int64) for t in texts]
        self.seeds = {}
        for size in range(1, least + 1):
            members = [k for k, t in enumerate(texts) if min(least, len(t)) == size]
            if members:
                hashes = [rolled(self.tokens[k], size) for k in members]
                owner = np.repeat(members, [len(h) for h in hashes])
                place, seed = np.concatenate([np.arange(len(h)) for h in hashes]), np.concatenate(hashes)
                order = np.argsort(seed, kind="stable")
                self.seeds[size] = seed[order], owner[order], place[order]

    def coverage(self, text: str) -> tuple[list, list[float]]:
        """Ids of the items that share a seed with the text, and the share of their words that tiling covers."""
        ids = np.fromiter(map(self.words.get, WORD.findall(text.lower()), iter(int, 1)), np.int64)
        items, shares = [], []
        for size, index in self.seeds.items():
            for item, covered in self._covered(ids, size, *index):
                items.append(self.ids[item])
                shares.append(covered)
        return items, shares

    def _covered(self, ids: np.ndarray, size: int, seed: np.ndarray, owner: np.ndarray, place: np.ndarray):
        found = rolled(ids, size)
        if not len(found):
            return
        known = np.convolve(ids > 0, np.ones(size, np.int64), "valid") == size
        at = np.flatnonzero(known)
        low = np.searchsorted(seed, found[at], "left")
        n = np.searchsorted(seed, found[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        if not len(at):
            return
        rows = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        doc_at, who, item_at = np.repeat(at, n), owner[rows], place[rows]
        for item in np.unique(who):
            own = who == item
            a, b, tokens = doc_at[own], item_at[own], self.tokens[item]
            same = np.ones(len(a), bool)
            for k in range(size):
                same &= ids[a + k] == tokens[b + k]
            if same.any():
                yield item, tiled(a[same], b[same], size, len(tokens)) / len(tokens)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """Benchmark items that share a seed with a text: (id, mark, item_id, coverage), one row per pair.

    Words are runs of word characters in lower case, in scripts without blanks single letters; ``mark`` is the text's
    hash. Benchmark items are a stated query set: they are dealt into blocks of some ``BLOCK_BYTES``, and every block is held
    against all documents in one pass, whole texts and without a shuffle. Items of under ``least`` words have all their words
    as their only seed, so they are found as a whole; items without words are not.
    """
    items = benchmark.select(col(item_col).alias("item_id"), text_of(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("mark"),
                       text_of(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, mark long, " \
             f"item_id {benchmark.schema[item_col].dataType.simpleString()}, coverage double"
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = Items(held.value, least)
            for batch in batches:
                row, item, share = [], [], []
                for n, text in enumerate(batch.column("text")):
                    found, shares = block.coverage(text.as_py())
                    row += [n] * len(found)
                    item += found
                    share += shares
                keep = batch.select(["id", "mark"]).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*keep.columns, pa.array(item, type=None if item else pa.int64()), pa.array(share, pa.float64())],
                    names=["id", "mark", "item_id", "coverage"])

        hits = rows.mapInArrow(scan, schema)
        out = hits if out is None else out.union(hits)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  coverage: float = COVERAGE, **names) -> DataFrame:
    """For every row of ``docs``: (doc_id, contaminated, item_ids, coverage).

    item_ids are the items whose words tiles of at least ``LEAST`` words (or all of a shorter item's) cover to ``coverage`` or more, in whatever
    order their parts stand; coverage is the largest share over all items, 0 without a common seed. Null and empty
    texts and an empty benchmark give clean rows. Rows alike in id and text share their result. Of matches of one length
    the first in the item is marked first, then the first in the text. Very long texts are held whole, one at a time.
    """
    hits = benchmark_hits(docs, benchmark, id_col, text_col, **names)
    found = hits.groupBy("id", "mark").agg(
        F.array_sort(F.collect_set(F.when(F.col("coverage") >= coverage, F.col("item_id")))).alias("item_ids"),
        F.max("coverage").alias("coverage"))
    found = found.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "item_ids", "coverage")
    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"))
    none = F.array().cast(dict(found.dtypes)["item_ids"])
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select(
        "doc_id", (F.size(F.coalesce("item_ids", none)) > 0).alias("contaminated"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          coverage: float = COVERAGE, **names) -> DataFrame:
    """``docs`` without the rows that :func:`contamination` finds contaminated."""
    hits = benchmark_hits(docs, benchmark, id_col, text_col, **names).where(F.col("coverage") >= coverage)
    key, mark = fresh(docs, "id"), fresh(docs, "mark")
    gone = hits.select(F.col("id").alias(key), F.col("mark").alias(mark)).distinct()
    return docs.join(gone, col(id_col).eqNullSafe(F.col(key))
                     & (F.xxhash64(text_of(text_col)) == F.col(mark)), "left_anti")
