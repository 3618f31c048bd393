"""SimHash fingerprints and near copies by exact tiled comparison."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orderflux.llm.common import col, connected, fresh, stable, text_of

WORD, GAP = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Bytes of text whose words are held at once.
PIECE = 1 << 20
#: Fingerprints side by side in a tile, the size beyond which a group is dealt out by more bits, and that up to which
#: groups are compared together.
TILE, LARGE, SMALL = 1024, 2048, 32


def gram_hashes(text: str, shingle: int, seed: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Hashes of the word shingles, a piece of the text at a time; of all words together, marked False, below that many."""
    data = text.encode("utf-8", "surrogatepass").lower()     # of bytes: A-Z only
    total, carry, at = 0, [], 0
    while at < len(data):
        gap = GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        words = carry + WORD.findall(data, at, end)
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
        if len(hashes):
            yield hashes, True
            total += len(hashes)
        carry, at = words[max(0, len(words) - shingle + 1):], end
    if not total and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), seed)], np.uint64), False


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; zero without words. Memory is bounded by a piece of the text."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes, whole in gram_hashes(text, shingle, seed):
        if not whole:
            return int(hashes[0])
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(text: Column, shingle: int, doubled: bool) -> Column:
    """Struct of the fingerprint as ``code`` and, where ``doubled``, a second one of other hashes as ``extra``."""
    @F.pandas_udf(StructType([StructField("code", LongType()), StructField("extra", LongType())]))
    def both(texts: pd.Series) -> pd.DataFrame:
        code = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        extra = np.array([fingerprint(t, shingle, SEED + 1) for t in texts] if doubled else np.zeros(len(texts)), np.uint64)
        return pd.DataFrame({"code": code.view(np.int64), "extra": extra.view(np.int64)})
    return both(text)


def tile_links(codes: np.ndarray, extra: np.ndarray, radius: int = RADIUS, slack: int = 64) -> np.ndarray:
    """For each code the position of a code that stands for its linked group among ``codes``.

    Codes are sorted by population count and cut into tiles; a pair of tiles is compared by exclusive-or and bit
    counts unless the counts of the two differ by more than the radius throughout. A pair is linked where the
    ``extra`` codes are within ``slack`` bits too.
    """
    order = np.argsort(np.bitwise_count(codes), kind="stable")
    codes, extra, root = codes[order], extra[order], np.arange(len(codes))
    ones = np.bitwise_count(codes).astype(int)
    for i in range(0, len(codes), TILE):
        for j in range(i, len(codes), TILE):
            if ones[j] - ones[min(i + TILE, len(codes)) - 1] > radius:
                break
            a, b = np.nonzero(np.bitwise_count(codes[i:i + TILE, None] ^ codes[None, j:j + TILE]) <= radius)
            a, b = a + i, b + j
            near = np.bitwise_count(extra[a] ^ extra[b]) <= slack
            a, b = a[near], b[near]
            while len(a):
                x, y = root[a], root[b]
                differ = x != y
                a, b, x, y = a[differ], b[differ], x[differ], y[differ]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
    out = np.empty(len(codes), int)
    out[order] = order[root]
    return out


def _group_links(radius: int, slack: int):
    """Links within runs of equal keys; rows (m, key, code, extra) come sorted by key.

    A run fits in memory: see :func:`near_links`. Runs of up to ``SMALL`` are compared together, each row with
    the next, the one after and so on.
    """
    def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
        mask, key, code, extra = rows
        code, extra = code.view(np.uint64), extra.view(np.uint64)
        cut = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(mask)]
        size = np.repeat(ends - starts, ends - starts)
        end = np.repeat(ends, ends - starts)
        a, b = [], []
        for step in range(1, SMALL):
            at = np.flatnonzero((np.arange(len(mask)) + step < end) & (size <= SMALL))
            if not len(at):
                break
            near = at[(np.bitwise_count(code[at] ^ code[at + step]) <= radius)
                      & (np.bitwise_count(extra[at] ^ extra[at + step]) <= slack)]
            a.append(near)
            b.append(near + step)
        for s, e in zip(starts[ends - starts > SMALL], ends[ends - starts > SMALL]):
            root = tile_links(code[s:e], extra[s:e], radius, slack)
            tied = np.flatnonzero(root != np.arange(e - s))
            a.append(s + tied)
            b.append(s + root[tied])
        a, b = (np.concatenate([*x, np.zeros(0, int)]).astype(int) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(rows[c][k]) for k in (a, b) for c in (2, 3)],
                                          names=["a", "a2", "b", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            done = last[-1] + 1 if len(last) else 0
            if done:
                yield edges([h[:done] for h in held])
                held = [h[done:] for h in held]
        if len(held[0]):
            yield edges(held)
    return run


def _masks(bits: list[int], radius: int) -> list[int]:
    """Masks of two out of radius + 2 pieces of ``bits``: codes that differ in at most radius bits agree in one."""
    pieces = [sum(1 << int(b) for b in part) for part in np.array_split(bits, radius + 2)]
    return [x | y for x, y in combinations(pieces, 2)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(codes: DataFrame, radius: int = RADIUS, slack: int = 64) -> DataFrame:
    """Links (a, b) of structs that tie all distinct (code, extra) together whose codes lie within ``radius`` bits and
    whose extra codes lie within ``slack`` bits of each other.

    Two such codes agree on two of radius + 2 pieces, so each code is dealt once for each pair of pieces and only codes
    that agree there meet. A group of over ``LARGE`` codes is dealt again by the pieces of its other bits, after
    which only a few bits vary (16 of 64 for radius 2, so at most 65,536 codes a group). Groups give a forest of
    links or, up to ``SMALL`` codes, their near pairs, never all pairs of a large group.
    """
    every = list(range(64))
    coarse = _masks(every, radius)
    fine = [[m | f for f in _masks([b for b in every if not m >> b & 1], radius)] for m in coarse]
    dealt = codes.select("code", "extra", F.explode(F.array(*[
        F.struct(F.lit(k).cast("long").alias("m"), F.col("code").bitwiseAND(F.lit(_long(m)).cast("long")).alias("key"))
        for k, m in enumerate(coarse)])).alias("x")).select("x.m", "x.key", "code", "extra")
    sizes = dealt.groupBy("m", "key").count().where("count > 1")
    met = dealt.join(sizes, ["m", "key"])
    deeper = F.get(F.array(*[F.array(*[F.lit(_long(f)).cast("long") for f in row]) for row in fine]),
                   F.col("m").cast("int"))
    again = met.where(F.col("count") > LARGE).select(
        "code", "extra", "m", F.posexplode(deeper).alias("k", "mask")).select(
        (F.col("m") + 1) * len(coarse) + F.col("k"), F.col("code").bitwiseAND(F.col("mask")), "code", "extra")
    groups = met.where(F.col("count") <= LARGE).select("m", "key", "code", "extra").union(again)
    links = (groups.repartition("m", "key").sortWithinPartitions("m", "key", "code")
             .mapInArrow(_group_links(radius, slack), "a long, a2 long, b long, b2 long"))

    def node(code, extra):
        return F.struct(F.col(code).alias("code"), F.col(extra).alias("extra"))

    return links.select(node("a", "a2").alias("a"), node("b", "b2").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                shingle: int = SHINGLE, slack: int | None = None) -> DataFrame:
    """Fingerprint and component of every row: (doc_id, fingerprint as 16 hex digits, component_id).

    Rows whose fingerprints differ in at most ``radius`` bits are linked, and component_id is the smallest id that is
    reachable. With ``slack`` a second fingerprint of other hashes must lie within so many bits as well, which rules
    chance out where the radius is wide. Null, empty and blank texts have fingerprint zero, which is linked like any
    other. A null id is passed over as component_id while the component has another. Repeated rows each get their
    row; an empty table gives none.

    Texts are read once; beyond that only ids and fingerprints move. Equal fingerprints are reduced to one
    before any comparison, so exact copies cost nothing, and skewed joins on a fingerprint can be split.
    """
    labels = _labels(docs, id_col, text_col, radius, shingle, slack)
    return labels.select("doc_id", F.lower(F.lpad(F.hex("node.code"), 16, "0")).alias("fingerprint"), "component_id")


def _labels(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, shingle: int = SHINGLE,
            slack: int | None = None) -> DataFrame:
    """(doc_id, mark, node, root, component_id) of every row: hash of the text, codes, the component's smallest codes."""
    coded = stable(docs.select(
        col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"),
        fingerprints(text_of(text_col), shingle, slack is not None).alias("node")))
    points = coded.groupBy("node").agg(F.min("doc_id").alias("least"))
    roots = connected(near_links(points.select("node.code", "node.extra"), radius, 64 if slack is None else slack))
    tied = points.join(roots, "node")
    reach = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = stable(tied.join(reach, "root").select("node", "root", "component_id"))
    labels = points.join(moved, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return coded.join(labels, "node")


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``groups`` (doc_id, mark, group): that of the smallest id and text hash.

    Rows go by id and ``mark``, the text's hash, so that a row goes only where its own group keeps another one. Rows
    alike in both count as one. Rows without id cannot be told apart and stay.
    """
    name, mark = fresh(docs, "id"), fresh(docs, "mark")
    rows = stable(groups.where("doc_id is not null").groupBy("doc_id", "mark", "group").agg(F.count("*").alias("n")))
    place = F.struct("doc_id", "mark")
    least = rows.groupBy("group").agg(F.min(place).alias("least"))
    placed = rows.join(least, "group").select(F.col("doc_id").alias(name), F.col("mark").alias(mark), "n",
                                              (place == F.col("least")).alias("stays"))
    same = (col(id_col) == F.col(name)) & (F.xxhash64(text_of(text_col)) == F.col(mark))
    kept = docs.join(placed.where("not stays").select(name, mark), same, "left_anti")
    twice = placed.where("stays and n > 1").select(name, mark)
    if twice.isEmpty():
        return kept
    first = kept.join(twice, same).dropDuplicates([name, mark]).select(*[col(c) for c in docs.columns])
    return kept.join(twice, same, "left_anti").union(first)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_copies`: see :func:`keep_first`."""
    return keep_first(docs, _labels(docs, id_col, text_col, **settings).select(
        "doc_id", "mark", F.col("root").alias("group")), id_col, text_col)
