"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflux.llm.common import col, fresh, stable, text_of

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents rounded together in one task, and open remainders joined in one step of the tree.
GROUP = 4096


def word_count(text: Column) -> Column:
    """Number of words between blanks."""
    parts = F.split(text, r"[\x20\x09-\x0D]+", -1)
    return (F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int")
            - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, place, n_rows, source_size, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn. Targets share ``share`` times all sizes by weight; none
    exceeds ``most`` times its source's size, and the excess is shared anew by weight until none is above. Places are
    counted within ranges of sources and then offset, and each round of sharing gives two sums to the driver.
    """
    found = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    parts = stable(found.repartitionByRange(F.col("source").asc_nulls_last())
                   .withColumn("part", F.spark_partition_id()))
    counts, offsets, at = parts.groupBy("part").count().orderBy("part").collect(), {}, 0
    for r in counts:
        offsets[r["part"]] = at
        at += r["count"]
    if not counts:
        return parts.select("source", F.lit(0).cast("bigint").alias("place"), "n_rows", "source_size",
                            F.lit(0.0).alias("target"))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("part"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + offset
    placed = parts.select("source", place.cast("bigint").alias("place"), "n_rows", "source_size")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    placed = stable(placed.withColumn("weight", weight).withColumn("top", F.col("source_size") * most))
    total, level = share * (placed.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        free = F.col("top") > F.col("weight") * level
        held, open_weight = placed.agg(F.sum(F.when(~free, F.col("top"))), F.sum(F.when(free, F.col("weight")))).first()
        if not open_weight:
            break
        new = (total - (held or 0.0)) / open_weight
        if new <= level:
            break
        level = new
    return placed.select("source", "place", "n_rows", "source_size",
                         F.least("top", F.col("weight") * level).alias("target"))


def _meet(p: np.ndarray, size: np.ndarray, i: int, j: int, rng: np.random.Generator) -> None:
    """Move words between two open rows until the share of one is 0 or 1."""
    held_i, held_j = p[i] * size[i], p[j] * size[j]
    room_i, room_j = size[i] - held_i, size[j] - held_j
    up, down = min(room_i, held_j), min(held_i, room_j)
    words = up if rng.random() * (up + down) < down else -down
    for k, now in ((i, held_i + words), (j, held_j - words)):
        share = now / size[k]
        p[k] = round(share) if min(share, 1 - share) < 1e-12 else share


def settle(rows: pa.Table, seed: list[int], last: bool = False) -> pa.Table:
    """Round the shares ``p`` of copies of rows with ``size`` words so that at most one stays open.

    Two open rows meet, words move from one to the other in a random direction until a share is 0 or 1, and what is
    open goes on to the next. Rows of like size meet first, larger ones before; the open row of a class then passes
    its words to, or takes them from, all smaller rows together where these can bear it, so that the row that stays
    open in the end is a small one. Each step keeps the words taken and the expected copies. ``last`` closes the
    remainder.
    """
    rows = rows.take(pc.sort_indices(rows, [("size", "descending"), ("doc_id", "ascending"), ("mark", "ascending")]))
    size, p = rows["size"].to_numpy().astype(float), rows["p"].to_numpy().copy()
    rng, left = np.random.default_rng(seed), None
    p[size == 0] = 0.0
    shares = np.flatnonzero((p > 0) & (p < 1))
    classes = np.floor(np.log2(size[shares]))
    for kind in np.unique(classes)[::-1]:
        for j in shares[classes == kind]:
            if not 0 < p[j] < 1:
                continue
            if left is not None:
                _meet(p, size, left, j, rng)
            left = next((k for k in (left, j) if k is not None and 0 < p[k] < 1), None)
        rest = shares[classes < kind]
        if left is None or not len(rest):
            continue
        held, room = p[left] * size[left], (1 - p[left]) * size[left]
        all_held, all_room = (p[rest] * size[rest]).sum(), ((1 - p[rest]) * size[rest]).sum()
        if room < all_held and held < all_room:
            if rng.random() < p[left]:
                p[left] = 1.0
                p[rest] *= 1 - room / all_held
            else:
                p[left] = 0.0
                p[rest] += (1 - p[rest]) * held / all_room
            left = None
    if last and left is not None:
        p[left] = float(p[left] >= 0.5)
    return rows.set_column(rows.column_names.index("p"), "p", pa.array(p))


def _settled(seed: int, level: int, last: bool):
    def rounded(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return settle(group, [seed, level, *(k.as_py() for k in key)], last)
    return rounded


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """How often the mix takes every row: (doc_id, mark, size, source_size, target, copies, taken).

    The size is the number of words between blanks, 0 for null and empty texts, which are taken as often as any but
    add no words. A row's expected copies are its source's target over its size: the whole part is certain, the rest
    is rounded by pairs within groups of a source, and what stays open goes up a tree of such groups, so that a
    source misses its target by half a document at most. Groups, order and random numbers follow from ids and texts
    (``mark`` is the text's hash) alone, so reruns agree; a group holds some ``GROUP`` rows however large its source.
    Repeated rows are rounded one by one; an empty table gives none; a null source is a source.
    """
    sizes = docs.select(col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"),
                        col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"))
    # Rows alike in all that counts get numbers, so that they are dealt to several groups.
    sizes = stable(sizes.groupBy(*sizes.columns).agg(F.count("*").alias("n")).withColumn(
        "nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("n"))
    targets = stable(source_targets(sizes, weights, share, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    buckets = F.ceil(F.col("n_rows") / GROUP)
    rows = sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "mark", "size", "source_size", "target", "place",
        F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"),
        F.pmod(F.xxhash64("doc_id", "mark", "nth", F.lit(seed)), buckets).alias("bucket"))
    schema = rows.schema
    most_buckets = targets.agg(F.max(buckets)).first()[0] or 1
    depth = max(1, math.ceil(math.log(most_buckets, GROUP) - 1e-9) + 1) if most_buckets > 1 else 1
    now, done = rows, None
    for level in range(depth):
        last = level == depth - 1
        now = stable(now.groupBy("place", "bucket").applyInArrow(_settled(seed, level, last), schema))
        closed = now.where("p = 0 or p = 1")
        done = closed if done is None else done.union(closed)
        now = now.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / GROUP))
    copies = (F.col("whole") + F.col("p")).cast("bigint")
    return done.select("doc_id", "mark", "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          **settings) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with the columns of ``docs``.

    Rows alike in id and text share their copies: each gets the whole part of their mean, and as many as are left, by their
    numbers, one more. The numbers are given within partitions first, so that no task holds all of them.
    """
    plan = mix(docs, id_col, text_col, source_col, **settings).groupBy("doc_id", "mark").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    key, mark, copies, n, part, at, nth, k2, m2, p2, count, before = (fresh(docs, c) for c in (
        "id", "mark", "copies", "n", "part", "at", "nth", "id2", "mark2", "part2", "count", "before"))
    plan = plan.select(*[F.col(c).alias(name) for c, name in (("doc_id", key), ("mark", mark), ("copies", copies), ("n", n))])
    numbered = docs.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()})
    taken = numbered.join(plan, col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_of(text_col)) == F.col(mark)))
    single = taken.where(F.col(n) == 1).withColumn(nth, F.lit(1).cast("bigint"))
    alike = taken.where(F.col(n) > 1)
    earlier = F.sum(count).over(Window.partitionBy(key, mark).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = alike.groupBy(key, mark, part).agg(F.count("*").alias(count)).select(
        F.col(key).alias(k2), F.col(mark).alias(m2), F.col(part).alias(p2), F.coalesce(earlier, F.lit(0)).alias(before))
    local = F.row_number().over(Window.partitionBy(key, mark, part).orderBy(at))
    alike = alike.withColumn(nth, local.cast("bigint")).join(counts, F.col(key).eqNullSafe(F.col(k2)) & (
        F.col(mark) == F.col(m2)) & (F.col(part) == F.col(p2))).withColumn(nth, F.col(nth) + F.col(before)).drop(k2, m2, p2, before)
    more = (F.col(nth) <= F.col(copies) % F.col(n)).cast("bigint")
    every = single.unionByName(alike).withColumn(copies, F.floor(F.col(copies) / F.col(n)) + more).where(F.col(copies) > 0)
    return every.withColumn(part, F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(*[col(c) for c in docs.columns])
