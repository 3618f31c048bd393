"""Phrase collocations by dynamic itemset counting over cyclic scans of corpus shards."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflux.llm.common import col, ensure_checkpoint_dir, removed, stable, text_of

LONGEST, LEAST, TOP, CLOSED = 5, 100, 2000, 100
#: Shards of the corpus, and the slots of the tables of reached phrases (one for each length below the longest).
SHARDS, SLOT_BITS = 2, 21
#: Bytes of text that are counted at once.
BLOCK = 8 << 20
NEVER = 255
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
ODD = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)] = 1
_KIND[list(BREAKS)] = 2
#: Counts of a scan. A key is the language, a tab and the phrase.
COUNTS = "key string, count long"
#: Where a key lies among a fixed number of places: what the sums over scans are narrowed down by.
PLACES = 1 << 22
PLACE = f"cast(pmod(xxhash64(key), {PLACES}) as int)"


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """``data`` in blocks of about ``size`` bytes and whole pieces; a piece that is longer than a block comes whole."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            stop = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8, min(size, len(data) - end), end)] == 2)
            while not len(stop) and end + size < len(data):
                end += size
                stop = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8, min(size, len(data) - end), end)] == 2)
            end = end + int(stop[0]) + 1 if len(stop) else len(data)
        yield data[at:end]
        at = end


def tokens(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-cased bytes, and the number of the piece that each stands in."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, np.cumsum(kind == 2, dtype=np.int32)[starts]


def seed_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def first_hash(words: np.ndarray, lang: str) -> np.ndarray:
    return (words ^ seed_of(lang)) * ODD


def longer_hash(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return (phrases + words) * ODD


def slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def counted(ids: np.ndarray, size: int, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct phrase of k ids among those that begin ``at``, and its number."""
    code, bound = ids[at], size
    for j in range(1, k):
        if bound * size >= 1 << 62:
            coded = pa.array(code).dictionary_encode()
            code, bound = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        code, bound = code * size + ids[at + j], bound * size
    which = pa.array(code).dictionary_encode().indices.to_numpy()
    numbers = np.bincount(which)
    places = np.empty(len(numbers), np.int64)
    places[which[::-1]] = at[::-1]
    return places, numbers


def growing_lengths(step: int, shards: int, reached: list[np.ndarray]) -> set[int]:
    """Lengths of which some phrase has reached the threshold within the last cycle: phrases one word longer are active."""
    return {k for k, table in enumerate(reached, 1) if ((table <= step) & (table > step - shards)).any()}


def block_counts(data: bytes, lang: str, step: int, shards: int, reached: list[np.ndarray],
                 growing: set[int]) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a block that are active in this step.

    Words are active in the first cycle. A longer phrase is from the step by which both its subphrases of one word less have
    reached the threshold, for one whole cycle, so it is counted once in each shard.
    """
    words, piece = tokens(data)
    if not len(words):
        return
    bits = len(reached[0]).bit_length() - 1
    coded = words.dictionary_encode()
    vocab, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocab.to_pylist()), np.uint64, len(vocab))[ids]
    phrase = first_hash(hashes, lang)
    blank, head = pa.scalar(b" ", pa.large_binary()), pa.scalar(lang.encode() + b"\t", pa.large_binary())
    for k in range(1, LONGEST + 1):
        if k > 1:
            if len(ids) < k:
                return
            at = ids[:0]
            if k - 1 in growing:
                since = reached[k - 2][slot(phrase, bits)]
                begin = np.maximum(since[:-1], since[1:])
                at = np.flatnonzero((begin <= step) & (begin > step - shards) & (piece[:-k + 1] == piece[k - 1:]))
            phrase = longer_hash(phrase[:-1], hashes[k - 1:])
        else:
            at = np.arange(len(ids) if step < shards else 0)
        if len(at):
            places, numbers = counted(ids, len(vocab), at, k)
            parts = [vocab.take(pa.array(ids[places + j])) for j in range(k)]
            text = pc.binary_join_element_wise(*parts, blank) if k > 1 else parts[0]
            key = pc.binary_join_element_wise(head, text, pa.scalar(b"", pa.large_binary()))
            yield pa.RecordBatch.from_arrays(
                [key.cast(pa.large_string()).cast(pa.string()), pa.array(numbers.astype(np.int64))], names=["key", "count"])


def shard_counts(step: int, shards: int, reached, block_size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growing = growing_lengths(step, shards, reached.value)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flushed(lang):
            for block in blocks(b"\n".join(held.pop(lang)).lower(), block_size):     # of bytes: A-Z only
                yield from block_counts(block, lang, step, shards, reached.value, growing)
            sizes.pop(lang)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sum(sizes.values()) > block_size:
                    yield from flushed(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from flushed(lang)
    return run


def phrase_slots(bits: int) -> Callable:
    """(k, slot) of each key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, slots = [], []
            for key in batch["key"].to_pylist():
                lang, phrase = key.rsplit("\t", 1)
                words = [np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.encode().split(b" ")]
                value = first_hash(words[0], lang)
                for w in words[1:]:
                    value = longer_hash(value, w)
                sizes.append(len(words))
                slots.append(int(slot(value, bits)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(slots, pa.int32())], names=["k", "slot"])
    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text",
                     shards: int = SHARDS, slot_bits: int = SLOT_BITS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``LONGEST`` words that occur ``least`` times in their language, (lang, k, phrase, f), and the number of
    all words of each language, (lang, n).

    Dynamic itemset counting: the corpus is dealt into shards that are scanned in turn, round and round. All words are counted
    in the first cycle; a longer phrase is counted from the scan after which both its subphrases have reached the
    threshold, whatever its length and wherever the cycle stands, for one full cycle. So lengths overlap, and every phrase that
    can be frequent is counted in every shard once.

    Which phrases have reached the threshold, and when, stands in one table of ``2 ** slot_bits`` bytes for each length,
    broadcast to the scans: its size is fixed. Phrases that share a slot begin together, so a full table costs needless
    counting and never a result: sums are by the phrase itself. Counts of a block are summed before the shuffle.

    A phrase that reaches the threshold in one cycle has at least its part of it, one in ``shards``, in some scan. So only counts
    in the places of such phrases are summed over scans; their number is bounded by ``PLACES``.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    (docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
     .withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
     .write.option("compression", "zstd").partitionBy("shard").parquet(f"{folder}/shards"))
    corpus = spark.read.schema("lang string, text string, shard long").parquet(f"{folder}/shards")

    def counts(steps) -> DataFrame:
        return spark.read.schema(COUNTS).parquet(*[f"{folder}/steps/{t}" for t in steps])

    def summed(steps, heavy: list[np.ndarray]) -> DataFrame:
        """Phrases with the sums of their counts in these steps, where they lie in a place of ``heavy``."""
        places = spark.createDataFrame(pa.table({"place": np.unique(np.concatenate(heavy))}))     # PLACES at most
        near = counts(steps).withColumn("place", F.expr(PLACE)).join(F.broadcast(places), "place", "left_semi")
        return near.groupBy("key").agg(F.sum("count").alias("f")).where(F.col("f") >= least)

    reached, latest, step = [np.full(1 << slot_bits, NEVER, np.uint8) for _ in range(LONGEST - 1)], 0, 0
    heavy: list[np.ndarray] = []
    while step < shards or step < latest + shards:
        shared = spark.sparkContext.broadcast(reached)
        (corpus.where(F.col("shard") == step % shards).select("lang", "text")
         .mapInArrow(shard_counts(step, shards, shared, block), COUNTS)
         .groupBy("key").agg(F.sum("count").alias("count"))
         .write.option("compression", "zstd").parquet(f"{folder}/steps/{step}"))
        shared.destroy()
        now = counts([step]).where(F.col("count") >= -(-least // shards)).select(F.expr(PLACE).alias("place"))
        heavy.append(now.distinct().toPandas()["place"].to_numpy(np.int32))
        cycle = range(max(0, step - shards + 1), step + 1)
        step += 1
        if not len(heavy[-1]):
            continue
        over = summed(cycle, heavy[-shards:]).select("key").mapInArrow(phrase_slots(slot_bits), "k int, slot int").where(
            F.col("k") < LONGEST).distinct().toPandas()
        for k, slots in over.groupby("k")["slot"]:
            table, slots = reached[k - 1], slots.to_numpy()
            new = slots[table[slots] == NEVER]
            table[new] = step
            latest = step if len(new) else latest
    phrase = F.substring_index("key", "\t", -1)
    lang = F.expr("substring(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang")
    single = counts(range(min(shards, step))).where(~phrase.contains(" "))
    words = stable(single.groupBy(lang).agg(F.sum("count").alias("n")))
    found = stable(summed(range(step), heavy).select(
        lang, F.size(F.split(phrase, " ")).alias("k"), phrase.alias("phrase"), "f"))
    removed(spark, folder)
    return found, words


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """Each phrase of two words or more with its weakest cut: (lang, k, phrase, a, l, r, n, score).

    A cut in front of word c + 1 leaves parts that occur l and r times; its score is floor(1000 a n / (l r)), in decimals of 38
    digits, which hold counts up to 10 ** 17. The lowest score counts, of equal ones that after the fewest words.
    """
    parts = F.split("phrase", " ")
    cuts = found.where("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "k", "phrase", F.col("f").alias("a"), "cut", F.array_join(F.slice(parts, 1, F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(parts, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    left = found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    whole = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(words, "lang")
    score = F.expr("(1000bd * cast(a as decimal(18, 0)) * cast(n as decimal(18, 0))) "
                   "div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    weakest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w")
    return whole.groupBy("lang", "k", "phrase", "a", "n").agg(weakest).select(
        "lang", "k", "phrase", "a", "w.l", "w.r", "n", "w.score")


def maximal(phrases: DataFrame, closed: int = CLOSED) -> DataFrame:
    """``phrases`` without those whose words stand within a longer one that occurs at least ``closed`` percent as often."""
    parts = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice(parts, at, size), " "))))
    within = phrases.where("k > 2").select("lang", F.col("a").alias("outer"), F.explode(inner).alias("phrase"))
    most = within.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    return phrases.join(most, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (100 * F.col("outer") < closed * F.col("a"))).drop("outer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, closed: int = CLOSED, **columns) -> DataFrame:
    """The ``top`` collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. A
    phrase of 2 to 5 words is a candidate where it occurs ``least`` times within pieces of its language's texts; its
    score is that of its weakest cut; it goes where a longer candidate around it occurs as often (see ``closed``). Ranks
    go by score, then a, both descending, then by the phrase's bytes, so no two tie. A null language counts as ``und``, a
    null text as empty; repeated rows count each; texts are counted whole, in blocks; no text gives no rows.
    """
    found, words = frequent_phrases(docs, least, **columns)
    kept = maximal(stable(scored(found, words)), closed)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.select("lang", F.row_number().over(order).cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
                       "score").where(F.col("rank") <= top)
