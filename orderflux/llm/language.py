"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, DoubleType

from orderflux.llm.common import col, text_of

DIMENSIONS = 1024
#: Profiles are summed in whole units of this size, so that the order of the sums does not matter.
UNITS = 1 << 20
#: Texts and characters that are turned into vectors at once.
BATCH_TEXTS, BATCH_CHARS = 256, 1 << 21


def letter_vector(code: int) -> np.ndarray:
    """The random +1/-1 vector of a character; it depends on the character alone."""
    return np.random.default_rng([7, code]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1


class Letters:
    """Vectors of trigrams: each letter's vector is rotated by its place and the three are multiplied."""

    def __init__(self):
        self.vectors, self.is_letter = {}, {}

    def trigrams(self, grams: np.ndarray) -> np.ndarray:
        codes = np.unique(grams)
        table = np.stack([self.vectors.setdefault(int(c), letter_vector(int(c))) for c in codes])
        first, second, third = (table[np.searchsorted(codes, grams[:, k])] for k in range(3))
        return (np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third).astype(np.float32)

    def normal(self, text: str) -> np.ndarray:
        """Code points of the letters in lower case, with one blank for all that stands between and at the ends."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        found = pd.unique(codes)
        for c in found:
            if c not in self.is_letter:
                self.is_letter[int(c)] = chr(c).isalpha()
        order = np.sort(found)
        letter = np.array([self.is_letter[int(c)] for c in order], bool)
        codes = np.where(letter[np.searchsorted(order, codes)], codes, 32) if len(order) else codes
        codes = np.r_[np.uint32(32), codes, np.uint32(32)]
        return codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of each text, the sum of the vectors of its trigrams, and whether it has a letter."""
        parts = [self.normal(t) for t in texts]
        owner = np.repeat(np.arange(len(parts)), [max(0, len(p) - 2) for p in parts])
        known = np.array([len(p) > 2 for p in parts], bool)
        total = np.zeros((len(parts), DIMENSIONS), np.float32)
        if known.any():
            key = np.concatenate([(p[:-2].astype(np.uint64) << np.uint64(42)) | (p[1:-1].astype(np.uint64) << np.uint64(21))
                                  | p[2:] for p in parts if len(p) > 2])
            ids, grams = pd.factorize(key)
            low = np.uint64((1 << 21) - 1)
            grams = np.stack([grams >> np.uint64(42), (grams >> np.uint64(21)) & low, grams & low], 1)
            for at in range(0, len(grams), 8192):           # bounds the table of trigram vectors
                own = (ids >= at) & (ids < at + 8192) if len(grams) > 8192 else slice(None)
                width = min(8192, len(grams) - at)
                counts = np.bincount(owner[own] * width + (ids[own] - at), minlength=len(parts) * width)
                total += counts.reshape(len(parts), width).astype(np.float32) @ self.trigrams(grams[at:at + width])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        return total / np.maximum(norm, 1e-9), known


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded number and, but for single texts, bounded length."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if k > at and (k - at >= BATCH_TEXTS or size + len(text) > BATCH_CHARS):
            yield at, k
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def in_fold(id_col: str):
    """Whether a row is held out: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their unit profiles, from all rows with a language that are not held out.

    A profile is the sum of the unit vectors of its texts. Each task sums what it reads to one vector per language;
    what reaches the driver is one vector per language. Texts without letters add nothing.
    """
    rows = docs.where(col(lang_col).isNotNull() & ~in_fold(id_col)).select(
        col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, found = Letters(), {}
        for batch in batches:
            langs, texts = np.array(batch["lang"].to_pylist(), object), batch["text"].to_pylist()
            for a, b in pieces(texts):
                units, known = letters.bundle(texts[a:b])
                whole = np.rint(units * UNITS).astype(np.int64)
                for lang in set(langs[a:b][known]):
                    found[lang] = found.get(lang, 0) + whole[known & (langs[a:b] == lang)].sum(0)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(found), pa.string()), "sums": pa.array(
            [v.tolist() for v in found.values()], pa.list_(pa.int64()))})

    each = rows.mapInArrow(sums, "lang string, sums array<bigint>").select("lang", F.posexplode("sums").alias("k", "v"))
    got = each.groupBy("lang", "k").agg(F.sum("v").alias("v")).groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("v")).collect()
    got = sorted((r["lang"], r["v"]) for r in got)
    profiles = np.array([v for _, v in got], float).reshape(-1, DIMENSIONS)
    return [lang for lang, _ in got], profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, without any shuffle.

    The prediction is the language whose profile has the largest cosine with the text's bundle, the first by name
    among equals, and the score is that cosine, at least 0. Texts that are null or have no letter get ``und`` and 0, and
    so does every text when nothing was learned. Repeated rows each get their row.
    """
    langs, profiles = model
    held = docs.sparkSession.sparkContext.broadcast((langs, profiles.astype(np.float32)))

    @F.pandas_udf(StructType([StructField("lang", StringType()), StructField("score", DoubleType())]))
    def best(texts: pd.Series) -> pd.DataFrame:
        names, table = held.value
        letters, texts, out, top = Letters(), texts.tolist(), [], []
        for a, b in pieces(texts):
            units, known = letters.bundle(texts[a:b])
            if not len(names):
                known[:] = False
            cosine = units @ table.T if len(names) else np.zeros((b - a, 1))
            first = cosine.argmax(1)
            out += [names[k] if ok else "und" for k, ok in zip(first, known)]
            top += np.where(known, np.clip(cosine.max(1), 0, 1), 0.0).astype(float).tolist()
        return pd.DataFrame({"lang": out, "score": top})

    return docs.select(col(id_col).alias("doc_id"), in_fold(id_col).alias("held_out"),
                       best(text_of(text_col)).alias("x")).select(
        "doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))
