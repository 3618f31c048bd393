"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflux.llm.common import col, text_of

#: The model is fitted on at most so many labelled documents, the first by a hash of their id, of at most so many lines.
SAMPLE_DOCS, SAMPLE_LINES = 4000, 120
THRESHOLD = 0.3
STEPS, RATE, DECAY = 250, 0.08, 1e-3
MARKS = "!#$%&*|@^~<>{}[]\\/=+_"


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Own features of each line of a text, and the lengths of the lines. An empty text is one empty line."""
    rows, lengths = [], []
    for line in text.split("\n"):
        words, n = line.split(), len(line)
        letters = sum(map(str.isalpha, line)) if n < 64 else len(line) - len(line.translate(_NO_LETTERS))
        upper = len(line) - len(line.translate(_NO_UPPER))
        marks = len(line) - len(line.translate(_NO_MARKS))
        digits = len(line) - len(line.translate(_NO_DIGITS))
        m = max(1, len(words))
        pairs = sum(map(eq, words, islice(words, 1, None)))
        distinct = len(set(words)) / m
        rows.append((
            upper / max(1, letters), marks / max(1, n), digits / max(1, n), letters / max(1, n),
            pairs / m, distinct, (1 - distinct) * (len(words) > 4), min(2.0, n / m / 10), np.log1p(n) / 5,
            float(line.rstrip().endswith((".", "!", "?"))), float(not words), line.count("|") / m,
            float(marks > 0.02 * n), float(upper > 0.3 * letters), float(distinct < 0.5)))
        lengths.append(n)
    return np.array(rows, float), np.array(lengths, float)


class _Drop(dict):
    """A translation that deletes the characters a test holds for and keeps the rest."""

    def __init__(self, test):
        super().__init__()
        self.test = test

    def __missing__(self, code):
        self[code] = out = None if self.test(chr(code)) else code
        return out


_NO_LETTERS, _NO_UPPER, _NO_DIGITS = _Drop(str.isalpha), _Drop(str.isupper), _Drop(str.isdigit)
_NO_MARKS = {ord(c): None for c in MARKS}


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after (zero at the ends), and a constant."""
    zero = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero]), np.ones((len(own), 1))])


def _soft(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(score: np.ndarray, lengths: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end: (P(good) by line, pair sums 2x2, log partition by chain).

    ``score`` is the log odds of each line, ``lengths`` the lines of each chain and ``turn`` the 2x2 log potentials
    of neighbours. Chains advance together, longest first, so the number of steps is that of the longest.
    """
    order = np.argsort(-lengths, kind="stable")
    start = np.r_[0, np.cumsum(lengths)[:-1]][order]
    size = lengths[order]
    unary = np.stack([np.zeros_like(score), score], 1)
    ahead, back = np.empty((len(score), 2)), np.zeros((len(score), 2))
    ahead[start] = unary[start]
    for t in range(1, int(size[0]) if len(size) else 0):
        now = start[:np.searchsorted(-size, -t, "left")] + t
        ahead[now] = unary[now] + _soft(ahead[now - 1][:, :, None] + turn[None], 1)
    pair = np.zeros((2, 2))
    for t in range(int(size[0]) - 1 if len(size) else 0, 0, -1):
        now = start[:np.searchsorted(-size, -t, "left")] + t
        after = unary[now] + back[now]
        back[now - 1] = _soft(turn[None] + after[:, None, :], 2)
    both = ahead + back
    total = _soft(both, 1)
    later = np.ones(len(score), bool)
    later[start] = False
    now = np.flatnonzero(later)
    if len(now):
        joint = ahead[now - 1][:, :, None] + turn[None] + (unary[now] + back[now])[:, None, :]
        pair = np.exp(joint - total[now][:, None, None]).sum(0)
    return np.exp(both[:, 1] - total), pair, total[start] if len(start) else total


def fit(features: list[np.ndarray], labels: list[int]) -> dict:
    """Weights of the chain by regularised maximum likelihood, every line labelled as its document."""
    if not features:
        return {"mean": 0.0, "scale": 1.0, "weights": None, "turn": np.zeros((2, 2))}
    own = np.vstack(features)
    mean, scale = own.mean(0), own.std(0) + 1e-6
    x = np.vstack([with_neighbours((f - mean) / scale) for f in features])
    lengths = np.array([len(f) for f in features])
    y = np.repeat(np.array(labels, float), lengths)
    chains = len(features)
    same = np.array([[0.0, 0.0], [0.0, 0.0]])
    for n, label in zip(lengths, labels):
        same[label, label] += n - 1
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, pair, _ = marginals(x @ theta[:-4], lengths, theta[-4:].reshape(2, 2))
        grad = np.r_[x.T @ (good - y), (pair - same).ravel()] / chains + DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return {"mean": mean, "scale": scale, "weights": theta[:-4], "turn": theta[-4:].reshape(2, 2)}


def scores(model: dict, texts: list[str]) -> np.ndarray:
    """Quality of each text: its lines' marginals weighted by their length in characters (at least 1)."""
    if model["weights"] is None or not texts:
        return np.full(len(texts), 0.5)
    out = np.empty(len(texts))
    pairs = [line_features(t) for t in texts]
    sizes = np.array([len(f) for f, _ in pairs])
    x = np.vstack([with_neighbours((f - model["mean"]) / model["scale"]) for f, _ in pairs])
    good, _, _ = marginals(x @ model["weights"], sizes, model["turn"])
    weight = np.maximum(1.0, np.concatenate([w for _, w in pairs]))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    out[:] = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    return np.clip(out, 0.0, 1.0)


def in_fold(id_col: str):
    """Whether a row is held out: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> dict:
    """Fit on labelled rows that are not held out.

    At most ``SAMPLE_DOCS`` ids, the first by a hash of the id, reach the driver with features of at most
    ``SAMPLE_LINES`` lines each; labels that are null or not 0 or 1 are passed over. Of an id with several labels or
    texts each pair of them counts.
    """
    chosen = (labels.where(col(label_col).isin(0, 1) & ~in_fold(id_col) & col(id_col).isNotNull())
              .select(col(id_col).alias("_id"), col(label_col).cast("int").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id", "_label").limit(SAMPLE_DOCS))
    rows = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text")).where(
        F.size(F.split("text", "\n", -1)) <= SAMPLE_LINES)
    rows = rows.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("_id", "_label", "text")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"hash": [f"{i}" for i in batch["_id"]], "label": batch["_label"],
                                "features": [line_features(t)[0].ravel().tolist() for t in batch["text"]]})

    found = rows.mapInPandas(measure, "hash string, label int, features array<double>")
    got = sorted(map(tuple, found.limit(2 * SAMPLE_DOCS).collect()))
    width = line_features("")[0].shape[1]
    return fit([np.array(f).reshape(-1, width) for _, _, f in got], [label for _, label, _ in got])


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, without any shuffle.

    The score lies in 0 to 1 and is higher the likelier label 1 is; null and empty texts are one empty line. Without
    labelled rows it is 0.5 throughout. Repeated rows each get their row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        step = 500
        return pd.Series(np.concatenate([scores(held.value, texts.iloc[k:k + step].tolist())
                                         for k in range(0, len(texts), step)] or [np.zeros(0)]))

    return docs.select(col(id_col).alias("doc_id"), in_fold(id_col).alias("held_out"),
                       score(text_of(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        step = 500
        return pd.Series(np.concatenate([scores(held.value, texts.iloc[k:k + step].tolist()) >= threshold
                                         for k in range(0, len(texts), step)] or [np.zeros(0, bool)]))

    return docs.where(good(text_of(text_col)))
