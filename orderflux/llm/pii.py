"""Personal data by rules and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflux.llm.common import col, text_of

KINDS = ["email", "ip", "card", "phone"]
#: Marginal probability from which the field adds a span.
SURE = 0.9
ROUNDS, DAMPING, SMOOTHING = 15, 0.3, 0.5
LABELS = 1 + len(KINDS)

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_EDGE = "\"'()[]{}<>,;:!?."


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by rule, in the order of the kinds and then of the places.

    Each rule takes the leftmost matches one after the other and drops those that fail its test. The searches take time
    in proportion to the text, also where a plain search would try every start within a long run.
    """
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        last = m.end() if m else at + 1
        if m:
            found.append((0, start, last))
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


#: Values of each token feature; the code of a token has one digit for each.
SIZES = (7, 4, 2, 2, 2, 2, 2, 2)


def token_code(token: str) -> int:
    """What a token looks like: digits, dots, at sign, leading plus, letters, brackets or hyphens, octets, check digit."""
    digits = _NOT_DIGIT.sub("", token)
    n, core = len(digits), token.strip(_EDGE)
    parts = core.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    values = (sum(n >= k for k in (1, 4, 8, 11, 16, 20)), min(3, core.count(".")), "@" in token, token.startswith("+"),
              any(map(str.isalpha, token)), any(c in token for c in "()-"), octets,
              16 <= n <= 19 and luhn(digits))
    code = 0
    for size, v in zip(SIZES, values):
        code = code * size + int(v)
    return code


class Chain:
    """Tokens of a text that hold a digit or an at sign, with the edges of the field between them."""

    def __init__(self, text: str):
        self.base = base_spans(text) if _ANY.search(text) else []
        self.spans, self.codes, self.labels, self.edges = [], [], [], []
        if not _ANY.search(text):
            return
        taken, latest, k = sorted((s, e, kind + 1) for kind, s, e in self.base), {}, 0
        for m in _TOKEN.finditer(text):
            n, (start, end) = len(self.spans), m.span()
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            near = [t for t in taken[k:k + 4] if t[0] < end and t[1] > start]
            self.spans.append((start, end))
            self.codes.append(token_code(m[0]))
            self.labels.append(max(near, key=lambda t: min(end, t[1]) - max(start, t[0]))[2] if near else 0)
            if n:
                self.edges.append((n - 1, n, 0 if start - self.spans[n - 1][1] == 1 else 1))
            digits = _NOT_DIGIT.sub("", m[0])
            key = digits if len(digits) >= 6 else m[0].strip(_EDGE).lower()
            if latest.get(key, n - 1) < n - 1:
                self.edges.append((latest[key], n, 2))      # the same token or digits further back
            latest[key] = n


def count_patterns(docs: DataFrame, text_col: str = "text") -> dict:
    """How often tokens of each code have each label, and how often labels meet on each kind of edge.

    Counts are over all texts, with the labels that the rules give. What reaches the driver is bounded by the number
    of codes, kinds of edges and labels.
    """
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                chain = Chain(text.as_py())
                counts.update((-1, c, y) for c, y in zip(chain.codes, chain.labels))
                counts.update((t, chain.labels[a], chain.labels[b]) for a, b, t in chain.edges)
        rows = [(*k, v) for k, v in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["what", "a", "b", "n"])

    found = docs.select(text_of(text_col).alias("text")).mapInArrow(tally, "what long, a long, b long, n long")
    return {(r["what"], r["a"], r["b"]): r["n"]
            for r in found.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()}


def _parts(code: int) -> list[int]:
    """The feature values of a code, each numbered apart."""
    out, offset = [], sum(SIZES)
    for size in reversed(SIZES):
        offset -= size
        code, v = divmod(code, size)
        out.append(offset + v)
    return out


def train(counts: dict) -> dict:
    """Piecewise training: a log-linear model of labels by token features, and log ratios of labels that meet."""
    codes = sorted({a for what, a, _ in counts if what == -1})
    x = np.zeros((len(codes), sum(SIZES)))
    y = np.zeros((len(codes), LABELS))
    for r, code in enumerate(codes):
        x[r, _parts(code)] = 1
        y[r] = [counts.get((-1, code, k), 0) for k in range(LABELS)]
    weights, total, share = np.zeros((sum(SIZES), LABELS)), max(1.0, y.sum()), y.sum(1, keepdims=True)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, 401 if codes else 1):
        p = np.exp((s := x @ weights) - s.max(1, keepdims=True))
        grad = x.T @ (p / p.sum(1, keepdims=True) * share - y) / total + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        weights -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    if not codes:
        return {"weights": weights, "known": {}, "edges": np.zeros((3, LABELS, LABELS))}
    shared = x @ weights
    shared -= np.log(np.exp(shared - shared.max(1, keepdims=True)).sum(1, keepdims=True)) + shared.max(1, keepdims=True)
    # A code's own counts, with the shared model as ten tokens of prior.
    known = np.log((y + 10 * np.exp(shared)) / (share + 10))
    edges = np.zeros((3, LABELS, LABELS))
    for what in range(3):
        pair = np.array([[counts.get((what, a, b), 0) for b in range(LABELS)] for a in range(LABELS)]) + SMOOTHING
        pair = pair / pair.sum()
        edges[what] = np.log(pair / (pair.sum(1, keepdims=True) * pair.sum(0, keepdims=True)))
    return {"weights": weights, "known": dict(zip(codes, known)), "edges": edges}


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Label probabilities by loopy belief propagation over all chains of a batch at once."""
    if not len(edges):
        belief = unary
    else:
        a, b, kind = edges.T
        source, target = np.r_[a, b], np.r_[b, a]
        table = np.concatenate([potentials[kind], potentials[kind].transpose(0, 2, 1)])
        back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        sent = np.zeros((len(source), unary.shape[1]))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, sent)
            out = (belief[source] - sent[back])[:, :, None] + table
            top = out.max(1, keepdims=True)
            new = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0]
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - sent).max()
            sent = DAMPING * sent + (1 - DAMPING) * new
            if moved < 1e-3:
                break
        belief = unary.copy()
        np.add.at(belief, target, sent)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(chains: list[Chain], texts: list[str], model: dict) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to each chain's base spans: sure tokens that no base span touches."""
    sizes = np.array([len(c.spans) for c in chains])
    starts = np.r_[0, np.cumsum(sizes)]
    out = [[] for _ in chains]
    if not starts[-1]:
        return out
    seen: dict[int, np.ndarray] = {}
    for code in {c for chain in chains for c in chain.codes}:
        score = model["weights"][_parts(code)].sum(0)
        seen[code] = model["known"].get(code, score - np.log(np.exp(score - score.max()).sum()) - score.max())
    unary = np.array([seen[c] for chain in chains for c in chain.codes])
    edges = np.array([(starts[k] + a, starts[k] + b, t) for k, c in enumerate(chains) for a, b, t in c.edges],
                     np.int64).reshape(-1, 3)
    p = marginals(unary, edges, model["edges"])
    best, sure = p.argmax(1), p.max(1) >= SURE
    for n in np.flatnonzero((best > 0) & sure):
        k = int(np.searchsorted(starts, n, "right")) - 1
        if chains[k].labels[n - starts[k]]:
            continue
        start, end = chains[k].spans[n - starts[k]]
        piece = texts[k][start:end]
        start, end = start + len(piece) - len(piece.lstrip(_EDGE)), end - len(piece) + len(piece.rstrip(_EDGE))
        if start < end and not any(s < end and e > start for _, s, e in chains[k].base):
            kind = int(best[n]) - 1
            if out[k] and out[k][-1][0] == kind and start - out[k][-1][2] <= 1:
                start = out[k].pop()[1]
            out[k].append((kind, start, end))
    return out


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every text: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    The numbers and the hash (of ``kind:start:end`` by kind and start, comma-joined) tell of the spans that the rules
    find, ``spans`` lists these and those that the field adds. Places are code points, ends exclusive.

    The field's nodes are the tokens with a digit or an at sign, its labels the kinds and none. Neighbours share an
    edge of the chain (adjacent, or with other words between), and a token that repeats an earlier one, or
    its digits, an edge with the latest of them. It is trained on the rules' labels over all texts; where it is sure of
    a token that no rule takes, the token becomes a span. Null and empty texts have no spans. Two passes over the texts,
    no shuffle but of counts; repeated rows each get their row.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(count_patterns(docs, text_col)))
    rows = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("text").to_pylist()
                chains = [Chain(t) for t in texts]
                extra = added_spans(chains, texts, model.value)
                counts = [[sum(k == kind for k, _, _ in c.base) for c in chains] for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), *[pa.array(n, pa.int64()) for n in counts],
                    pa.array([hashlib.sha256(_line(c.base).encode()).hexdigest() for c in chains], pa.string()),
                    pa.array([_line(c.base + e) for c, e in zip(chains, extra)], pa.string())],
                    names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, "
                                 "base_sha256 string, spans string")
