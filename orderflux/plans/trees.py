"""Trees grown in tasks, for training sets whose bins one task holds.

Spark ML deals the rows of a training set out and sums histograms over all of them for every level of every tree, which costs
some jobs a level. Here the features are cut into Spark ML's bins once, a byte each, and every task gets all rows of that table and
grows whole trees of its own. The rules are those of Spark ML: at most 32 bins, Poisson draws of the rows, the square root of their
number of features at each node, splits by Gini gain or variance, 30 levels, siblings that predict one class merged, importances normalised
by tree. Forests use random numbers of their own, boosting draws none.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np

BINS, COUNT_BITS = 32, 5
LEAST_GAIN = 1e-12                                      # a gain below is the rounding of none


def cuts(values: np.ndarray) -> np.ndarray:
    """Spark ML's thresholds of one feature: between all distinct values if they are few, else at even steps of the rows."""
    found, counts = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) < BINS:
        return between
    # A target lies nearer to the rows up to a value than to those up to the next where the two numbers exceed it on average.
    upto, step = np.cumsum(counts), len(values) / BINS
    pairs, target, k, out = upto[:-1] + upto[1:], step, 0, []
    while (k := k + int(np.searchsorted(pairs[k:], 2 * target, side="right"))) < len(pairs):
        out.append(between[k])
        target, k = target + step, k + 1
    return np.array(out)


def binned(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bins of values, a byte each: how many thresholds are less."""
    return np.searchsorted(at, values, side="left").astype(np.uint8)


class Tree:
    """Nodes of one tree in arrays: the feature (-1 in a leaf), its last bin to the left, the left child, class weights, gain."""

    def __init__(self, levels: list[dict]):
        # Siblings that are leaves of one class become one leaf, from the deepest level up.
        for up, down in zip(levels[-2::-1], levels[:0:-1]):
            inner = np.flatnonzero(up["feature"] >= 0)
            left = up["left"][inner]
            leaf, guess = down["feature"] < 0, down["w1"] > down["w0"]
            up["feature"][inner[leaf[left] & leaf[left + 1] & (guess[left] == guess[left + 1])]] = -1
        starts = np.cumsum([0, *(len(x["feature"]) for x in levels)])
        self.feature = np.concatenate([x["feature"] for x in levels])
        self.bin = np.concatenate([x["bin"] for x in levels])
        self.left = np.concatenate([x["left"] + s for x, s in zip(levels, starts[1:])])
        self.gain = np.concatenate([x["gain"] for x in levels])
        w0, w1 = (np.concatenate([x[w] for x in levels]) for w in ("w0", "w1"))
        self.share = w1 / (w0 + w1)

    def importance(self, features: int) -> np.ndarray:
        inner = self.feature >= 0
        out = np.bincount(self.feature[inner], self.gain[inner], features)
        return out / out.sum() if out.sum() > 0 else out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Share of class 1 in the leaf of each row."""
        flat, width = bins.ravel(), bins.shape[1]
        node, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while live.size:
            at = node.take(live)
            inner = np.flatnonzero(self.feature.take(at) >= 0)
            live, at = live.take(inner), at.take(inner)
            node[live] = self.left.take(at) + (flat.take(live * width + self.feature.take(at)) > self.bin.take(at))
        return self.share.take(node)


def _subsets(nodes: int, width: int, random) -> np.ndarray:
    """The root's number of features for each node, by Spark ML's reservoir: their order decides between equal gains."""
    size = ceil(sqrt(width))
    out = np.tile(np.arange(size), (nodes, 1))
    for f in range(size, width):
        place = random.integers(f + 1, size=nodes)
        taken = np.flatnonzero(place < size)
        out[taken, place[taken]] = f
    return out


def _impurity(w0, w1):
    """Half of the weight times the Gini impurity."""
    return w0 * w1 / (w0 + w1)


def _best(code, y, low, nodes, totals, weights):
    """The best split of each node by one feature: the least impurity that it leaves, its bin, and the rows of each class to its left.

    ``code`` is node and bin of each row, ``low`` how often it was drawn and, above that, its class. Few nodes are counted in a table; many
    have fewer rows than a table has cells, so their rows are sorted, and only bins that have rows are looked at.
    """
    t0, t1 = totals
    if nodes * BINS <= len(code):
        table = np.bincount(code * 2 + y, low & ((1 << COUNT_BITS) - 1), nodes * BINS * 2).reshape(nodes, BINS, 2).cumsum(axis=1)
        l0, l1 = table[:, :, 0] * weights[0], table[:, :, 1] * weights[1]
        inside = table[:, :, 0] + table[:, :, 1]
        inside = (inside > 0) & (inside < inside[:, -1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            left = _impurity(l0, l1) + _impurity(t0[:, None] - l0, t1[:, None] - l1)
        left = np.where(inside, left, np.inf)
        at = left.argmin(axis=1)
        here = np.arange(nodes)
        return left[here, at], at, *table[here, at].astype(np.int64).T
    kind = np.uint32 if nodes * BINS << (COUNT_BITS + 1) < 1 << 32 else np.uint64
    key = code.astype(kind)
    key <<= kind(COUNT_BITS + 1)
    key |= low.astype(kind)
    key.sort()
    # Rows up to each in one integer, those of class 1 in the upper half.
    number = np.arange(2 << COUNT_BITS) % (1 << COUNT_BITS)
    number = number + (number << 32) * (np.arange(2 << COUNT_BITS) >> COUNT_BITS)
    upto = number.take(key & kind((2 << COUNT_BITS) - 1)).cumsum()
    key >>= kind(COUNT_BITS + 1)
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    code, upto = key[ends], upto[ends]
    of = (code // kind(BINS)).astype(np.int64)
    closes = np.append(of[1:] != of[:-1], True)                      # every node has rows, so nodes have no gaps
    before = np.append(0, upto[closes][:-1])
    some = np.flatnonzero(~closes)
    least, at, n0, n1 = np.full(nodes, np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    if some.size:
        of = of[some]
        upto = upto.take(some) - before.take(of)
        l1 = upto >> 32
        l0 = (upto & 0xFFFFFFFF) - l1
        v0, v1 = l0 * weights[0], l1 * weights[1]
        left = _impurity(v0, v1) + _impurity(t0.take(of) - v0, t1.take(of) - v1)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        least[of[first]] = np.minimum.reduceat(left, first)
        hits = np.flatnonzero(left == least.take(of))
        hits = hits[np.append(True, of[hits][1:] != of[hits][:-1])]   # the first of equal ones
        at[of[hits]], n0[of[hits]], n1[of[hits]] = code[some[hits]] % kind(BINS), l0[hits], l1[hits]
    return least, at, n0, n1


def grow(bins: np.ndarray, label: np.ndarray, count: np.ndarray, weights: tuple[float, float], random, depth: int) -> Tree:
    """A tree over the rows of ``bins`` (rows x features), each drawn ``count`` times; ``weights`` are those of the classes."""
    drawn = np.flatnonzero(count)
    width = bins.shape[1]
    flat, y, count = bins[drawn].ravel(), label[drawn].astype(np.int64), count[drawn].astype(np.int64)
    if count.max(initial=0) >= 1 << COUNT_BITS:
        raise ValueError("a row was drawn too often")
    row, node, low = np.arange(len(drawn)) * width, np.zeros(len(drawn), np.int64), y << COUNT_BITS | count
    n0, n1 = np.array([count[y == 0].sum()]), np.array([count[y == 1].sum()])
    levels = []
    for level in range(depth + 1):
        w0, w1 = n0 * weights[0], n1 * weights[1]
        size = len(n0)
        here = {"feature": np.full(size, -1), "bin": np.zeros(size, np.uint8), "left": np.zeros(size, np.int64),
                "gain": np.zeros(size), "w0": w0, "w1": w1}
        levels.append(here)
        live = np.flatnonzero((n0 > 0) & (n1 > 0))
        if level == depth or not live.size:
            break
        # Only rows of nodes that may split go on; ``node`` counts those nodes.
        nodes, place = len(live), np.full(size, -1)
        place[live] = np.arange(nodes)
        node = place.take(node)
        keep = np.flatnonzero(node >= 0)
        row, node, y, low = (x.take(keep) for x in (row, node, y, low))
        features, start, totals = _subsets(nodes, width, random), node * BINS, (w0[live], w1[live])
        least, feature, at, left0, left1 = _impurity(*totals), *np.zeros((4, nodes), np.int64)
        whole = least - LEAST_GAIN * (totals[0] + totals[1])
        least = np.where(whole > 0, whole, 0.0)
        split = np.zeros(nodes, bool)
        for f in np.ascontiguousarray(features.T):
            found = _best(start + flat.take(row + f.take(node)), y, low, nodes, totals, weights)
            better = found[0] < least
            split |= better
            least, feature, at, left0, left1 = (np.where(better, new, old) for new, old in zip(
                (found[0], f, *found[1:]), (least, feature, at, left0, left1)))
        split = np.flatnonzero(split)
        if not split.size:
            break
        parents = live[split]
        here["feature"][parents], here["bin"][parents], here["left"][parents] = feature[split], at[split], 2 * np.arange(len(split))
        here["gain"][parents] = 2 * (_impurity(w0[parents], w1[parents]) - least[split])
        left0, left1 = left0[split], left1[split]
        n0, n1 = (np.stack([left, n[parents] - left], 1).ravel() for left, n in ((left0, n0), (left1, n1)))
        place = np.full(nodes, -1)
        place[split] = 2 * np.arange(len(split))
        right = flat.take(row + feature.take(node)) > at.take(node)
        child = place.take(node)
        keep = np.flatnonzero(child >= 0)
        row, node, y, low = (x.take(keep) for x in (row, child + right, y, low))
    return Tree(levels)


def forest(bins: np.ndarray, label: np.ndarray, weights: tuple[float, float], seeds: list, depth: int):
    """One tree after the other, each on its own Poisson draw of the rows."""
    for seed in seeds:
        random = np.random.default_rng(seed)
        yield grow(bins, label, random.poisson(1.0, len(bins)), weights, random, depth)


def boosted(bins: np.ndarray, label: np.ndarray, others: list[np.ndarray], rounds: int, depth: int, step: float) -> list[np.ndarray]:
    """Probabilities of class 1 for each table of ``others``, by gradient boosting of the log loss over the rows of ``bins``.

    The first tree is fitted to the labels -1 and 1 and counts in full, later ones to 4 y / (1 + exp(2 y F)) and count ``step``. A node that
    gains nothing sends all its rows to the left, so every tree is a whole one of ``depth`` levels.
    """
    sign = np.where(label == 1, 1.0, -1.0)
    columns, tables = np.ascontiguousarray(bins.T), [bins, *others]
    flats, width = [np.ascontiguousarray(t).ravel() for t in tables], bins.shape[1]
    rows = [np.arange(len(t)) * width for t in tables]
    total = [np.zeros(len(t)) for t in tables]
    for m in range(rounds):
        rest = sign if m == 0 else 4 * sign / (1 + np.exp(2 * sign * total[0]))
        nodes = [np.zeros(len(t), np.int64) for t in tables]
        for level in range(depth):
            size = 1 << level
            start = nodes[0] * BINS
            best, feature, at = np.zeros(size), np.zeros(size, np.int64), np.full(size, BINS)
            for f in range(width):
                code = start + columns[f]
                n = np.cumsum(np.bincount(code, minlength=size * BINS).reshape(size, BINS), axis=1)
                s = np.cumsum(np.bincount(code, rest, size * BINS).reshape(size, BINS), axis=1)
                n1, s1 = n[:, -1:] - n, s[:, -1:] - s
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s * s / n + s1 * s1 / n1 - s[:, -1:] ** 2 / n[:, -1:]
                gain = np.where((n > 0) & (n1 > 0), gain, 0.0)
                k = gain.argmax(axis=1)
                most = gain[np.arange(size), k]
                better = most > np.maximum(best, LEAST_GAIN * n[:, -1])
                best, feature, at = np.where(better, most, best), np.where(better, f, feature), np.where(better, k, at)
            for i, flat in enumerate(flats):
                nodes[i] = 2 * nodes[i] + (flat[rows[i] + feature[nodes[i]]] > at[nodes[i]])
        n = np.bincount(nodes[0], minlength=1 << depth)
        mean = np.bincount(nodes[0], rest, 1 << depth) / np.maximum(n, 1)
        for i, node in enumerate(nodes):
            total[i] += mean[node] * (1.0 if m == 0 else step)
    return [1 / (1 + np.exp(-2 * t)) for t in total[1:]]
