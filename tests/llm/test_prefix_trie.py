"""The prefix trie against tries built node by node."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderflux.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, d int, digest string, key string, n int, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "x", 7, "x") for r in rows], SCHEMA)


def plain(convs):
    """Rows of the result, for {conv: [(turn, words)]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        kids = [below(k) for k in children[node]]
        saved = (len(members[node]) - 1) * (node[-1][1] if node else 0)
        return sum(k[0] for k in kids) or 1, saved + sum(k[1] for k in kids)

    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), *below(node),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    assert df.columns == prefix_trie.RESULT
    return sorted(map(tuple, df.collect()), key=str)


def turn_rows(spark, convs):
    rows = [(c, d + 1, str(t), w) for c, turns in convs.items() for d, (t, w) in enumerate(turns)]
    rows += [(c, None, None, 0) for c, turns in convs.items() if not turns]
    df = spark.createDataFrame(rows, "conv_id long, d int, digest string, words int")
    return df.withColumn("digest", F.unhex(F.md5(F.col("digest").cast("binary"))))


@pytest.mark.parametrize("parts, key_turns", [(1, 512), (3, 512), (7, 2), (40, 1)])
def test_against_plain_trie(spark, monkeypatch, parts, key_turns):
    monkeypatch.setattr(prefix_trie, "KEY_TURNS", key_turns)
    monkeypatch.setattr(prefix_trie, "GROWTH", 2)
    monkeypatch.setattr(prefix_trie, "BATCH", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = np.random.default_rng(parts)
        convs = {}
        for c in rng.permutation(160).tolist():
            kind = rng.random()
            size = 0 if kind < 0.05 else int(rng.integers(1, 7)) if kind < 0.9 else int(rng.integers(7, 30))
            convs[c] = [(int(t), int(t) + 1) for t in rng.integers(0, 3 if kind < 0.8 else 1, size)]
        assert result(prefix_trie.trie(turn_rows(spark, convs))) == plain(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_joins_in_descending_depth():
    """Components and their branching nodes, against grouping by prefixes."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        keys = sorted(rng.integers(0, 2, rng.integers(0, 5)).astype(np.uint8).tobytes() for _ in range(rng.integers(1, 9)))
        lcp = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(keys, keys[1:])]
        rows = prefix_trie.merged_runs(lcp, [d == len(a) for d, a in zip(lcp, keys)], [len(k) for k in keys], list(range(len(keys))))
        got = sorted((d, first, last) for first, last, depth, _, _, top, _ in rows for d in range(top, depth + 1))
        want = {(d, k[:d]) for k in keys for d in range(len(k) + 1)}
        spans = {x: [i for i, k in enumerate(keys) if len(k) >= x[0] and k[:x[0]] == x[1]] for x in want}
        assert got == sorted((d, s[0], s[-1]) for (d, _), s in spans.items())


def test_forks_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in [0, 1, 2, 3, 5, 9, 19, 20, 21, 40, 41, 60, 77]:
        for t in range(int(rng.integers(1, 6))):
            rows.append((c, int(rng.integers(0, 99)) * 10 + t if rng.random() < 0.9 else None, str(rng.choice(["user", "assistant"])),
                         f"turn {rng.integers(0, 3)}  of\tsome words"))
    rows += [(90, 1, None, None), (90, 1, None, None), (90, None, "", ""), (91, 0, "user", "long " * 100_000), (None, 1, "user", "x")]
    said = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        if c is not None:
            said[c].append((t is not None, t or 0, digest, (role, text), len(text.split())))
    said = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in said.items()}
    convs = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = said.get(c - c % 20, [])[:h] + own[h:]
    got = prefix_trie.trie(prefix_trie.forked(prefix_trie.turns_of(frame(spark, rows))))
    assert result(got) == plain(convs)


def test_nothing(spark):
    assert prefix_trie.trie(prefix_trie.forked(prefix_trie.turns_of(frame(spark, [])))).collect() == []
