"""Dynamic itemset counting against plain counts of all phrases."""

import re
from collections import Counter

import numpy as np
import pytest
from llm_tables import documents

from orderflux.llm import collocations


def plain(rows, least, top, closed):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        around = (w2 for (lang2, w2), b in f.items() if lang2 == lang and len(w2) > len(w) and b >= least
                  and 100 * b >= closed * a)
        if any(w == w2[i:i + len(w)] for w2 in around for i in range(len(w2) - len(w) + 1)):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:c]] * f[lang, w[c:]]), c, f[lang, w[:c]], f[lang, w[c:]])
                                    for c in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranks, rows = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return rows


def corpus(seed):
    rng = np.random.default_rng(seed)
    phrases = ["once upon a time there was", "of the", "New  York", "\u00c4rger \u00e4", "z"]
    out = []
    for _ in range(120):
        words = []
        for _ in range(rng.integers(0, 40)):
            words.append(str(rng.choice(phrases)) if rng.random() < 0.4 else str(rng.choice(list("abcdefgh"))))
            if rng.random() < 0.1:
                words.append(str(rng.choice([".", ", ", "\n", "\t", "\x0b!"])))
        out.append((rng.choice(["en", "fr", None]), " ".join(words)))
    out += [("en", None), ("en", ""), (None, " .,\n"), ("fr", "the " * 3000)]
    return out + out[:9]


@pytest.mark.parametrize("shards, block, bits, closed", [(3, 1 << 23, 22, 100), (1, 50, 4, 100), (4, 300, 8, 60), (2, 5000, 1, 100)])
def test_against_plain_counts(spark, shards, block, bits, closed):
    rows = corpus(shards)
    df = documents(spark, [(i, t, lang, "a") for i, (lang, t) in enumerate(rows)]).repartition(5)
    got = collocations.collocations(df, least=6, top=25, closed=closed, shards=shards, block=block, slot_bits=bits)
    assert sorted(map(tuple, got.collect())) == plain(rows, 6, 25, closed)


def test_exact_beyond_64_bits(spark):
    big = 10 ** 13
    found = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)],
                                  "lang string, k int, phrase string, f long")
    words = spark.createDataFrame([("en", 9 * big + 1)], "lang string, n long")
    row = collocations.scored(found, words).first()
    assert row["score"] == 1000 * (big - 7) * (9 * big + 1) // (big * (big - 1))


def test_blocks_and_long_codes():
    data = b"aa bb. " * 50 + b"x" * 900 + b"; c"
    parts = list(collocations.blocks(data, 64))
    assert b"".join(parts) == data and len(parts) > 4 and all(p[-1:] in b".;" for p in parts[:-1])
    ids = np.array([1, 2, 3, 1, 2, 3, 9], np.int64)
    for size in (10, 1 << 31):
        places, numbers = collocations.counted(ids, size, np.arange(4), 3)
        assert {tuple(ids[p:p + 3]): n for p, n in zip(places, numbers)} == {(1, 2, 3): 2, (2, 3, 1): 1, (3, 1, 2): 1}


def test_nothing(spark):
    assert collocations.collocations(documents(spark, []), least=1).collect() == []
