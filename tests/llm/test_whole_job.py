"""Cases in which an operator once did less than the whole job."""

import numpy as np
from llm_tables import documents

from orderflux.llm import chunks, decontaminate, edit_fingerprint, mixing, simhash


def some_words(rng, n, low=3, high=9):
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(low, high))) for _ in range(n)]


def test_stage_keeps_one_of_each_component(spark):
    """The pipeline's near-dup stage against all pairs of fingerprints."""
    import corpus_pipeline

    rng = np.random.default_rng(31)
    texts = []
    for _ in range(12):
        base = some_words(rng, 400)
        for changes in (0, 0, 1, 1, 2, 3, 9):
            words = list(base)
            for at in rng.integers(0, len(words), changes):
                words[at] = "changed" + words[at]
            texts.append(" ".join(words))
    ids = rng.permutation(len(texts)).tolist()
    codes = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    group = list(range(len(texts)))
    for a, b in zip(*np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= simhash.RADIUS)):
        group = [group[b] if g == group[a] else g for g in group]
    want = sorted(min(i for i, g in zip(ids, group) if g == one) for one in set(group))
    df = documents(spark, [(i, t, None, None) for i, t in zip(ids, texts)])
    got = corpus_pipeline.distinct_documents(spark, df, "")
    assert sorted(r["doc_id"] for r in got.collect()) == want and got.columns == df.columns
    assert 12 <= len(want) < len(set(texts))


def test_rows_of_one_id_with_unlike_texts_stay(spark):
    rng = np.random.default_rng(32)
    x, y = (" ".join(some_words(rng, 60)) for _ in "xy")
    df = documents(spark, [(3, x, None, None), (5, x, None, None), (5, y, None, None), (7, x + " end", None, None),
                           (7, "unlike", None, None), (8, x, None, None), (8, y, None, None)])
    got = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect() if r["text"] != x + " end")
    assert got == [(3, x), (5, y), (7, "unlike")]


def test_near_id_against_all_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(33)
    prints = []
    for _ in range(15):
        base = rng.integers(0, 256, 64, np.uint8)
        for changes in rng.integers(0, 26, 20):
            one = base.copy()
            one[rng.permutation(64)[:changes]] = rng.integers(0, 256, changes)
            prints.append(one)
    same = np.array([[(a == b).mean() for b in prints] for a in prints])
    want = {i: min(np.flatnonzero(row >= 0.8)) for i, row in enumerate(same)}
    df = spark.createDataFrame([(i, bytes(p)) for i, p in enumerate(prints)], "doc_id long, fingerprint binary")
    for large in (edit_fingerprint.LARGE, 8):
        monkeypatch.setattr(edit_fingerprint, "LARGE", large)
        got = {bytes(r["fingerprint"]): r["near_id"] for r in edit_fingerprint.near_heads(df).collect()}
        assert {i: got[bytes(p)] for i, p in enumerate(prints)} == want


def test_short_items_and_scripts_without_blanks(spark):
    items = spark.createDataFrame([(1, "Two plus two four"), (2, "北京是中国的首都，人口很多"), (3, "yes"), (4, "one two three four five six"),
                                   (5, "!?"), (6, "")], "item_id long, text string")
    texts = ["well, two plus TWO (four) is right", "two plus two is four", "他说北京是中国的首都，人口很多。", "北京是首都", "oh yes", "yesterday",
             "x one two three four five y", "", None]
    df = documents(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(df, items).collect()}
    assert got == {0: [1], 1: [], 2: [2], 3: [], 4: [3], 5: [], 6: [4], 7: [], 8: []}


def test_alike_rows_share_their_copies(spark):
    df = documents(spark, [(1, "a b c", "en", "s")] * 1000 + [(2, "a b c d", "en", "s"), (3, "e f", "en", None)]).repartition(7)
    plan = mixing.mix(df).where("doc_id = 1").agg({"copies": "sum", "doc_id": "count"}).first()
    assert plan["count(doc_id)"] == 1000 and abs(plan["sum(copies)"] - 1500) <= 3
    out = mixing.mixed(df)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert rows[1] == plan["sum(copies)"]
    again = mixing.mix(df.repartition(3)).agg({"copies": "sum", "taken": "sum"}).first()
    assert again == mixing.mix(df).agg({"copies": "sum", "taken": "sum"}).first()


def test_planted_passages_of_short_words(spark):
    """Passages of 51 words that repeat, words of three letters on average, in texts that share nothing else."""
    rng = np.random.default_rng(34)
    rows, planted = [], []
    for k in range(200):
        passage = " ".join(some_words(rng, 51, 1, 6))
        for doc in (2 * k, 2 * k + 1):
            a, b = (" ".join(some_words(rng, int(rng.integers(20, 120)))) for _ in "ab")
            rows.append((doc, f"{a} {passage} {b}", None, None))
        planted.append(2 * k + 1)
    rows += [(1000 + k, " ".join(some_words(rng, 150)), None, None) for k in range(200)]
    got = {r["doc_id"]: r["n_removed"] for r in chunks.passage_report(documents(spark, rows)).collect()}
    assert np.mean([got[d] > 0 for d in planted]) >= 0.98
    assert all(n == 0 for d, n in got.items() if d not in planted)


def test_chunk_ends_against_a_byte_loop():
    rng = np.random.default_rng(35)
    for size in (0, 1, 15, 16, 17, 40, 3000):
        data = " ".join(some_words(rng, size // 5 + 1)).encode()[:size] if size % 2 else ("é\u4e2d" * size).encode()[:size * 2]
        data = data.decode("utf-8", "ignore").encode()
        ends, last, h = [], None, 0
        for k, byte in enumerate(data):
            h = 0
            for back in range(16):
                if k - back >= 0:
                    h += int(chunks._GEAR[data[k - back]]) << back
            if h % (1 << 16) < (1 << 16) // chunks.RARE:
                at = k + 1
                if (last is None or at - last >= chunks.GAP) and at < len(data) and data[at] & 0xC0 != 0x80 and (
                        last is not None or at + chunks.GAP >= chunks.GAP):
                    ends.append(at)
                last = at
        assert chunks.chunk_ends(data).tolist() == (ends + [len(data)] if data else [])
