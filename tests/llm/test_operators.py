"""The corpus operators against brute force, SQL and held-out labels on the smallest tables."""

import hashlib
import pathlib
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from llm_tables import SF_DIR, documents

ROOT = pathlib.Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import corpus_pipeline  # noqa: E402
from compare import TABLES, rows_of  # noqa: E402
from orderflux.llm import (chunks, decontaminate, edit_fingerprint, language, line_dedup, mixing, pii, quality,  # noqa: E402
                           queries, simhash)
from orderflux.llm.common import connected, table  # noqa: E402

needs_tables = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="driver tables absent")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in table(spark, SF_DIR, "documents").collect()}


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF_DIR), con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    grams = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, ids, radius):
    root = list(range(len(codes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(codes)):
        for b in range(a):
            if bin(codes[a] ^ codes[b]).count("1") <= radius:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(codes)):
        groups.setdefault(find(k), []).append(ids[k])
    return {i: min(g) for g in groups.values() for i in g}


@needs_tables
def test_simhash_against_all_pairs(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_simhash_near_dedup"](spark, SF_DIR).collect()}
    codes = {i: plain_fingerprint(r["text"]) for i, r in docs.items()}
    assert {i: f"{c:016x}" for i, c in codes.items()} == {i: r["fingerprint"] for i, r in got.items()}
    assert plain_components(list(codes.values()), list(codes), 2) == {i: r["component_id"] for i, r in got.items()}


@pytest.mark.parametrize("large", [2048, 40])
@pytest.mark.parametrize("radius", [1, 2, 4])
def test_links_tie_all_near_codes(spark, monkeypatch, radius, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "SMALL", large // 4)
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 6, np.uint64)
    codes = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), False)) for c in np.repeat(centres, 25)}
    codes = sorted(codes)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    links = simhash.near_links(spark.createDataFrame([(*c, 0) for c in signed], "code long, extra long"), radius)
    roots = {r["node"]["code"] & (1 << 64) - 1: r["root"]["code"] & (1 << 64) - 1 for r in connected(links).collect()}
    want = plain_components(codes, codes, radius)
    groups = {}
    for c in codes:
        groups.setdefault(roots.get(c, c), set()).add(c)
    plain = {}
    for c, r in want.items():
        plain.setdefault(r, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_connected_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(edges).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


def test_keep_one(spark):
    text = " ".join(f"word{k}" for k in range(50))
    df = documents(spark, [(5, text, "en", "a"), (3, text, "en", "a"), (3, text, "en", "a"), (9, "quite another", "en", "a")])
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [3, 9]


def test_line_windows(spark):
    body = "alpha one\nbeta two\ngamma three"
    df = documents(spark, [(1, f"start\n{body}\nend", None, None), (2, f"{body}\n\nown line", None, None),
                           (3, "alpha one\nbeta two\nother", None, None), (4, "a\n" * 5 + "a", None, None)])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: f"start\n{body}\nend", 2: "\nown line", 3: "alpha one\nbeta two\nother", 4: "a"}


@needs_tables
def test_passages_of_fifty_words_are_found(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_substring_dedup"](spark, SF_DIR).collect()}
    seen, missed = {}, []
    for i, r in sorted(docs.items()):
        words = r["text"].split()
        grams = {" ".join(words[k:k + 50]) for k in range(len(words) - 49)}
        if any(g in seen for g in grams) and not got[i]["n_removed"]:
            missed.append(i)
        seen |= dict.fromkeys(grams, i)
    assert not missed


def test_passage_is_cut_after_an_insertion(spark):
    rng = np.random.default_rng(1)

    def words(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    shared, first, second = words(120), words(80), words(80)
    df = documents(spark, [(1, f"{first} {shared} end", None, None), (2, f"an insertion {second} {shared} tail", None, None),
                           (3, words(200), None, None)])
    report = {r["doc_id"]: r for r in chunks.passage_report(df).collect()}
    assert report[1]["n_removed"] == report[3]["n_removed"] == 0 and report[2]["earlier_ids"] == [1]
    assert report[2]["n_removed"] > 0.7 * len(shared)
    cut = {r["doc_id"]: r["text"] for r in chunks.dedup_substrings(df).collect()}
    assert second in cut[2] and len(cut[2].encode()) == report[2]["n_bytes"] - report[2]["n_removed"]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            if (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "email"
                    or kind == "card" and 16 <= len(digits) <= 19 and sum(t - 9 * (t > 9) for t in twice) % 10 == 0
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD_TEXTS = ["a@b.c@d.e x@y..z 1.2.3.4.5.6.7.8.9 256.1.1.1 0001.2.3.004", "4111 1111 1111 1111 5 4111-1111-1111-1111",
             "+1 (017) 555-7713 +49 30 1234567 +1", "é@x.y a@b-c.de. @@ a@ @b.c \U0001F600 +1..2 9999.1.2.3.4"]


def test_rules_on_odd_texts():
    rng = np.random.default_rng(3)
    texts = ODD_TEXTS + ["".join(rng.choice(list("aé@.+- ()0123456789"), 60)) for _ in range(3000)]
    for text in texts:
        assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text)] == plain_spans(text), text


@needs_tables
def test_personal_data_base(spark, docs):
    for r in queries.QUERIES["op5_personal_data"](spark, SF_DIR).collect():
        base = plain_spans(docs[r["doc_id"]]["text"])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, r["spans"].split(",")))


def test_field_takes_a_number_that_the_rule_drops(spark):
    # Repeated numbers of one kind teach the field that repetitions agree.
    rows = [(k, f"some words 4111111111111111 and more, later 4111111111111111 in flat {k}", None, None) for k in range(90)]
    rows.append((99, "room 12 4111111111111111 here, then 4111111111111111 again", None, None))
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, rows)).collect()}
    assert got[99]["n_card"] == 1 and got[99]["spans"] == "card:8:24,card:36:52"


def test_belief_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(5)
    unary, pots = rng.normal(size=(4, 3)), rng.normal(size=(2, 3, 3))
    edges = np.array([(0, 1, 0), (1, 2, 1), (1, 3, 0)])
    total = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(unary[n, y[n]] for n in range(4)) + sum(pots[t][y[a], y[b]] for a, b, t in edges))
        for n in range(4):
            total[n, y[n]] += w
    assert pii.marginals(unary, edges, pots) == pytest.approx(total / total.sum(1, keepdims=True), abs=1e-3)


@needs_tables
def test_language_of_held_out_rows(spark, docs):
    rows = queries.QUERIES["op6_language_id"](spark, SF_DIR).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) >= 0.95


def test_bundle_does_not_depend_on_the_batch():
    letters, texts = language.Letters(), ["Some text, éà!", "x", "", "12 34", "Some text, éà!" * 50]
    units, known = letters.bundle(texts)
    assert known.tolist() == [True, True, False, False, True]
    for text, unit in zip(texts, units):
        assert np.allclose(language.Letters().bundle([text])[0][0], unit, atol=1e-6)


def covered(doc, item, least):
    """Greedy string tiling as it is defined: mark a longest unmarked common run, again and again."""
    used_d, used_i, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for b in range(len(item)):
            for a in range(len(doc)):
                k = 0
                while (a + k < len(doc) and b + k < len(item) and doc[a + k] == item[b + k]
                       and a + k not in used_d and b + k not in used_i):
                    k += 1
                if k > best[0]:
                    best = (k, b, a)
        k, b, a = best
        if k < least:
            return total
        used_d |= set(range(a, a + k))
        used_i |= set(range(b, b + k))
        total += k


def test_tiling_against_its_definition():
    rng = np.random.default_rng(7)
    for _ in range(60):
        item = rng.choice(list("abcd"), 24).tolist()
        cut = int(rng.integers(5, 19))
        doc = rng.choice(list("abcd"), 20).tolist() + item[cut:] + ["z"] + item[:cut] + rng.choice(list("abcd"), 9).tolist()
        found, shares = decontaminate.Items([(1, " ".join(item))], 5).coverage(" ".join(doc))
        want = covered(doc, item, 5)
        # Ties between equally long runs may be marked in another order.
        assert found == [1] and abs(shares[0] * 24 - want) <= 5 and shares[0] >= 0.6


@needs_tables
def test_benchmark_passages_are_found(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_benchmark_decontamination"](spark, SF_DIR).collect()}
    items = [re.findall(r"\w+", r["text"].lower()) for r in table(spark, SF_DIR, "benchmark").collect()]
    for i, r in docs.items():
        text = " " + " ".join(re.findall(r"\w+", r["text"].lower())) + " "
        assert got[i]["contaminated"] >= any(" " + " ".join(w) + " " in text for w in items)
    assert sum(r["contaminated"] for r in got.values()) < 0.1 * len(docs)


def test_blocks_of_items_give_one_result(spark, monkeypatch):
    df = documents(spark, [(k, f"x y z the quick brown fox number{k} jumps over the lazy dog today", None, None) for k in range(9)])
    items = spark.createDataFrame([(k, f"the quick brown fox number{k} jumps over the lazy dog") for k in range(5)],
                                  "item_id long, text string")
    whole = decontaminate.contamination(df, items).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    assert decontaminate.contamination(df, items).orderBy("doc_id").collect() == whole
    assert [r["item_ids"] for r in whole][:5] == [[k] for k in range(5)]


@needs_tables
def test_quality_of_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op8_quality_classifier"](spark, SF_DIR).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows.values())
    right = [rows[r["doc_id"]]["predicted"] == r["quality"] for r in table(spark, SF_DIR, "labels").collect()
             if rows[r["doc_id"]]["held_out"]]
    assert np.mean(right) >= 0.9


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(9)
    score, lengths, turn = rng.normal(size=7), np.array([3, 1, 3]), rng.normal(size=(2, 2))
    good, pair, _ = quality.marginals(score, lengths, turn)
    want, want_pair, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        rows = [(np.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(turn[y[k], y[k + 1]] for k in range(n - 1))), y)
                for y in np.ndindex(*[2] * n)]
        z = sum(w for w, _ in rows)
        want += [sum(w for w, y in rows if y[k]) / z for k in range(n)]
        for w, y in rows:
            for k in range(n - 1):
                want_pair[y[k], y[k + 1]] += w / z
        at += n
    assert good == pytest.approx(want) and pair == pytest.approx(want_pair)


def plain_targets(sizes):
    """{source: target} by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


@pytest.mark.parametrize("group", [4096, 8])
def test_mix_meets_its_targets(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    rng = np.random.default_rng(11)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), None, [None, "a", "b", "é", "B"][int(rng.integers(0, 5))])
            for k in range(600)]
    df = documents(spark, rows)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert len(got) == 600
    sizes, taken = {}, {}
    for i, text, _, source in rows:
        size = len(text.split())
        assert got[i]["size"] == size and got[i]["taken"] in (0, size, 2 * size)
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + got[i]["taken"]
    want = plain_targets(sizes)
    for i, _, _, source in rows:
        assert got[i]["source_size"] == sizes[source] and got[i]["target"] == pytest.approx(want[source])
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    assert mixing.mixed(df).count() == sum(r["copies"] for r in got.values())


def test_rounding_keeps_the_expected_copies():
    import pyarrow as pa
    rng = np.random.default_rng(13)
    size = rng.integers(1, 500, 40)
    rows = pa.table({"doc_id": list(range(40)), "mark": [0] * 40, "size": size, "p": [0.37] * 40})
    runs = [mixing.settle(rows, [k]).sort_by("doc_id")["p"].to_numpy() for k in range(800)]
    assert all(((p > 0) & (p < 1)).sum() <= 1 and (p * size).sum() == pytest.approx(0.37 * size.sum()) for p in runs)
    assert np.abs(np.mean(runs, axis=0) - 0.37).max() < 0.08


def plain_walk(text):
    """The embedding one step at a time."""
    i = step = 0
    shown = []
    codes = edit_fingerprint._classes(text) // edit_fingerprint.PERIOD
    while i < len(codes):
        shown.append(i)
        i += int(edit_fingerprint._MOVES[codes[i], step % edit_fingerprint.PERIOD])
        step += 1
    return shown, codes


def test_walk_one_step_at_a_time():
    rng = np.random.default_rng(15)
    texts = ["", "a", "éé", *["".join(rng.choice(list("abcé \n"), int(rng.integers(1, 400)))) for _ in range(60)]]
    got = edit_fingerprint.fingerprints(texts)
    turned = np.roll(edit_fingerprint._SYMBOL, 1, axis=1)
    for text, print_ in zip(texts, got):
        if not text:
            assert print_ == bytes(edit_fingerprint.SAMPLES)
            continue
        shown, codes = plain_walk(text)
        for s, records in enumerate(edit_fingerprint._RECORDS):
            at = shown[max(r for r in records if r < len(shown))]
            after = codes[min(at + 1, len(codes) - 1)]
            assert print_[s] == edit_fingerprint._SYMBOL[s, codes[at]] ^ turned[s, after]
        assert edit_fingerprint.fingerprints([text]) == [print_]


@needs_tables
def test_edited_texts(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_document_fingerprints"](spark, SF_DIR).collect()}
    order = sorted(docs, reverse=True)
    for k, i in enumerate(order):
        text, after = docs[i]["text"], docs[order[(k + 1) % len(order)]]["text"]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = edit_fingerprint.fingerprints([text, edited, after])
        same = [np.mean([x == y for x, y in zip(a, o)]) for o in (b, c)]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (a.hex(), b.hex())
        assert (got[i]["near_edited"], got[i]["near_next"]) == tuple(same)
    assert all(got[i]["near_id"] <= i for i in order)


@needs_tables
def test_pipeline(spark, docs):
    frame, seen = table(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF_DIR)
        assert out.columns == frame.columns
        seen.append((frame, out))
        frame = spark.createDataFrame(out.collect(), out.schema)
    quality_in, quality_out = seen[0]
    good = {r["doc_id"]: r["quality"] for r in table(spark, SF_DIR, "labels").collect()}
    kept = {r["doc_id"] for r in quality_out.collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in good.items()]) >= 0.95
    before, after = seen[2]
    texts = [r["text"] for r in after.collect()]
    assert len(set(texts)) == len(texts) and {r["text"] for r in before.collect()} >= set(texts)
    assert corpus_pipeline.run(spark, SF_DIR).count() == frame.count() > 0
