"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from orderflux.llm.common import col, stable

#: Bytes of a turn's digest, turns of a conversation in its first sort key, and the factor by which keys of conversations
#: grow that share all of it.
DIGEST, KEY_TURNS, GROWTH = 16, 512, 8
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Nodes in a batch of results.
BATCH = 50_000

#: Nodes of a sorted partition: ``closed`` ones are whole, ``open`` ones may go on in a neighbouring partition, and
#: ``end`` rows name the conversations that end at an open one. ``link`` is an open node's prefix, for the others that of
#: their node or of an open parent. ``edge_words`` and ``inner`` are sums over the edges within the node.
FOREST = pa.schema([
    ("kind", pa.string()), ("link", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("forks", pa.int64()), ("deeper", pa.bool_()),
    ("inner", pa.int64()), ("edge_words", pa.int64()), ("words", pa.int64()), ("above", pa.int64()), ("part", pa.int64()),
    ("last_ends", pa.bool_()), ("ends_sha256", pa.string())])
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as numbered turns (conv_id, d from 1, digest, words).

    Turns go by ``turn`` (null first), those alike in it by their digest, so repeated rows count each. A null role or text is
    empty. Rows without conv_id belong to no conversation and are left out. Only digests are shuffled, never texts.
    """
    said, who = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (text, role))
    told = rows.where(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv_id"), col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary"))).alias("digest"),
        F.size(F.regexp_extract_all(said, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    place = Window.partitionBy("conv_id").orderBy("turn", "digest")
    return told.select("conv_id", F.row_number().over(place).alias("d"), "digest", "words")


def forked(turns: DataFrame, step: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c rebuilt as a fork: the first h turns of conversation c - c % step, then its own after h.

    h is the unsigned CRC-32 of the decimal c, modulo ``heads``. Rows (conv_id, d, digest, words); a conversation that
    comes out without turns has one row with a null d.
    """
    turns = stable(turns)
    convs = turns.groupBy("conv_id").agg(F.max("d").alias("n")).withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % step,
        "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")})
    counts = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(counts, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    head = turns.where(F.col("d") < heads).select(F.col("conv_id").alias("base"), "d", "digest", "words")
    first = convs.join(head, "base").where("d <= taken").select("conv_id", "d", "digest", "words")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("d > h").select(
        "conv_id", F.expr("d - h + taken").alias("d"), "digest", "words")
    none = convs.where("taken = 0 and n <= h").select(
        "conv_id", F.lit(None).cast("int").alias("d"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("words"))
    return first.union(own).union(none)


def sort_keys(turns: DataFrame) -> DataFrame:
    """A row per conversation: (conv_id, n turns, m of them in the key, key of their digests, words of each).

    A key holds the first ``KEY_TURNS`` turns. Conversations that are longer and share all of them get keys
    ``GROWTH`` times as long, until no two share a whole key or the keys hold all. Rows are bounded by ``GROWTH`` times
    what conversations have in common, and what is left of a conversation is a path of its own.
    """
    done, size, rest = None, KEY_TURNS, turns
    while True:
        parts = F.sort_array(F.collect_list(F.when(F.col("d") <= size, F.struct("d", "digest", "words"))))
        keys = stable(rest.groupBy("conv_id").agg(F.coalesce(F.max("d"), F.lit(0)).alias("n"), parts.alias("parts")).select(
            "conv_id", "n", F.size("parts").alias("m"),
            F.unhex(F.array_join(F.transform(F.col("parts")["digest"], lambda x: F.hex(x)), "")).alias("key"),
            F.col("parts")["words"].alias("words")))
        full = keys.where(F.col("n") >= size).select("conv_id", "n", F.md5("key").alias("mark"))
        marks = full.groupBy("mark").count().where("count > 1")
        shared = stable(full.where(F.col("n") > size).join(marks, "mark").select("conv_id"))
        if shared.isEmpty():
            return keys if done is None else done.union(keys)
        kept = keys.join(shared, "conv_id", "left_anti")
        done = kept if done is None else done.union(kept)
        rest, size = rest.join(shared, "conv_id", "left_semi"), size * GROWTH


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // DIGEST


def merged_runs(lcp: list[int], inner: list[bool], shown: list[int], convs: list[int]) -> list[list]:
    """Components of sorted items whose neighbours are joined in descending depth of their common prefixes.

    Entry i of ``lcp`` is the edge between items i and i + 1, ``inner`` where the upper one ends there; an item's own
    path has ``shown`` turns. Components are runs of neighbours, so union-find keeps them at their two ends. A join
    below the depths of both makes a branching node; one at the depth of either goes on with it. Rows [first, last, depth, forks,
    smallest conv, top, parent's row]: the component's nodes are those of depths top to depth.
    """
    other = list(range(len(shown)))
    row_at = list(range(len(shown)))                                # at a run's first item: its row
    rows = [[i, i, shown[i], 0, convs[i], 0, -1] for i in range(len(shown))]
    children: dict[int, list[int]] = {}
    for e in sorted(range(len(lcp)), key=lcp.__getitem__, reverse=True):
        first, last, depth = other[e], other[e + 1], lcp[e]
        a, b = row_at[first], row_at[e + 1]
        same = [r for r in (a, b) if rows[r][2] == depth]
        if same:
            into = max(same, key=lambda r: len(children.get(r, ())))
        else:
            into = len(rows)
            rows.append([first, last, depth, 0, 0, 0, -1])
        held = children.setdefault(into, [])
        forks = sum(rows[r][3] for r in same) + (not inner[e])
        low = min(rows[a][4], rows[b][4])
        for r in (a, b):
            if r == into:
                continue
            if r in same:                                           # one node with ``into``
                held += children.pop(r, [])
                rows[r][2] = -1
            else:
                rows[r][5] = depth + 1
                held.append(r)
        rows[into][:5] = [first, last, depth, forks, low]
        other[first], other[last], row_at[first] = last, first, into
    for parent, below in children.items():
        for r in below:
            rows[r][6] = parent
    return rows


def _path(key: bytes, depth: int) -> list[bytes]:
    """Names of the nodes on a key's path, from the root's."""
    state, out = hashlib.md5(b"root"), []
    out.append(state.digest())
    for d in range(depth):
        state.update(key[d * DIGEST:(d + 1) * DIGEST])
        out.append(state.digest())
    return out


def forest(part: int, convs: list[int], lens: np.ndarray, shown: np.ndarray, keys: list[bytes], words: np.ndarray,
           starts: np.ndarray) -> Iterator[pa.Table]:
    """The trie of one partition's items, which come sorted by key and conversation.

    ``words`` holds 0 and the running sums of each item's words, beginning at ``starts``. Nodes on the path of the first
    or the last item are open: neighbouring partitions may hold more of them.
    """
    n = len(convs)
    lcp = np.array([common_turns(a, b) for a, b in zip(keys, keys[1:])], np.int64)
    inner = lcp == lens[:-1]
    rows = merged_runs(lcp.tolist(), inner.tolist(), shown.tolist(), convs)
    runs = np.array(rows, np.int64).reshape(-1, 7)
    first, last, depth, forks, low, top, parent = runs.T
    is_open = (first == 0) | (last == n - 1)
    paths = {0: _path(keys[0], int(shown[0])), n - 1: _path(keys[-1], int(shown[-1]))}
    edge_sum = np.r_[0, np.cumsum(words[starts[1:] + lcp])] if n > 1 else np.zeros(1, np.int64)
    inner_sum = np.r_[0, np.cumsum(inner)]

    ends: dict[int, list[int]] = {}
    for r in np.flatnonzero((depth >= top) & (lens[first] == depth)):
        stop = first[r]
        while stop <= last[r] and lens[stop] == depth[r]:
            stop += 1
        ends[int(r)] = convs[first[r]:stop]

    def name(r: int, d: int) -> bytes:
        return paths[0 if first[r] == 0 else n - 1][d]

    count = np.maximum(depth - top + 1, 0)
    bounds = np.r_[0, np.cumsum(count)]
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BATCH, "right")) - 1)
        span = np.arange(at, upto)
        r = np.repeat(span, count[span])
        d = top[r] + np.arange(len(r)) - np.repeat(bounds[span] - bounds[at], count[span])
        at = upto
        if not len(r):
            continue
        begins, is_top, lowest = starts[first[r]], d == top[r], d == depth[r]
        above = np.where(d > 0, words[begins + np.maximum(d - 1, 0)], 0)
        wide = is_open[r]
        over = parent[r]
        outer = is_top & (over >= 0) & is_open[over]                # closed, or open, below an open node of another run
        up = np.where(is_top & (over >= 0), low[over], low[r])
        link, above_name = [], []
        for x, k, w, o, p in zip(r.tolist(), d.tolist(), wide.tolist(), outer.tolist(), over.tolist()):
            link.append(name(x, k) if w else name(p, k - 1) if o else b"%d %d" % (convs[first[x]], k))
            above_name.append(name(x, k - 1) if w and k else None)
        sha = [hashlib.sha256(",".join(map(str, ends.get(x, ()) if e else ())).encode()).hexdigest()
               for x, e in zip(r.tolist(), lowest.tolist())]
        yield pa.table({
            "kind": np.where(wide, "open", "closed"), "link": pa.array(link, pa.binary()),
            "parent": pa.array(above_name, pa.binary()), "conv_id": low[r], "depth": d,
            "parent_conv_id": pa.array(up, mask=wide | outer | (d == 0)), "n_convs": last[r] - first[r] + 1,
            "forks": np.where(lowest, forks[r], 0), "deeper": lens[last[r]] > d, "inner": inner_sum[last[r]] - inner_sum[first[r]],
            "edge_words": edge_sum[last[r]] - edge_sum[first[r]], "words": words[begins + d], "above": above,
            "part": np.full(len(r), part), "last_ends": (last[r] == n - 1) & (lens[-1] == d), "ends_sha256": sha}, FOREST)
    for r, ids in ends.items():
        if is_open[r]:
            size = len(ids)
            yield pa.table({c.name: pa.nulls(size, c.type) for c in FOREST} | {
                "kind": ["end"] * size, "link": pa.array([name(r, int(depth[r]))] * size, pa.binary()), "conv_id": ids}, FOREST)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    convs, lens, shown, keys, sums = [], [], [], [], []
    for batch in batches:
        convs += batch["conv_id"].to_pylist()
        keys += batch["key"].to_pylist()
        lens.append(batch["n"].to_numpy())
        shown.append(batch["m"].to_numpy())
        sums += [np.r_[0, np.cumsum(w.values.to_numpy(), dtype=np.int64)] for w in batch["words"]]
    if convs:
        starts = np.r_[0, np.cumsum([len(s) for s in sums])[:-1]].astype(np.int64)
        for out in forest(TaskContext.get().partitionId(), convs, np.concatenate(lens).astype(np.int64),
                          np.concatenate(shown).astype(np.int64), keys, np.concatenate(sums), starts):
            yield from out.to_batches()


def _joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each link; rows come sorted by both."""
    def row(link, state):
        return pa.RecordBatch.from_arrays([pa.array([link], pa.binary()), pa.array([state.hexdigest()])], names=["link", "ends"])

    now, state = None, None
    for batch in batches:
        for link, conv in zip(batch["link"].to_pylist(), batch["conv_id"].to_pylist()):
            if link != now:
                if now is not None:
                    yield row(now, state)
                now, state = link, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
    if now is not None:
        yield row(now, state)


def _merged(forests: DataFrame) -> DataFrame:
    """The open nodes of all partitions as whole ones, with ``link``.

    A node that stands in several partitions stands in neighbouring ones, and holds the edge across each boundary between
    them. The deepest such node of a boundary gives the edge's depth and words.
    """
    same, part = Window.partitionBy("link").orderBy("part"), Window.partitionBy("part")
    parts = forests.where("kind = 'open'").withColumn("goes_on", F.lag("part").over(same).isNotNull()).withColumn(
        "after_end", F.lag("last_ends").over(same))
    edge = F.max(F.when(F.col("goes_on"), F.struct("depth", "words", "after_end"))).over(part)
    parts = parts.withColumn("edge", edge).withColumns({
        "edge_words": F.col("edge_words") + F.when(F.col("goes_on"), F.col("edge.words")).otherwise(0),
        "inner": F.col("inner") + F.when(F.col("goes_on") & F.col("edge.after_end"), 1).otherwise(0),
        "forks": F.col("forks") + F.when(F.col("goes_on") & (F.col("depth") == F.col("edge.depth"))
                                         & ~F.col("edge.after_end"), 1).otherwise(0)})
    nodes = parts.groupBy("link").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.max("above").alias("above"), F.max("deeper").alias("deeper"),
        *[F.sum(c).alias(c) for c in ("n_convs", "forks", "inner", "edge_words")])
    ends = (forests.where("kind = 'end'").select("link", "conv_id").repartition("link")
            .sortWithinPartitions("link", "conv_id").mapInArrow(_joined_hashes, "link binary, ends string"))
    return stable(nodes.join(ends, "link", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))))


def trie(turns: DataFrame) -> DataFrame:
    """A row per node of the trie of all conversations' turns (conv_id, d, digest, words), every column named in ``RESULT``.

    A depth-d node is a sequence of first d turns that some conversation has; its members begin with it and its conv_id is
    their smallest. ``n_leaves`` and ``saved_tokens`` are sums over the subtree: nodes without children, and words that
    members share. ``ends_sha256`` hashes the comma-joined ids of the members that end there. Turns without d stand for
    conversations without turns, which end at the root; without conversations there are no rows. Copies are
    members like any other.

    Conversations are sorted by their turns' digests over range partitions; each partition builds a forest by union-find
    over its neighbours' common prefixes; nodes at its two borders, a path each, are contracted to one row each and merged
    with their like by an aggregate. A partition's keys and its nodes' sums are all that a task holds.
    """
    keys = sort_keys(turns)
    forests = stable(keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
                     .mapInArrow(_forests, from_arrow_schema(FOREST)))
    merged = _merged(forests)
    above = merged.select(F.col("link").alias("parent"), F.col("conv_id").alias("above_conv"))
    nodes = merged.join(above, "parent", "left").withColumn("parent_conv_id", F.col("above_conv"))
    closed = forests.where("kind = 'closed'").join(above.withColumnRenamed("parent", "link"), "link", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above_conv"))
    sums = {"n_children": F.col("forks") + F.col("deeper").cast("long"), "n_leaves": F.col("n_convs") - F.col("inner"),
            "saved_tokens": F.col("edge_words") - (F.col("n_convs") - 1) * F.col("above")}
    out = nodes.withColumns(sums).select(RESULT).union(closed.withColumns(sums).select(RESULT))
    cut = keys.where("n > m").select("conv_id", "n", "m")
    if cut.isEmpty():
        return out
    ends = F.when(F.col("d") == F.col("n"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NO_ENDS)
    rest = turns.join(cut, "conv_id").where("d > m").select(
        "conv_id", F.col("d").cast("long"), F.col("conv_id"), F.lit(1).cast("long"), (F.col("d") < F.col("n")).cast("long"),
        F.lit(1).cast("long"), F.lit(0).cast("long"), ends)
    return out.union(rest)
