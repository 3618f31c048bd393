"""Index of order ids under ``root``/keys: id -> segment and month, in hash buckets with a Bloom filter each.

A batch adds one folder of entries and one of filter words, so an update costs what the batch holds. A lookup reads the
filters of the buckets it meets, and entries only where a filter cannot rule all its ids out. The index is derived from the
stores: its manifest names the version of each store that it covers, and :func:`refresh` brings it up after a crash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux import config
from orderflux.session import stable
from orderflux.sources.storage import (
    MONTH, changed_since, list_names, manifest, publish_entry, read_months, retain, version_of)

ENTRIES, FILTERS = "id string, segment string, month string, added long, bucket int", "word int, bits long, bucket int"


def table_of(root: str) -> str:
    return f"{root}/keys"


def bucketed(ids: DataFrame, buckets: int, words: int) -> DataFrame:
    """``ids`` with the bucket of each id, the filter word there and its four bits."""
    place, bits = F.xxhash64("id", F.lit(1)), F.xxhash64("id", F.lit(2))
    mask: Column = F.lit(0).cast("long")
    for k in range(4):
        at = F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return ids.withColumns({
        "bucket": F.pmod(place, F.lit(buckets)).cast("int"),
        "word": F.pmod(F.shiftrightunsigned(place, 24), F.lit(words)).cast("int"), "mask": mask})


def _read(spark: SparkSession, schema: str, folders: dict, buckets) -> DataFrame | None:
    paths = [p for b in buckets for p in folders.get(str(b), ())]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def _buckets(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("bucket").distinct().collect())        # at most the number of buckets


def lookup(spark: SparkSession, root: str, ids: DataFrame) -> tuple[DataFrame, list[int]]:
    """(id, segment, month) of the ``ids`` (one column, ``id``) that are known, and the buckets whose entries were read."""
    entry = manifest(spark, table_of(root))
    none = spark.createDataFrame([], "id string, segment string, month string")
    if entry is None:
        return none, []
    keyed = stable(bucketed(ids.where("id IS NOT NULL").distinct(), entry["n_buckets"], entry["n_words"]))
    filters = _read(spark, FILTERS, entry["filters"], _buckets(keyed))
    if filters is None:
        return none, []
    words = filters.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    maybe = stable(keyed.join(words, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
                   .select("id", "bucket"))
    hit = _buckets(maybe)
    entries = _read(spark, ENTRIES, entry["buckets"], hit)
    if entries is None:
        return none, []
    known = entries.join(maybe.select("id"), "id", "left_semi").groupBy("id", "segment").agg(
        F.max_by("month", "added").alias("month"))
    return stable(known), hit


def _write(rows: DataFrame, folder: str, n_buckets: int, n_words: int) -> tuple[dict, dict]:
    """Entries (id, segment, month, added) and their filters as files; the folders of each bucket."""
    spark, keyed = rows.sparkSession, bucketed(rows, n_buckets, n_words)
    parts = {"entries": keyed.select("id", "segment", "month", "added", "bucket").repartition("bucket"),
             "filters": keyed.groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits")).select(
                 "word", "bits", "bucket").repartition("bucket")}
    made = []
    for name, part in parts.items():
        part.withColumn("b", F.col("bucket")).write.partitionBy("b").parquet(f"{folder}-{name}")
        made.append({n[2:]: [f"{folder}-{name}/{n}"] for n in list_names(spark, f"{folder}-{name}") if n.startswith("b=")})
    return made[0], made[1]


def _joined(old: dict, new: dict) -> dict:
    return {b: [*old.get(b, ()), *new.get(b, ())] for b in {*old, *new}}


def add(spark: SparkSession, root: str, rows: DataFrame, sources: dict[str, int], overlap: bool = False,
        replace: bool = False, follows: bool = False) -> dict:
    """Add entries (id, segment, month) that came with these versions of the stores.

    ``follows``: the entries are of that one version alone, so the index covers it only if it covers the one before;
    otherwise they bring it up to these versions. Additions of two writers do not disturb each other.
    """
    table = table_of(root)
    base = manifest(spark, table)
    size = base or {"n_buckets": config.KEY_BUCKETS, "n_words": config.KEY_FILTER_WORDS}
    folder = f"{table}/data/{version_of(base) + 1:08d}-{uuid.uuid4().hex[:12]}"
    version = F.create_map(*[F.lit(x) for s, v in sources.items() for x in (s, v)])
    rows = rows.where("id IS NOT NULL").select("id", "segment", "month", version[F.col("segment")].cast("long").alias("added"))
    entries, filters = _write(rows, folder, size["n_buckets"], size["n_words"])

    def build(head: dict | None) -> dict:
        old = {} if head is None or replace else head
        covered = dict(old.get("sources", {}))
        for segment, v in sources.items():
            if not follows or covered.get(segment, 0) == v - 1:
                covered[segment] = v
        return {"n_buckets": size["n_buckets"], "n_words": size["n_words"], "sources": covered,
                "overlap": bool(old.get("overlap")) or overlap, "buckets": _joined(old.get("buckets", {}), entries),
                "filters": _joined(old.get("filters", {}), filters)}

    return publish_entry(spark, table, base, build, lambda head: True)


def _ids(spark: SparkSession, table: str, segment: str, head: dict, months, key: str) -> DataFrame | None:
    df = read_months(spark, table, [key, MONTH], months=months, entry=head)
    return None if df is None else df.select(F.col(key).alias("id"), F.lit(segment).alias("segment"), F.col(MONTH).alias("month"))


def refresh(spark: SparkSession, root: str, stores: dict[str, str], key: str) -> dict | None:
    """Bring the index up to the stores (segment -> table): only months changed since are read.

    After a store was replaced as a whole the index is built anew, because ids may be gone.
    """
    entry = manifest(spark, table_of(root))
    heads = {s: h for s, t in stores.items() if (h := manifest(spark, t))}
    covered = (entry or {}).get("sources", {})
    late = {s: h for s, h in heads.items() if covered.get(s, 0) < h["version"]}
    if not late:
        return entry
    anew = entry is None or any(h.get("rebuilt", 0) > covered.get(s, 0) for s, h in late.items())
    due = heads if anew else late
    frames = [_ids(spark, stores[s], s, h, None if anew else changed_since(h, covered.get(s, 0)), key) for s, h in due.items()]
    rows = None
    for f in frames:
        rows = f if rows is None else rows if f is None else rows.unionByName(f)
    if rows is None:
        rows = spark.createDataFrame([], "id string, segment string, month string")
    rows = stable(rows)
    if anew:
        both = rows.groupBy("id").agg(F.count_distinct("segment").alias("n")).where("id IS NOT NULL AND n > 1")
        overlap = not both.isEmpty()
    else:
        known, _ = lookup(spark, root, rows.select("id"))
        overlap = not rows.join(known.withColumnRenamed("segment", "other"), "id").where("segment <> other").isEmpty()
    return add(spark, root, rows, {s: h["version"] for s, h in due.items()}, overlap, replace=anew)


def compact(spark: SparkSession, root: str, most: int = config.KEY_FOLDERS) -> list[int]:
    """Merge the folders of buckets that have more than ``most``; returns these buckets."""
    table = table_of(root)
    base = manifest(spark, table)
    due = [int(b) for b, folders in (base or {}).get("buckets", {}).items() if len(folders) > most]
    if not due:
        return []
    rows = _read(spark, ENTRIES, base["buckets"], due).groupBy("id", "segment").agg(
        F.max_by("month", "added").alias("month"), F.max("added").alias("added"))
    entries, filters = _write(rows, f"{table}/data/{version_of(base) + 1:08d}-{uuid.uuid4().hex[:12]}",
                              base["n_buckets"], base["n_words"])

    def swapped(now: dict, old: dict, new: dict) -> dict:
        return {b: [*new[b], *(p for p in folders if p not in old[b])] if b in new and int(b) in due else folders
                for b, folders in now.items()}

    publish_entry(spark, table, base, lambda head: {
        **head, "buckets": swapped(head["buckets"], base["buckets"], entries),
        "filters": swapped(head["filters"], base["filters"], filters)},
        # Nobody may have merged or replaced the same folders meanwhile.
        lambda head: all(set(base["buckets"][str(b)]) <= set(head["buckets"].get(str(b), ())) for b in due))
    return due


def clear(spark: SparkSession, root: str, versions: int, seconds: float) -> int:
    """Remove folders out of use: see :func:`orderflux.sources.storage.retain`."""
    return retain(spark, table_of(root), versions, seconds,
                  lambda e: [p for kind in ("buckets", "filters") for folders in e[kind].values() for p in folders])
