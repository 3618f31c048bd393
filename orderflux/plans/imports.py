"""Import of exports into the segment stores, publication of the fact, full rebuild.

Layout under ``root``: ``store/<segment>``, ``keys``, ``fact``, ``quarantine``, ``audit``, ``processed``.
A batch is identified by its id; importing the same id again changes nothing. What a batch needs of the stores is found
by the index of order ids, so neither store is read beyond the months that the batch changes.
"""

from __future__ import annotations

import hashlib
import time
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflux import config
from orderflux.functions import expressions as E
from orderflux.functions import values as V
from orderflux.functions.dimensions import local_table
from orderflux.operators import merge as M
from orderflux.operators.cleaning import Cleaned, clean, mark_at_import
from orderflux.operators.normalise import enrich, normalise
from orderflux.session import stable
from orderflux.sources import files as S
from orderflux.sources import key_index as K
from orderflux.sources.storage import (
    MONTH, Conflict, changed_since, holds_batch, list_names, manifest, month_of, read_months, retain, write_months)
from orderflux.streaming.digest import digest_deltas

SEGMENTS = {"agent": "B2B", "master": "B2C"}
KEY, TIME = M.KEY, "订单时间"
_HELPERS = (S.FILE, S.SEQ, S.RANK, "_row", "_turned", "reason")


def store(root: str, segment: str) -> str:
    return f"{root}/store/{segment}"


def _typed(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    out = {c: E.parse_timestamp(F.col(c)) for c in V.DATE_COLUMNS if kinds.get(c) == "string"}
    out.update({c: E.to_number(F.col(c)) for c in V.NUMBER_COLUMNS if kinds.get(c) == "string"})
    return df.withColumns(out) if out else df


def _latest(df: DataFrame) -> DataFrame:
    """Last row per order id by source rank and position, without the helper columns: the aggregate sorts what it carries."""
    order = [c for c in (S.RANK, S.SEQ, "_row") if c in df.columns]
    kept = [c for c in df.columns if c not in _HELPERS]
    return M.keep_last(df, KEY, order, columns=kept) if KEY in df.columns else df.drop(*_HELPERS)


def _months(df: DataFrame) -> list[str]:
    return [r[0] for r in df.select(MONTH).distinct().collect()]     # bounded by the calendar


def stores(root: str) -> dict[str, str]:
    return {s: store(root, s) for s in SEGMENTS}


def append_batch(spark: SparkSession, root: str, incoming: DataFrame, segment: str, batch_id: str,
                 rejected: DataFrame | None = None, source_stamp: int | None = None, digest: bool = False) -> dict:
    """Validate, fingerprint, quarantine, merge, publish and audit one batch of a segment.

    Rows the cleaner has turned away are stored as well: those with a ``reason``, and ``rejected``. ``source_stamp`` is the
    newest modification time of the files the batch comes from; with ``digest`` what the batch changes in the counts of the
    exception digest is stored too. Another batch may be imported at the same time: where both
    change the same months or ids, the one that is second merges again into what the first has left.
    """
    started = time.time()
    if holds_batch(spark, store(root, segment), manifest(spark, store(root, segment)), batch_id):
        K.refresh(spark, root, stores(root), KEY)  # completes an interrupted run; else does nothing
        publish(spark, root)
        return {"segment": segment, "batch_id": batch_id, "skipped": True}

    columns, (unknown, missing) = M.content_columns(incoming), M.checked_headings(incoming)
    turned = F.col("reason").isNotNull() if "reason" in incoming.columns else F.lit(False)
    marked = mark_at_import(incoming.withColumn("_turned", turned))
    if rejected is not None:
        marked = marked.unionByName(rejected.withColumn("_turned", F.lit(True)), allowMissingColumns=True)
    batch = marked.withColumn("_row", F.monotonically_increasing_id()).persist()
    try:
        came, when = ~F.col("_turned"), M.time_column(incoming)
        facts = batch.agg(
            F.count_if(came).alias("n"), F.sum(F.when(came, M.row_number_of(columns))).alias("s"),
            F.min(F.when(came, when)).alias("date_min"), F.max(F.when(came, when)).alias("date_max"),
            F.count_if(F.col("reason").isNotNull()).alias("quarantined")).withColumn(
            "file_hash", M.fingerprint_of(columns, F.col("n"), F.col("s"))).first()
        duplicate_file = _seen(spark, root, facts["file_hash"])
        if facts["quarantined"]:
            _quarantine(root, segment, batch_id, batch.filter("reason IS NOT NULL"))
        good = _typed(batch.filter("reason IS NULL")).withColumn(MONTH, month_of(F.col(TIME)))
        rows = stable(_latest(good))
        for attempt in range(config.COMMIT_ATTEMPTS):
            try:
                merged = _merge(spark, root, segment, batch_id, good, rows, source_stamp, digest)
                break
            except Conflict:
                if attempt + 1 == config.COMMIT_ATTEMPTS:
                    raise
        publish(spark, root)
        counts, summary = merged["counts"], merged["summary"]
        samples = [r.asDict() for r in summary["restatement_samples"]] if summary else []
        result = {
            "ts": time.strftime("%Y-%m-%d %H:%M:%S"), "segment": segment, "batch_id": batch_id,
            "file_hash": facts["file_hash"], "duplicate_file": duplicate_file,
            "rows_in": counts["rows"] + facts["quarantined"], "added": counts["added"],
            "duplicates": counts["duplicates"], "distinct_new": counts["distinct_new"],
            "quarantined": facts["quarantined"],
            "quarantine_file": quarantine_folder(root, segment, batch_id) if facts["quarantined"] else None,
            "restated": summary["restated"] if summary else 0,
            "restatement_samples": samples, "total_rows": sum(merged["entry"]["rows"].values()),
            "elapsed_seconds": round(time.time() - started, 1),
            "date_min": str(facts["date_min"])[:16] if facts["date_min"] else None,
            "date_max": str(facts["date_max"])[:16] if facts["date_max"] else None,
            "unknown_columns": unknown, "missing_expected": missing}
        _audit(spark, root, result)
        return {**result, "restatement_samples": samples[:5], "buckets_read": merged["buckets_read"], "skipped": False}
    finally:
        batch.unpersist()


def _merge(spark: SparkSession, root: str, segment: str, batch_id: str, good: DataFrame, rows: DataFrame,
           source_stamp: int | None, digest: bool) -> dict:
    """Merge the distinct ``rows`` of a batch into the store as it is now, and add their ids to the index."""
    table = store(root, segment)
    K.refresh(spark, root, stores(root), KEY)
    head = manifest(spark, table)
    arriving = rows.select(F.col(KEY).alias("id")).filter(F.col("id").isNotNull())
    found, buckets_read = K.lookup(spark, root, arriving)
    known = found.filter(F.col("segment") == segment).select(F.col("id").alias(KEY), F.col("month").alias(MONTH))
    overlap = not found.filter(F.col("segment") != segment).isEmpty()
    counts = M.merge_counts(known.select(KEY) if head else None, good, KEY).first()
    touched = set(_months(rows)) | set(_months(known))
    existing = read_months(spark, table, months=touched, entry=head) if head else None
    summary = None
    if existing is not None:
        summary = M.restatement_summary(stable(M.restatements(existing, rows))).first()

    if digest:
        # Before the commit and under the batch's name: a batch that is repeated writes the same place again.
        old = None if existing is None else existing.join(arriving.withColumnRenamed("id", KEY), KEY, "left_semi")
        digest_deltas(None if old is None else enrich(normalise(old.drop(MONTH))), enrich(normalise(rows.drop(MONTH)))).write.mode(
            "overwrite").parquet(f"{root}/digest/run={segment}-{batch_id}")

    def fits(newer: dict, months: set[str]) -> bool:
        """None of the ids has come into a month that another batch has changed meanwhile."""
        theirs = read_months(spark, table, [KEY], months=months, entry=newer)
        return theirs is None or arriving.join(theirs, arriving["id"] == theirs[KEY], "left_semi").isEmpty()

    stamp = max(source_stamp or 0, (head or {}).get("source_stamp", 0))
    entry = write_months(M.upsert(existing, rows), table, months=touched, base=head, batch=batch_id, fits=fits,
                         extra={"source_stamp": stamp})
    # Only ids that are new or have moved to another month.
    moved = rows.select(F.col(KEY).alias("id"), MONTH).join(
        known.select(F.col(KEY).alias("id"), MONTH), ["id", MONTH], "left_anti")
    K.add(spark, root, moved.select("id", F.lit(segment).alias("segment"), F.col(MONTH).alias("month")),
          {segment: entry["version"]}, overlap, follows=True)
    return {"entry": entry, "counts": counts, "summary": summary, "buckets_read": buckets_read}


def maintain(spark: SparkSession, root: str, versions: int = config.RETAINED_VERSIONS,
             seconds: float = config.RETAINED_SECONDS) -> dict[str, int]:
    """Merge the index folders of much-used buckets and remove files out of use; folders removed per table."""
    K.compact(spark, root)
    removed = {s: retain(spark, t, versions, seconds) for s, t in {**stores(root), "fact": f"{root}/fact"}.items()}
    return {**removed, "keys": K.clear(spark, root, versions, seconds)}


AUDIT_SCHEMA = T.StructType([
    T.StructField("ts", T.StringType()), T.StructField("segment", T.StringType()),
    T.StructField("batch_id", T.StringType()), T.StructField("file_hash", T.StringType()),
    T.StructField("duplicate_file", T.BooleanType()), T.StructField("rows_in", T.LongType()),
    T.StructField("added", T.LongType()), T.StructField("duplicates", T.LongType()),
    T.StructField("distinct_new", T.LongType()), T.StructField("quarantined", T.LongType()),
    T.StructField("quarantine_file", T.StringType()),
    T.StructField("restated", T.LongType()),
    T.StructField("restatement_samples", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType()) for n in ("order_id", "field", "old", "new")]))),
    T.StructField("total_rows", T.LongType()), T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("date_min", T.StringType()), T.StructField("date_max", T.StringType()),
    T.StructField("unknown_columns", T.ArrayType(T.StringType())),
    T.StructField("missing_expected", T.ArrayType(T.StringType()))])


def _audit(spark: SparkSession, root: str, entry: dict) -> None:
    """One JSON record per batch, in a folder of its own so that a replay cannot add a second."""
    row = spark.createDataFrame([tuple(entry.get(f.name) for f in AUDIT_SCHEMA)], AUDIT_SCHEMA)
    row.coalesce(1).write.mode("overwrite").json(f"{root}/audit/run={entry['segment']}-{entry['batch_id']}")


def read_audit(spark: SparkSession, root: str) -> DataFrame | None:
    if not list_names(spark, f"{root}/audit"):
        return None
    return spark.read.schema(AUDIT_SCHEMA).option("recursiveFileLookup", True).json(f"{root}/audit")


def _seen(spark: SparkSession, root: str, file_hash: str) -> bool:
    audit = read_audit(spark, root)
    return audit is not None and not audit.filter(F.col("file_hash") == file_hash).isEmpty()


def quarantine_folder(root: str, segment: str, batch_id: str) -> str:
    return f"{root}/quarantine/segment={segment}/batch_id={batch_id}"


def _quarantine(root: str, segment: str, batch_id: str, rows: DataFrame) -> None:
    """Store rejected rows by segment and batch, with the reason."""
    _texts(rows.drop(S.SEQ, "_row", "_turned")).write.mode("overwrite").parquet(quarantine_folder(root, segment, batch_id))


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{root}/quarantine")


# --- the fact --------------------------------------------------------------

def publish(spark: SparkSession, root: str, full: bool = False) -> dict | None:
    """Bring the fact up to the stores: only months changed since its last version are rebuilt."""
    for attempt in range(config.COMMIT_ATTEMPTS):
        try:
            return _publish(spark, root, full)
        except Conflict:
            if attempt + 1 == config.COMMIT_ATTEMPTS:
                raise


def _publish(spark: SparkSession, root: str, full: bool) -> dict | None:
    fact = manifest(spark, f"{root}/fact")
    seen = {} if full or not fact else fact.get("sources", {})
    heads = {s: h for s, t in stores(root).items() if (h := manifest(spark, t))}
    versions = {s: h["version"] for s, h in heads.items()}
    if not heads or (not full and fact and seen == versions):
        return None
    months: set[str] = set()
    for s, head in heads.items():
        months |= changed_since(head, seen.get(s, 0))
    parts = []
    for s, head in heads.items():
        df = read_months(spark, store(root, s), months=months, entry=head)
        if df is not None:
            parts.append(normalise(df.drop(MONTH)).withColumn("segment", F.lit(SEGMENTS[s])))
    if not parts:
        return None                                # nothing but rejected rows so far
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.distinct().withColumn(MONTH, month_of(F.col("order_time")))
    overlap = bool((manifest(spark, K.table_of(root)) or {}).get("overlap"))
    # Another publication may have seen other versions: nothing fits, it is done again from the newest.
    return write_months(rows, f"{root}/fact", replace=full or not fact, months=months, base=fact,
                        fits=lambda head, theirs: False, extra={"sources": versions, "unique": not overlap})


def read_fact(spark: SparkSession, root: str, columns=None, months=None, enriched: bool = False):
    """The published fact; ``order_id`` carries the uniqueness the import has checked."""
    df = read_months(spark, f"{root}/fact", columns, months)
    return enrich(df) if enriched and df is not None else df


# --- daily import and full rebuild ----------------------------------------

class Read(NamedTuple):
    """Cleaned rows of the files of one layout."""

    segment: str
    files: list[str]
    rows: Cleaned


def clean_files(spark: SparkSession, paths) -> tuple[list[Read], list[dict]]:
    """Cleaned files by layout, each in the segment that its own headings tell, and the files that cannot be read."""
    # The JVM does not compile larger methods; cleaning in one generated method would stay interpreted.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    out, errors = [], []
    for x in S.read_layouts(spark, paths, errors):
        if KEY not in x.headings:
            errors += [{"file": p, "error": f"no {KEY} column in {x.headings}"} for p in x.files]
            continue
        stream = S.detect_stream(x.headings)
        out.append(Read(S.segment_of(stream), x.files, clean(x.rows, stream)))
    return out, errors


def _union(frames) -> DataFrame | None:
    frames = list(frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


PROCESSED = "path string, file_hash string, size long, modified long"


def read_processed(spark: SparkSession, root: str) -> DataFrame | None:
    if not list_names(spark, f"{root}/processed"):
        return None
    return spark.read.schema(PROCESSED).option("recursiveFileLookup", True).json(f"{root}/processed")


def _of_files(stamps: DataFrame, files) -> DataFrame:
    """Rows of the files that were read without error."""
    listed = local_table(stamps.sparkSession, "path string", [(S.plain_path(p),) for p in files])
    return stamps.join(listed, "path", "left_semi")


def import_new_daily(spark: SparkSession, data_root: str, root: str, dry_run: bool = True) -> dict:
    """Clean and import the files whose content has not been imported, one batch per segment.

    A file belongs to the segment that its headings tell, whatever folder it lies in. Files that cannot be read are
    listed under ``errors`` and stay unprocessed; the others are not held up by them.
    """
    summary: dict = {"files": {}, "errors": [], "import": {}}
    paths = [p for segment in SEGMENTS for p in S.discover(spark, data_root, segment)]
    if not paths:
        return summary
    fresh = stable(S.unprocessed(spark, paths, read_processed(spark, root)))
    found = {r["path"]: r for r in fresh.collect()}
    chosen = [p for p in paths if S.plain_path(p) in found]
    if not chosen:
        return summary
    reads, summary["errors"] = clean_files(spark, chosen)
    for segment in SEGMENTS:
        own = [r for r in reads if r.segment == segment]
        if not own:
            continue
        report = _union(r.rows.report for r in own)
        summary["files"][segment] = [r.asDict() for r in report.orderBy("file").collect()]
        if dry_run:
            continue
        files = [p for r in own for p in r.files]
        sources = [found[S.plain_path(p)] for p in files]
        batch_id = hashlib.sha256("".join(sorted(r["file_hash"] for r in sources)).encode()).hexdigest()[:16]
        summary["import"][segment] = append_batch(
            spark, root, _union(r.rows.rows for r in own), segment, batch_id,
            source_stamp=max((r["modified"] for r in sources if r["modified"] is not None), default=None))
        _of_files(fresh, files).write.mode("overwrite").json(f"{root}/processed/run={segment}-{batch_id}")
    return summary


def full_rebuild(spark: SparkSession, data_root: str, root: str, history=None, dry_run: bool = True) -> dict:
    """Rebuild both stores and the fact from every source; a dry run only counts.

    The set of processed files is replaced by the files that were read, so one that is put back later is imported.
    """
    out: dict = {"applied": False}
    paths = [p for s in SEGMENTS for p in S.discover(spark, data_root, s, (history or {}).get(s, ()))]
    reads, errors = clean_files(spark, paths) if paths else ([], [])
    hashed = S.file_hashes(spark, [p for r in reads for p in r.files]) if reads and not dry_run else None
    for segment in SEGMENTS:
        own = [r for r in reads if r.segment == segment]
        if not own:
            out[segment] = {"rows": 0, "errors": errors}
            continue
        marked = mark_at_import(_union(r.rows.rows for r in own))
        rows = _latest(marked.filter("reason IS NULL"))
        if dry_run:
            r = rows.agg(F.count(F.lit(1)).alias("rows"), F.min(TIME).alias("lo"), F.max(TIME).alias("hi")).first()
            out[segment] = {"rows": r["rows"], "date_min": str(r["lo"])[:10], "date_max": str(r["hi"])[:10],
                            "errors": errors}
            continue
        rows = rows.withColumn(MONTH, month_of(F.col(TIME)))
        batch_id = "rebuild-" + time.strftime("%Y%m%d%H%M%S")
        _quarantine(root, segment, batch_id, marked.filter("reason IS NOT NULL"))
        bad = spark.read.parquet(quarantine_folder(root, segment, batch_id)).count()
        entry = write_months(rows, store(root, segment), replace=True, extra={
            "batches": [], "source_stamp": _newest(hashed, [p for r in own for p in r.files])})
        out[segment] = {"rows": sum(entry["rows"].values()), "quarantined": bad, "errors": errors}
    if not dry_run:
        if hashed is not None:
            _of_files(hashed, [p for r in reads for p in r.files]).write.mode("overwrite").json(f"{root}/processed")
        K.refresh(spark, root, stores(root), KEY)
        publish(spark, root, full=True)
        out["applied"] = True
    return out


def _newest(hashed: DataFrame, files) -> int:
    return _of_files(hashed, files).agg(F.max("modified")).first()[0] or 0


def import_status(spark: SparkSession, root: str) -> DataFrame:
    """Rows and newest order per store, and whether the fact lags it."""
    fact = manifest(spark, f"{root}/fact") or {}
    parts = []
    for s in SEGMENTS:
        head = manifest(spark, store(root, s))
        df = read_months(spark, store(root, s), [TIME])
        if df is None:
            continue
        stale = fact.get("sources", {}).get(s) != head["version"]
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), F.max(TIME).alias("latest")).select(
            F.lit(s).alias("segment"), "rows", "latest", F.lit(stale).alias("fact_stale")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def source_freshness(spark: SparkSession, data_root: str, root: str, history=None) -> DataFrame:
    """Per segment whether its sources hold files newer than what its store was built from.

    (segment, files, newer, newest_source, store_stamp, stale): files of the segment's folders by their modification time
    against the newest one that the store's manifest names. One listing, and no file is read.
    """
    rows = []
    for s in SEGMENTS:
        paths = S.discover(spark, data_root, s, (history or {}).get(s, ()))
        head = manifest(spark, store(root, s)) or {}
        rows += [(s, p, modified, head.get("source_stamp", 0)) for p, (_, modified) in S.stamps(spark, paths).items()]
        rows += [] if paths else [(s, None, None, head.get("source_stamp", 0))]
    listed = local_table(spark, "segment string, path string, modified long, stamp long", rows)
    return listed.groupBy("segment").agg(
        F.count("path").alias("files"), F.count_if(F.col("modified") > F.col("stamp")).alias("newer"),
        F.timestamp_micros(F.max("modified")).alias("newest_source"),
        F.timestamp_micros(F.nullif(F.max("stamp"), F.lit(0))).alias("store_stamp")).withColumn("stale", F.col("newer") > 0)


def export_csv(df: DataFrame, path: str) -> None:
    """The filtered view as CSV with a header, written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)
