"""Incremental file ingestion with Structured Streaming.

Each micro-batch runs the same import as a daily batch. Its id comes from the files it holds, so a batch that is
delivered again after a failure changes nothing, also when the checkpoint is lost. Late rows are restatements
and win whenever they arrive, so there is no watermark here.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux.plans.imports import SEGMENTS, append_batch, clean_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_folder(spark: SparkSession, folder: str, root: str, checkpoint: str, name: str = "stream",
                  max_files: int = 100):
    """Import the files of a watched folder that have not been seen, then stop.

    The stream carries the names of new files, not their bytes. Each micro-batch reads its files as the daily import
    does: by their own encoding, separator and headings, and into the segment these tell. Files that cannot be
    read are listed in ``root``/errors. What each batch changes in the counts of the exception digest is kept under
    ``root``/digest, so that the digest follows restatements without reading the stores.
    """
    source = (spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files).load(folder)
              .select("path", F.unix_micros("modificationTime").alias("modified")))

    def load(batch: DataFrame, _: int) -> None:
        held = [tuple(r) for r in batch.orderBy("modified", "path").collect()]       # at most max_files
        if not held:
            return
        session = batch.sparkSession
        batch_id = hashlib.sha256(repr(sorted(held)).encode()).hexdigest()[:16]
        reads, errors = clean_files(session, [path for path, _ in held])
        for segment in SEGMENTS:
            own = [r.rows for r in reads if r.segment == segment]
            if own:
                append_batch(session, root, _union(r.rows for r in own), segment, f"{name}-{batch_id}",
                             source_stamp=max(modified for _, modified in held), digest=True)
        if errors:
            rows = session.createDataFrame([(e["file"], e["error"]) for e in errors], "file string, error string")
            rows.write.mode("overwrite").json(f"{root}/errors/run={name}-{batch_id}")

    query = (source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def _union(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_open_days(closed: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of the days a stream has closed, and of those still open from the events; ``open`` tells them apart."""
    last = closed.select(F.max("day")).scalar()
    day = F.col("ts").cast("timestamp").cast("date")
    still = daily_event_counts(events.where(F.coalesce(day > last, F.lit(True))))
    return closed.withColumn("open", F.lit(False)).unionByName(still.withColumn("open", F.lit(True)))


def daily_event_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per day and type; on a stream the state of a day is dropped ``delay`` after it."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("ts", delay)
    return stamped.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(
        F.col("w.start").cast("date").alias("day"), "event_type", "events", "value")
