"""Session helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "orderflux") -> SparkSession:
    """A session for tests and the benchmark. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session that runs in one local process gets a temporary one, which goes when the process ends;
    on a cluster that is an error, because executors would not share it.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orderflux-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def together(calls: list[Callable], at_once: int = 8) -> list:
    """Results of independent calls in their order, ``at_once`` of them side by side in driver threads.

    For model fits: one is a chain of short jobs on a small training set, which leaves most cores idle.
    Calls with many short jobs belong first in the list, since new jobs queue behind older ones for cores.
    """
    if not calls:
        return []
    with ThreadPoolExecutor(min(at_once, len(calls))) as pool:
        waiting = [pool.submit(inheritable_thread_target(call)) for call in calls]
        return [w.result() for w in waiting]


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an aggregate that two branches read.

    Sums of doubles may differ in the last bit between two runs; both branches must see one value.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
