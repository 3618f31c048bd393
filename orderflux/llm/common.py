"""Shared pieces of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux.session import ensure_checkpoint_dir, stable  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not hold yet."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Store ``df`` as Parquet in the shared checkpoint folder and read it back; also the folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`written` made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def connected(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``edges`` (a, b): rows (node, root).

    Alternating large-star and small-star steps (Kiveris et al., 2014). A step is an aggregate by node and one
    join on it, the number of steps is logarithmic in the number of nodes, and nothing but a count reaches the driver.
    Nodes must not be null; loops and repeated edges do no harm; no edges give no rows.
    """
    def linked(e):
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, before = stable(linked(edges)), None
    while True:
        # Large star: every larger neighbour of a node is tied to the smallest of its neighbourhood.
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        large = stable(linked(large))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stable(linked(small.union(least)))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(
        now.select("b", "b").distinct())
