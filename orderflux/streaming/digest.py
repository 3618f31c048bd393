"""Exception digest for a scheduled run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux import config
from orderflux.functions import expressions as E
from orderflux.functions.expressions import ratio
from orderflux.functions.measures import orders
from orderflux.session import stable


DELTAS = "operator string, day date, rows long, orders long, refunded long, gap long"


def _refunded() -> Column:
    return E.status_group(F.col("order_status")) == "Refunded"


def _missing() -> Column:
    return E.is_successful() & E.usable_supplier_id(F.col("interface_order_id")).isNull()


def exception_digest(df: DataFrame, today: Column, refund_rate: float = config.DIGEST_REFUND_RATE,
                     routing_gap: int = config.DIGEST_ROUTING_GAP,
                     age_days: int = config.DIGEST_DATA_AGE_DAYS) -> DataFrame:
    """Refund rate per operator, routing gap per operator and data age, where beyond the limit.

    All statuses; one aggregation per operator serves the first two signals and the age.
    """
    per = df.groupBy("operator").agg(
        orders(df).alias("orders"), orders(df, _refunded()).alias("refunded"),
        orders(df, _missing()).alias("gap"), F.max("order_time").alias("latest"))
    return _signals(per, today, refund_rate, routing_gap, age_days)


def _signals(per: DataFrame, today: Column, refund_rate: float, routing_gap: int, age_days: int) -> DataFrame:
    per = stable(per)
    named = per.filter("operator IS NOT NULL")
    refunds = named.select(F.lit("refund rate").alias("signal"), F.col("operator").alias("subject"),
                           ratio(F.col("refunded"), F.col("orders")).alias("value"),
                           F.lit(float(refund_rate)).alias("limit"))
    gaps = named.select(F.lit("routing gap"), "operator", F.col("gap").cast("double"),
                        F.lit(float(routing_gap)))
    age = per.agg(F.max("latest").alias("latest")).select(
        F.lit("data age"), F.lit("fact"), F.datediff(today, F.to_date("latest")).cast("double"),
        F.lit(float(age_days)))
    return refunds.union(gaps).union(age).filter(F.col("value") > F.col("limit"))


def digest_deltas(withdrawn: DataFrame | None, added: DataFrame) -> DataFrame:
    """What a batch changes in the digest's counts, per operator and day (see ``DELTAS``).

    ``withdrawn`` are the stored rows of the orders that arrive again, ``added`` the arriving rows, both normalised: a
    restated order leaves its old operator, day and status and enters the new ones.
    """
    parts = []
    for rows, sign in ((withdrawn, -1), (added, 1)):
        if rows is None:
            continue
        have = set(rows.columns)
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("operator", "interface_order_id", "order_status")
                                 if c not in have})
        counted = F.when(F.col("order_id").isNotNull(), sign).otherwise(0)
        parts.append(rows.select(
            "operator", F.to_date("order_time").alias("day"), F.lit(sign).cast("long").alias("rows"),
            counted.cast("long").alias("orders"), F.when(_refunded(), counted).otherwise(0).cast("long").alias("refunded"),
            F.when(_missing(), counted).otherwise(0).cast("long").alias("gap")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sums = ("rows", "orders", "refunded", "gap")
    return every.groupBy("operator", "day").agg(*[F.sum(c).alias(c) for c in sums]).where(
        " OR ".join(f"{c} <> 0" for c in sums))


def streamed_digest(spark: SparkSession, root: str, today: Column, refund_rate: float = config.DIGEST_REFUND_RATE,
                    routing_gap: int = config.DIGEST_ROUTING_GAP, age_days: int = config.DIGEST_DATA_AGE_DAYS) -> DataFrame:
    """The digest from the deltas that the imported batches have left under ``root``, the stores unread.

    It equals :func:`exception_digest` of the stores' rows however late restatements come.
    """
    deltas = spark.read.schema(DELTAS).option("recursiveFileLookup", True).parquet(f"{root}/digest")
    days = deltas.groupBy("operator", "day").agg(*[F.sum(c).alias(c) for c in ("rows", "orders", "refunded", "gap")])
    per = days.groupBy("operator").agg(*[F.sum(c).alias(c) for c in ("orders", "refunded", "gap")],
                                       F.max(F.when(F.col("rows") > 0, F.col("day"))).alias("latest"))
    return _signals(per, today, refund_rate, routing_gap, age_days)
