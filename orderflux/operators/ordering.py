"""Ranks, running totals, top-k and exact medians that hold for skewed groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflux import config
from orderflux.functions.expressions import ratio
from orderflux.session import stable


def value_bucket(value: Column, resolution: int = 256) -> Column:
    """Order-preserving bucket: ``resolution`` buckets per doubling of the magnitude."""
    return F.floor(F.signum(value) * F.log2(F.abs(value) + 1.0) * resolution)


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which NULL keys meet; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(df: DataFrame, value: str, keys=(), rank: str = "rank",
                   cumulative: str = "cumulative", weight: str | None = None,
                   resolution: int = 256, more: dict[str, str] | None = None) -> DataFrame:
    """Rank and running total by ``value`` descending, within ``keys``; ties share both, NULLs come last.

    ``more`` maps further output columns to the columns they accumulate.

    Equal values are first merged, then value buckets are summed on their own and offset by the
    totals before them, so no task holds a whole group.
    """
    keys = list(keys)
    sums = {cumulative: weight or value, **(more or {})}
    rows = stable(df)
    by_value = (rows.groupBy(*keys, value)
                .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
                .withColumn("_b", value_bucket(F.col(value), resolution)))
    earlier = (Window.partitionBy(*keys).orderBy(F.desc("_b"))
               .rowsBetween(Window.unboundedPreceding, -1))
    totals = by_value.groupBy(*keys, "_b").agg(
        F.sum("_n").alias("_n"), *[F.sum(f"_s_{o}").alias(f"_s_{o}") for o in sums])
    offsets = totals.select(
        *keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *[F.sum(f"_s_{o}").over(earlier).alias(f"_0_{o}") for o in sums])
    inside = (Window.partitionBy(*keys, "_b").orderBy(F.desc(value))
              .rowsBetween(Window.unboundedPreceding, 0))
    ranked = (by_value.withColumn("_cn", F.sum("_n").over(inside))
              .withColumns({f"_c_{o}": F.sum(f"_s_{o}").over(inside) for o in sums}))
    ranked = (null_safe_join(ranked, offsets, [*keys, "_b"])
              .select(*keys, value,
                      (F.col("_n0") + F.col("_cn") - F.col("_n") + 1).alias(rank),
                      *[F.coalesce(F.col(f"_0_{o}") + F.col(f"_c_{o}"), f"_0_{o}", f"_c_{o}").alias(o) for o in sums]))
    return null_safe_join(rows, ranked, [*keys, value])


def pareto(df: DataFrame, measure: str, keys=()) -> DataFrame:
    """Rank, share and cumulative share of aggregated rows."""
    out = running_totals(df, measure, keys)
    if keys:
        totals = out.groupBy(*keys).agg(F.sum(measure).alias("_total"))
        out = null_safe_join(out, totals, list(keys))
    else:
        out = out.withColumn("_total", out.select(F.sum(measure)).scalar())
    return (out.withColumn("share", ratio(F.col(measure), F.col("_total")))
            .withColumn("cumulative_share", ratio(F.col("cumulative"), F.col("_total")))
            .drop("_total", "cumulative"))


def top_per_group(df: DataFrame, groups, measure: str, ties, n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group. Spark cuts each partition to ``n`` before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(F.desc(measure), *ties)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def keep_top_members(df: DataFrame, member: str, n: int, measure: str = "sales") -> DataFrame:
    """Rows whose member is among the ``n`` largest by the summed measure."""
    best = (df.groupBy(member).agg(F.sum(measure).alias("_m"))
            .filter(F.col(member).isNotNull())
            .orderBy(F.desc("_m"), member).limit(n).select(member))
    return df.join(best, member, "left_semi")


def last_periods(df: DataFrame, period: str, n: int) -> DataFrame:
    """Rows of the ``n`` latest distinct periods."""
    latest = df.select(period).distinct().orderBy(F.desc(period)).limit(n)
    return df.join(latest, period, "left_semi")


#: Parts into which a bucket of middle values is split.
PARTS = 64


def _middle(rows: DataFrame, keys, bucket: str) -> DataFrame:
    """The buckets (keys, bucket) of ``rows`` (with ``_bn`` values each) that hold a middle position, with ``_before``.

    ``_low`` and ``_high`` are the positions among all values, ``_start`` the number of values before the first bucket.
    """
    w = Window.partitionBy(*keys).orderBy(bucket)
    upto = F.col("_start") + F.sum("_bn").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_bn"))
    hit = [(F.col(p) > F.col("_before")) & (F.col(p) <= F.col("_upto")) for p in ("_low", "_high")]
    return rows.where((hit[0] | hit[1]) & (F.col("_bn") > 0)).drop("_upto", "_start", "_bn")


def refined(placed: DataFrame, keys, value: str, most: int) -> DataFrame:
    """``placed`` (keys, ``_b``, value, _n, _before, _low, _high) cut down to buckets of at most ``most`` values.

    A bucket of more is split at approximate quantiles of its values, which follow any distribution, and only the parts
    that hold a middle position stay. Each round leaves about one in ``PARTS`` values, so rounds are few; a sketch, a histogram
    of ``PARTS`` rows and joins with them are all that a round shuffles.
    """
    while True:
        largest = placed.groupBy(*keys, "_b").count().agg(F.max("count")).first()[0]
        if largest is None or largest <= most:
            return placed
        cuts = F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)], 100 * PARTS)
        splits = placed.groupBy(*keys, "_b").agg(cuts.alias("_cuts"))
        parts = null_safe_join(placed, splits, [*keys, "_b"]).withColumn(
            "_c", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")
        parts = stable(parts)
        hist = parts.groupBy(*keys, "_b", "_c").agg(F.sum("_n").alias("_bn"), *[
            F.min(c).alias(c) for c in ("_low", "_high")], F.min("_before").alias("_start"))
        kept = _middle(hist, [*keys, "_b"], "_c").select(*keys, "_b", "_c", F.col("_before").alias("_from"))
        placed = stable(null_safe_join(parts, kept, [*keys, "_b", "_c"]).withColumns(
            {"_before": F.col("_from"), "_b": F.concat_ws(".", F.col("_b").cast("string"), "_c")}).drop("_c", "_from"))


def exact_median(df: DataFrame, keys, value: str, out: str = "median", resolution: int = 256,
                 sums: dict[str, str] | None = None, most: int = config.MEDIAN_VALUES) -> DataFrame:
    """Exact median per key (mean of the two middle values) with bounded tasks; ``rows`` and sums beside it.

    Equal values are merged first, with the sums of other columns that ``sums`` names, and stored once. A histogram over
    value buckets finds the bucket of each middle position; buckets of over ``most`` values are split again until none is
    larger (see :func:`refined`), and only those are ordered. NULL values count as
    rows and in the sums but not in the median; NULL keys are keys.
    """
    keys, sums = list(keys), sums or {}
    by_value = stable(df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(o) for o, c in sums.items()])
        .withColumn("_b", value_bucket(F.col(value), resolution)))
    seen = F.when(F.col("_b").isNotNull(), F.col("_n"))
    total = F.sum("_bn").over(Window.partitionBy(*keys))
    hist = stable(by_value.groupBy(*keys, "_b").agg(
        F.coalesce(F.sum(seen), F.lit(0)).alias("_bn"), F.sum("_n").alias("_rows"), *[F.sum(o).alias(o) for o in sums])
        .withColumns({"_low": F.floor((total + 1) / 2), "_high": F.floor((total + 2) / 2), "_start": F.lit(0)}))
    middle = _middle(hist.select(*keys, "_b", "_bn", "_low", "_high", "_start"), keys, "_b")
    placed = null_safe_join(by_value.drop(*sums), middle, [*keys, "_b"])
    placed = refined(stable(placed), keys, value, most)
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = (placed.withColumn("_to", F.col("_before") + F.sum("_n").over(inside))
              .withColumn("_from", F.col("_to") - F.col("_n")))

    def at(position: str) -> Column:
        hit = (F.col(position) > F.col("_from")) & (F.col(position) <= F.col("_to"))
        return F.max(F.when(hit, F.col(value)))

    medians = placed.groupBy(*keys).agg(((at("_low") + at("_high")) / 2.0).alias(out))
    whole = hist.groupBy(*keys).agg(F.sum("_rows").alias("rows"), *[F.sum(o).alias(o) for o in sums])
    return null_safe_join(whole, medians, keys, "left")
