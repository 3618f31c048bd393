"""Keep-last de-duplication, upsert, counters, restatements, fingerprints and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflux import config
from orderflux.functions import values as V
from orderflux.functions.expressions import parse_timestamp

KEY = "订单号"


def keep_last(df: DataFrame, key: str, order_by, collapse_nulls: bool = config.NULL_KEYS_COLLAPSE, columns=None):
    """The row with the greatest ``order_by`` per key, of ``columns`` or all; ``order_by`` is a total order of the rows.

    An aggregate, not a window: rows of a hot key are reduced before the shuffle. Rows without a key are kept
    unless ``collapse_nulls``: each is a group of its own by its position, so they spread over all tasks.
    """
    order = F.struct(*order_by)
    groups = [F.col(key).alias("_key")]
    if not collapse_nulls:
        groups.append(F.when(F.col(key).isNull(), order).alias("_place"))
    row = F.struct(*[F.col(f"`{c}`") for c in (columns or df.columns)])
    return df.groupBy(*groups).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def upsert(existing: DataFrame | None, incoming: DataFrame, key: str = KEY) -> DataFrame:
    """Existing rows whose key does not arrive again, plus the incoming rows (unique by key).

    The incoming side wins and columns are united. Only keys of the incoming side meet the existing rows,
    and the anti join leaves rows without a key in place.
    """
    if existing is None:
        return incoming
    arriving = incoming.select(F.col(key)).filter(F.col(key).isNotNull())
    return existing.join(arriving, key, "left_anti").select(*existing.columns).unionByName(
        incoming, allowMissingColumns=True)


def merge_counts(existing: DataFrame | None, incoming: DataFrame, key: str = KEY) -> DataFrame:
    """rows, added, duplicates and distinct_new of a batch.

    Into an empty store distinct rows are added (rows without a key count as one). Otherwise ``added``
    counts incoming rows with a new key, repeats included, and all else is a duplicate.
    """
    if existing is None:
        out = incoming.agg(
            F.count(F.lit(1)).alias("rows"),
            (F.count_distinct(key) + F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))).alias("added"),
            F.count_distinct(key).alias("distinct_new"))
    else:
        known = existing.select(F.col(key)).filter(F.col(key).isNotNull()).withColumn("_known", F.lit(1))
        per_key = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        fresh = F.col("_known").isNull() & F.col(key).isNotNull()
        out = per_key.join(known, key, "left").agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(fresh, F.col("_n"))), F.lit(0)).alias("added"),
            F.count_if(fresh).alias("distinct_new"))
    return out.withColumn("duplicates", F.col("rows") - F.col("added"))


def restatements(existing: DataFrame, incoming: DataFrame, key: str = KEY,
                 watch=("订单状态", "实际支付")) -> DataFrame:
    """Orders whose watched value changes: order_id, field, old, new – one row per order.

    Both sides are unique by key. The first differing field counts; typed values are compared.
    """
    fields = [c for c in watch if c in existing.columns and c in incoming.columns]
    old = existing.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("order_id"), *[F.col(c).alias(f"_old_{c}") for c in fields])
    new = incoming.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("order_id"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = old.join(new, "order_id")
    change = None
    for c in fields:
        differs = ~F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
        entry = F.struct(F.lit(c).alias("field"), F.col(f"_old_{c}").cast("string").alias("old"),
                         F.col(f"_new_{c}").cast("string").alias("new"))
        change = F.when(differs, entry) if change is None else change.when(differs, entry)
    return both.withColumn("_c", change).filter("_c IS NOT NULL").select("order_id", "_c.*")


def restatement_summary(changes: DataFrame, samples: int = config.RESTATEMENT_SAMPLES) -> DataFrame:
    """Count of restated orders and the first samples by key as an array of structs."""
    first = changes.orderBy("order_id").limit(samples)
    listed = first.agg(F.sort_array(F.collect_list(F.struct("order_id", "field", "old", "new")))).scalar()
    return changes.agg(F.count(F.lit(1)).alias("restated")).withColumn("restatement_samples", listed)


def row_number_of(columns) -> Column:
    """A row's content as a number: 60 bits of the MD5 of its texts, NULL and blank alike."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("decimal(38,0)")


def fingerprint_of(columns, rows: Column, total: Column) -> Column:
    """Sixteen digits from the names of the columns, the number of rows and the sum of :func:`row_number_of`."""
    return F.left(F.sha2(F.concat_ws("|", F.lit(",".join(columns)), rows, F.coalesce(total, F.lit(0))), 256), F.lit(16))


def content_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if not c.startswith("_") and c != "reason")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint of a batch."""
    columns = content_columns(df)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_number_of(columns)).alias("s")).select(
        fingerprint_of(columns, F.col("n"), F.col("s")).alias("file_hash"))


def known_headings() -> set[str]:
    return {h.lower().replace(" ", "_") for h in V.CANONICAL_NAMES} | set(V.PASSTHROUGH_COLUMNS)


def validate(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """(one row with the date range, unknown columns, missing required columns)."""
    t = time_column(df)
    return df.agg(F.min(t).alias("date_min"), F.max(t).alias("date_max")), *checked_headings(df)


def time_column(df: DataFrame) -> Column:
    """The order time, NULL where there is no such column."""
    when = next((c for c in ("订单时间", "order_time") if c in df.columns), None)
    if when is None:
        return F.lit(None).cast("timestamp")
    return F.col(when) if dict(df.dtypes)[when].startswith("timestamp") else parse_timestamp(F.col(when))


def checked_headings(df: DataFrame) -> tuple[list[str], list[str]]:
    """Unknown columns and missing required ones."""
    names = [c for c in df.columns if not c.startswith("_") and c != "reason"]
    unknown = sorted(c for c in names if c.strip().lower().replace(" ", "_") not in known_headings())
    return unknown, [c for c in (KEY, "订单时间") if c not in names]


def coverage(df: DataFrame) -> DataFrame:
    """Share of non-null values per column, from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("filled"))
                      for c in df.columns])
    return counts.select("_rows", F.explode(pairs).alias("p")).select(
        "p.column", "p.filled", (F.col("p.filled") / F.nullif("_rows", F.lit(0))).alias("coverage"))


def reconcile(stores: dict[str, DataFrame], fact: DataFrame, segment: Column | None = None) -> DataFrame:
    """Rows per segment in the stores and in the fact, and their difference."""
    counts = None
    for name, df in stores.items():
        one = df.agg(F.count(F.lit(1)).alias("store_rows")).select(F.lit(name).alias("segment"), "store_rows")
        counts = one if counts is None else counts.unionByName(one)
    in_fact = fact.groupBy((segment if segment is not None else F.col("segment")).alias("segment")).agg(
        F.count(F.lit(1)).alias("fact_rows"))
    return counts.join(in_fact, "segment", "full_outer").withColumn(
        "difference", F.coalesce("store_rows", F.lit(0)) - F.coalesce("fact_rows", F.lit(0)))


def freshness(df: DataFrame, today: Column, time: str = "order_time", *by: str) -> DataFrame:
    """Rows, newest order and age in days with its colour."""
    age = F.datediff(today, F.to_date("latest"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.max(time).alias("latest")).withColumn(
        "age_days", age).withColumn(
        "colour", F.when(F.col("age_days") >= config.FRESH_RED_DAYS, "red")
        .when(F.col("age_days") >= config.FRESH_AMBER_DAYS, "amber").otherwise("green"))
