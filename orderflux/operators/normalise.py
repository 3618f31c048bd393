"""From source headings to the canonical fact columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflux.functions import expressions as E
from orderflux.functions import values as V
from orderflux.functions.dimensions import add_region, translate_country

_AMOUNTS = ("sales", "sales_paid", "sales_listed", "settlement_price", "coupon_amount")
_FLAGS = ("coupon_used", "new_user_promo", "badge_product")
_TIMES = ("order_time", "register_time")


def canonical_name(heading: str) -> str:
    key = heading.lower().replace(" ", "_")
    return V.CANONICAL_NAMES.get(key, key)


def rename_columns(df: DataFrame) -> DataFrame:
    """Canonical names; when two headings share a target, the first column stays."""
    chosen: dict[str, str] = {}
    for heading in df.columns:
        chosen.setdefault(canonical_name(heading), heading)
    return df.select(*[F.col(f"`{h}`").alias(name) for name, h in chosen.items()])


def resolve_sales(df: DataFrame) -> DataFrame:
    """sales = paid, else listed. The choice precedes number parsing, so unreadable paid text gives NULL."""
    paid, listed = "sales_paid" in df.columns, "sales_listed" in df.columns
    if paid and listed:
        return df.withColumn("sales", F.coalesce("sales_paid", "sales_listed"))
    if paid:
        return df.withColumn("sales", F.col("sales_paid"))
    return df.withColumn("sales", F.col("sales_listed")) if listed else df


def type_columns(df: DataFrame) -> DataFrame:
    """Timestamps and amounts typed, everything else text."""
    typed = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in _TIMES:
            typed[name] = c if kind.startswith("timestamp") else E.parse_timestamp(c)
        elif name in _AMOUNTS:
            typed[name] = c.try_cast("double")
        elif name.startswith("_") or kind in ("string", "boolean"):
            continue
        else:
            typed[name] = c.cast("string")
    return df.withColumns(typed) if typed else df


def normalise(df: DataFrame) -> DataFrame:
    """Rename, resolve sales, type, translate the market."""
    out = type_columns(resolve_sales(rename_columns(df)))
    return translate_country(out) if "country" in out.columns else out


def enrich(df: DataFrame) -> DataFrame:
    """Country scrub, region, operator fill, flags and status group on a normalised fact."""
    have = set(df.columns)
    if "country" in have:
        df = add_region(df.withColumn("country", E.scrub_country(F.col("country"))))
    blank = F.lit(None).cast("string")
    parts = [F.col(c) if c in have else blank for c in ("operator", "brand", "product")]
    df = df.withColumn("operator", E.operator_from_brand(*parts))
    flags = {f: E.to_flag(F.col(f)) for f in _FLAGS if f in have and dict(df.dtypes)[f] == "string"}
    if "order_status" in have:
        flags["status_group"] = E.status_group(F.col("order_status"))
    return df.withColumns(flags) if flags else df
