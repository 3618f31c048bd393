"""Small dimension tables as DataFrames.

Each is a local relation whose size Spark knows, so Catalyst broadcasts it on its own;
no join below carries a broadcast hint.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux.functions import values as V
from orderflux.functions.expressions import strip_ws

_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}


def local_table(spark: SparkSession, schema: str, rows) -> DataFrame:
    """A local relation from rows; ``schema`` is like ``"iso string, rate double"``."""
    fields = [f.split() for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), type=_ARROW[t]) for c, (_, t) in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[n for n, _ in fields]))


@lru_cache(maxsize=1)
def _region_by_market() -> dict[str, str]:
    return {market: region for region, markets in V.REGION_MARKETS.items() for market in markets}


@lru_cache(maxsize=4)
def _locale_rows(spark: SparkSession) -> tuple:
    """(iso2, iso3, english, chinese) of every country the JDK's locale data knows."""
    locale = spark._jvm.java.util.Locale
    rows = []
    for iso2 in locale.getISOCountries():
        entry = locale("", iso2)
        english = V.ENGLISH_BY_ISO2.get(iso2, entry.getDisplayCountry(locale.ENGLISH))
        rows.append((iso2, entry.getISO3Country(), english,
                     entry.getDisplayCountry(locale.SIMPLIFIED_CHINESE)))
    return tuple(rows)


def country_names(spark: SparkSession) -> DataFrame:
    """name_cn -> name_en for the known markets, aliases included."""
    known = _region_by_market()
    pairs = {cn: en for _, _, en, cn in _locale_rows(spark) if en in known}
    pairs.update(V.CHINESE_ALIASES)
    return local_table(spark, "name_cn string, name_en string", list(pairs.items()))


def regions(spark: SparkSession) -> DataFrame:
    return local_table(spark, "market string, region string", list(_region_by_market().items()))


def iso3_codes(spark: SparkSession) -> DataFrame:
    known = _region_by_market()
    rows = [(en, i3) for _, i3, en, _ in _locale_rows(spark) if en in known]
    return local_table(spark, "market string, iso3 string", rows)


def iso2_to_iso3(spark: SparkSession) -> DataFrame:
    return local_table(spark, "iso2 string, iso3 string",
                       [(i2, i3) for i2, i3, _, _ in _locale_rows(spark)])


def calling_codes(spark: SparkSession) -> DataFrame:
    return local_table(spark, "code long, destination string", list(V.CALLING_CODES.items()))


def category_classes(spark: SparkSession) -> DataFrame:
    rows = [(raw, cls, V.LABELS_EN.get(cls, cls), V.LABELS_EN.get(raw, raw))
            for cls, raws in V.CATEGORY_CLASSES.items() for raw in raws]
    return local_table(
        spark, "raw_category string, category_class string, class_en string, raw_en string", rows)


def fx_snapshot(spark: SparkSession) -> DataFrame:
    """country, symbol, iso, rate – the indicative rates."""
    return local_table(spark, "country string, symbol string, iso string, rate double", V.SNAPSHOT_RATES)


# --- lookups ---------------------------------------------------------------

def _lookup(df: DataFrame, dim: DataFrame, key: Column, dim_key: str, outputs: dict[str, str]):
    """Left join on a computed key; ``outputs`` maps dimension column -> new column."""
    renamed = dim.select(F.col(dim_key).alias("_key"),
                         *[F.col(c).alias(f"_{out}") for c, out in outputs.items()])
    return df.withColumn("_lookup", key).join(renamed, F.col("_lookup") == F.col("_key"), "left")


def translate_country(df: DataFrame, column: str = "country") -> DataFrame:
    """Chinese market name to English; anything unknown stays as it is."""
    joined = _lookup(df, country_names(df.sparkSession), strip_ws(F.col(column)),
                     "name_cn", {"name_en": "en"})
    return joined.withColumn(column, F.coalesce("_en", column)).drop("_lookup", "_key", "_en")


def add_region(df: DataFrame, column: str = "country", out: str = "region") -> DataFrame:
    joined = _lookup(df, regions(df.sparkSession), strip_ws(F.col(column)),
                     "market", {"region": "r"})
    return joined.withColumn(out, F.coalesce("_r", F.lit("Other"))).drop("_lookup", "_key", "_r")


def add_iso3(df: DataFrame, column: str = "country", out: str = "iso3") -> DataFrame:
    joined = _lookup(df, iso3_codes(df.sparkSession), strip_ws(F.col(column)),
                     "market", {"iso3": "i"})
    return joined.withColumn(out, F.col("_i")).drop("_lookup", "_key", "_i")


def add_iso3_from_iso2(df: DataFrame, column: str = "iso2", out: str = "iso3") -> DataFrame:
    joined = _lookup(df, iso2_to_iso3(df.sparkSession), F.upper(strip_ws(F.col(column))),
                     "iso2", {"iso3": "i"})
    return joined.withColumn(out, F.col("_i")).drop("_lookup", "_key", "_i")


def add_destination(df: DataFrame, column: str = "area_code", out: str = "destination"):
    """Calling code to destination; unmapped code gives ``+code``, non-number 'Unknown'."""
    number = F.expr(f"try_cast(trim({column}) as double)").try_cast("bigint")
    joined = _lookup(df, calling_codes(df.sparkSession), number, "code", {"destination": "d"})
    unmapped = F.concat(F.lit("+"), F.col("_lookup").cast("string"))
    return (joined.withColumn(out, F.coalesce("_d", unmapped, F.lit("Unknown")))
            .drop("_lookup", "_key", "_d"))


def add_category_class(df: DataFrame, column: str = "product_category",
                       out: str = "category_class", default: str | None = V.UNMAPPED_CLASS,
                       label: str | None = None) -> DataFrame:
    """Business class of a raw category. ``default=None`` leaves unmapped rows NULL."""
    joined = _lookup(df, category_classes(df.sparkSession), strip_ws(F.col(column)),
                     "raw_category", {"category_class": "c", "class_en": "l"})
    joined = joined.withColumn(out, F.coalesce("_c", F.lit(default)) if default else F.col("_c"))
    if label:
        joined = joined.withColumn(label, F.coalesce("_l", out))
    return joined.drop("_lookup", "_key", "_c", "_l")
