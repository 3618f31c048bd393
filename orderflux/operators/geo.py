"""IP geography and cross-border comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflux.functions import values as V
from orderflux.functions.dimensions import local_table
from orderflux.functions.expressions import ip_halves, network_of
from orderflux.functions.measures import mark_unique, unique_orders

GEO_FIELDS = ("iso2", "country", "subdivision", "city", "lat", "lon")


def networks_of(ranges: DataFrame) -> DataFrame:
    """(_length, _network, _geo) of a table of networks: ``network`` as text (``2001:db8::/32``, ``10.0.0.0/8``), or
    ``start_ip`` and ``prefix`` of IPv4 networks. Lengths are of 128 bits; networks that cannot be read are left out."""
    if "network" in ranges.columns:
        parts = F.split("network", "/")
        halves, given = ip_halves(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)).try_cast("int")
        dotted = ~F.get(parts, F.lit(0)).contains(":")
    else:
        halves, given = ip_halves(F.concat_ws(".", *[
            F.call_function("shiftright", F.col("start_ip").cast("bigint"), F.lit(k)).bitwiseAND(F.lit(255)) for k in (24, 16, 8, 0)])), (
            F.col("prefix").cast("int"))
        dotted = F.lit(True)
    length = F.coalesce(given, F.when(dotted, 32).otherwise(128)) + F.when(dotted, 96).otherwise(0)
    rows = ranges.select(halves.alias("_halves"), length.alias("_length"), F.struct(*GEO_FIELDS).alias("_geo")).where(
        F.col("_halves").isNotNull() & F.col("_length").between(0, 128))
    return rows.select("_length", network_of(F.col("_halves"), F.col("_length")).alias("_network"), "_geo")


def locate_ips(df: DataFrame, ranges: DataFrame, column: str = "ip_address",
               out: str = "geo") -> DataFrame:
    """Add a struct of the most specific network that holds the address, IPv4 or IPv6; NULL when none does.

    ``ranges`` holds networks, see :func:`networks_of`. Each distinct address is resolved once and meets each prefix length
    that occurs at most once by an equi join on (length, network), so an address yields no more than 129 candidates whatever
    the table holds.
    """
    networks = networks_of(ranges)
    lengths = [r[0] for r in networks.select("_length").distinct().collect()]      # at most 129
    if not lengths:
        kinds = dict(ranges.dtypes)
        empty = F.lit(None).cast("struct<" + ",".join(f"{f}:{kinds[f]}" for f in GEO_FIELDS) + ">")
        return df.withColumn(out, empty)
    addresses = df.select(F.col(column).alias("_ip")).distinct().withColumn("_halves", ip_halves(F.col("_ip"))).filter(
        "_halves IS NOT NULL")
    probes = addresses.withColumn("_length", F.explode(F.array(*[F.lit(int(n)) for n in lengths])))
    probes = probes.withColumn("_network", network_of(F.col("_halves"), F.col("_length")))
    best = probes.join(networks, ["_length", "_network"]).groupBy("_ip").agg(F.max_by("_geo", "_length").alias(out))
    # Rows without an address get keys of their own, else they would meet in one task.
    own = F.concat(F.lit("?"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096)).cast("string"))
    keyed = df.withColumn("_key", F.coalesce(F.col(column), own))
    joined = keyed.join(best, F.col("_key") == F.col("_ip"), "left").drop("_ip", "_key")
    return mark_unique(joined) if unique_orders(df) else joined


def same_market(df: DataFrame, market: str = "country", destination: str = "destination",
                out: str = "same_market") -> DataFrame:
    """True when billing market and destination agree, by containment or by alias."""
    aliases = local_table(df.sparkSession, "_market string, _alias string",
                          list(V.DESTINATION_ALIASES.items()))
    joined = df.join(aliases, F.col(market) == F.col("_market"), "left")        # one alias a market
    m, d = F.lower(F.trim(market)), F.lower(F.trim(destination))
    agree = (d.contains(m) | m.contains(d)
             | F.coalesce(F.lower(F.col("_alias")) == d, F.lit(False)))
    joined = joined.withColumn(out, agree).drop("_market", "_alias")
    return mark_unique(joined) if unique_orders(df) else joined


def ip_mismatch(ip_country: Column, market: Column) -> Column:
    """IP country differs from the market; NULL when either is unknown."""
    return ip_country != market
