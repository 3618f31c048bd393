"""Cleaning of raw exports: headings, dates, numbers, quarantine, fills, trim and report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflux.functions import expressions as E
from orderflux.functions import values as V

FILE = "_file"
DAY_FIRST_THRESHOLD = 0.2


class Cleaned(NamedTuple):
    """``rows`` holds good and quarantined ones, with ``reason`` for the latter; the other two are its parts."""

    good: DataFrame
    quarantined: DataFrame
    report: DataFrame
    rows: DataFrame


def standard_names(headings, stream: str) -> dict[str, str]:
    """The headings that get another name, with it."""
    names = dict(V.UPPERCASE_HEADINGS)
    if stream == "master_rm":
        names.update(V.LOCAL_CURRENCY_HEADINGS)
    return {c: names.get(c.strip(), c.strip()) for c in headings if names.get(c.strip(), c.strip()) != c}


def rename_headings(df: DataFrame, stream: str) -> DataFrame:
    """Trimmed headings on the standard names of the stream."""
    return df.withColumnsRenamed(standard_names(df.columns, stream))


def day_first_choice(df: DataFrame, columns) -> DataFrame:
    """Per file, whether each date column is read day-first, from the date texts in ``_t_<column>``.

    The month-first reading stays unless more than a fifth of all rows hold text it cannot read; then
    the reading that parses strictly more rows wins.
    """
    counts = []
    for c in columns:
        text = F.col(f"_t_{c}")
        default, swapped = (E.time_of(E.chosen_order(text, F.lit(d))) for d in (False, True))
        counts += [F.count_if(text.isNotNull() & default.isNull()).alias(f"_bad_{c}"),
                   F.count(default).alias(f"_a_{c}"), F.count(swapped).alias(f"_b_{c}")]
    stats = df.groupBy(F.col(FILE).alias("_f")).agg(F.count(F.lit(1)).alias("_rows"), *counts)
    return stats.select("_f", *[
        ((F.col(f"_bad_{c}") / F.col("_rows") > DAY_FIRST_THRESHOLD)
         & (F.col(f"_b_{c}") > F.col(f"_a_{c}"))).alias(f"_df_{c}") for c in columns])


def parse_dates(df: DataFrame, columns) -> DataFrame:
    """Timestamps by the choice of each file; the choice stays in ``_df_<column>``, the text in ``_t_<column>``.

    Steps of their own, so that each text is arranged once and only the chosen reading is parsed.
    """
    df = df.withColumns({f"_t_{c}": E.date_text(F.col(f"`{c}`")) for c in columns})
    # One row per file, whose size Spark cannot know: a join by shuffle would put all rows of a file into one task.
    choice = F.broadcast(day_first_choice(df, columns))
    df = df.join(choice, F.col(FILE) == F.col("_f"), "left").drop("_f")
    df = df.withColumns({f"_t_{c}": E.chosen_order(F.col(f"_t_{c}"), F.col(f"_df_{c}")) for c in columns})
    return df.withColumns({c: E.time_of(F.col(f"_t_{c}")) for c in columns})


def _is_bad(columns) -> Column:
    """Negative paid or listed amount, or no order time; zero and NULL amounts are fine."""
    bad = F.lit(False)
    for c in ("实际支付", "售价"):
        if c in columns:
            bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    if "订单时间" in columns:
        bad = bad | F.col("订单时间").isNull()
    return bad


def _reason(columns) -> Column:
    negative = [F.coalesce(F.col(c) < 0, F.lit(False)) for c in ("实际支付", "售价") if c in columns]
    out = None
    for c in negative:
        out = F.when(c, "negative amount") if out is None else out.when(c, "negative amount")
    return out.otherwise("order time missing") if out is not None else F.lit("order time missing")


def clean(df: DataFrame, stream: str) -> Cleaned:
    """Clean the rows of one stream; a file column ``_file`` keeps files apart."""
    if FILE not in df.columns:
        df = df.withColumn(FILE, F.lit("batch"))
    renamed = standard_names(df.columns, stream)
    df = rename_headings(df, stream)
    dates = [c for c in V.DATE_COLUMNS if c in df.columns]
    numbers = [c for c in V.NUMBER_COLUMNS if c in df.columns]
    ids = [c for c in V.ID_COLUMNS if c in df.columns]
    df = df.withColumns({c: E.clean_id(F.col(f"`{c}`")) for c in ids}) if ids else df
    df = parse_dates(df, dates) if dates else df
    df = df.withColumns({f"_x_{c}": F.col(f"`{c}`") for c in numbers}).withColumns(
        {c: E.to_number(F.col(f"`{c}`")) for c in numbers}) if numbers else df
    df = df.withColumn("_bad", _is_bad(df.columns))

    fills = {}
    for group, value in ((V.FILL_ZERO, 0.0), (V.FILL_BLANK, ""), (V.FILL_UNKNOWN, "Unknown")):
        fills.update({c: value for c in group if c in df.columns})
    report = _report(df, dates, numbers, fills, renamed)
    helpers = ["_bad", *[f"_{k}_{c}" for k in ("df", "t") for c in dates], *[f"_x_{c}" for c in numbers]]
    rows = df.withColumn("reason", F.when(F.col("_bad"), _reason(df.columns))).drop(*helpers)
    kept = F.col("reason").isNull()
    texts = [n for n, t in rows.dtypes if t == "string" and not n.startswith("_") and n not in ids and n != "reason"]
    tidy = {c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in fills.items()}
    tidy |= {c: E.strip_ws(tidy.get(c, F.col(f"`{c}`"))) for c in texts}
    rows = rows.withColumns({c: F.when(kept, v).otherwise(F.col(f"`{c}`")) for c, v in tidy.items()}) if tidy else rows
    return Cleaned(rows.filter(kept).drop("reason"), rows.filter(~kept), report, rows)


def _report(df: DataFrame, dates, numbers, fills, renamed) -> DataFrame:
    """One row per file: rows in and out, quarantined, date ranges, ambiguity, fills, renamed headings and values lost.

    ``renamed`` maps the headings that got another name, ``coerced`` lists the columns that became dates or numbers, and
    ``<column>_unreadable`` counts the texts among them that are neither.
    """
    kept = ~F.col("_bad")
    aggregates = [F.count(F.lit(1)).alias("rows_in"), F.count_if(kept).alias("rows_out"),
                  F.count_if(F.col("_bad")).alias("quarantined")]
    for c in dates:
        aggregates += [
            F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
            F.first(f"_df_{c}").alias(f"{c}_day_first"),
            F.coalesce(F.bool_and(F.dayofmonth(c) <= 12), F.lit(False)).alias(f"{c}_ambiguous"),
            F.count_if(F.col(f"_t_{c}").isNotNull() & F.col(c).isNull()).alias(f"{c}_unreadable")]
    for c in numbers:
        text = E.clean_id(F.col(f"_x_{c}"))
        aggregates.append(F.count_if(text.isNotNull() & F.col(f"`{c}`").isNull()).alias(f"{c}_unreadable"))
    aggregates += [F.count_if(kept & F.col(f"`{c}`").isNull()).alias(f"{c}_filled") for c in fills]
    names = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair]) if renamed else F.create_map().cast(
        "map<string,string>")
    return df.groupBy(F.col(FILE).alias("file")).agg(*aggregates).withColumns(
        {"renamed": names, "coerced": F.array(*map(F.lit, [*dates, *numbers])).cast("array<string>")})


def mark_at_import(df: DataFrame) -> DataFrame:
    """``df`` with the ``reason`` why a row is not imported: that of the cleaner, if it has turned the row away, else the first
    present of paid and listed below zero, or no readable order time. NULL for the others."""
    pay = next((c for c in ("实际支付", "售价") if c in df.columns), None)
    when = next((c for c in ("订单时间", "order_time") if c in df.columns), None)
    reason = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
    if pay:
        reason = F.when(F.coalesce(F.col(pay).try_cast("double") < 0, F.lit(False)) & reason.isNull(), "negative amount").otherwise(
            reason)
    if when:
        t = F.col(when)
        t = t if dict(df.dtypes)[when].startswith("timestamp") else E.parse_timestamp(t)
        reason = F.coalesce(reason, F.when(t.isNull(), "order time missing"))
    return df.withColumn("reason", reason)


def split_at_import(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are imported, and those that are not with their ``reason``."""
    marked = mark_at_import(df)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")
