"""Row-local column expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflux import config
from orderflux.functions import values as V


# All characters that count as whitespace at the ends of a text, not only the blank.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c: Column) -> Column:
    """Strip all leading and trailing whitespace; SQL ``trim`` alone leaves a TAB in place."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_id(c: Column) -> Column:
    """Identifier text: stripped; blank, 'nan' and 'none' become NULL."""
    s = strip_ws(c.cast("string"))
    return F.when(~F.lower(s).isin("", "nan", "none"), s)


def normalise_user_id(c: Column) -> Column:
    """Identifier text without the trailing ``.0`` a spreadsheet adds."""
    return F.regexp_replace(clean_id(c), r"\.0$", "")


def to_number(c: Column) -> Column:
    """Number from text with thousands commas; anything else is NULL."""
    return strip_ws(F.replace(c.cast("string"), F.lit(","), F.lit(""))).try_cast("double")


def to_flag(c: Column) -> Column:
    s = strip_ws(c.cast("string"))
    return F.when(s == "是", True).when(s == "否", False)


_YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
_YEAR_LAST = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})(?!\d)"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?!\d)"
#: Two-digit years: 69 to 99 lie in the last century.
_LAST_CENTURY = r"^(\d{1,2})[-/](\d{1,2})[-/](69|[7-9]\d)(?!\d)"
_SHORT_YEAR = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2})(?!\d)"
_NAMED_MONTH = r"^(\d{1,2})[- ]([A-Za-z]{3})[A-Za-z]*[-, ]+(\d{4}|\d{2})(?!\d)"
_HALF_DAY = r" ?([AaPp])[Mm]$"
#: Months as exports abbreviate them.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_EITHER = "~"


def _named(s: Column) -> Column:
    """Dates with a named month, year first."""
    day, name, year = (F.regexp_extract(s, _NAMED_MONTH, k) for k in (1, 2, 3))
    century = F.when(F.length(year) == 4, "").when(year >= "69", "19").otherwise("20")
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(name))
    arranged = F.concat(century, F.concat_ws("-", year, month.cast("string"), day), F.regexp_replace(s, _NAMED_MONTH, ""))
    return F.when(s.rlike(_NAMED_MONTH), arranged).otherwise(s)


def date_text(c: Column) -> Column:
    """Date text in year-month-day order, NULL for blank text and 'nan'.

    A ``~`` stands before dates whose day and month could be either way round, with the month first. Each layout is one
    replacement that leaves all other text alone, so the expression stays small.
    """
    s = strip_ws(c.cast("string"))
    s = _named(F.when((s != "") & (F.lower(s) != "nan"), s))
    for layout, arranged in ((_YEAR_FIRST, "$1-$2-$3"), (_COMPACT, "$1-$2-$3"), (_YEAR_LAST, "~$3-$1-$2"),
                             (_LAST_CENTURY, "~19$3-$1-$2"), (_SHORT_YEAR, "~20$3-$1-$2")):
        s = F.regexp_replace(s, layout, arranged)
    return s


def chosen_order(text: Column, day_first: Column) -> Column:
    """The one reading of :func:`date_text`; without a date in it, NULL."""
    either = text.startswith(_EITHER)
    swapped = F.regexp_replace(text, r"^~(\d+)-(\d+)-(\d+)", "$1-$3-$2")
    return F.when(either & day_first, swapped).when(either, F.substr(text, F.lit(2))).otherwise(text)


def time_of(text: Column) -> Column:
    """Timestamp of a text from :func:`chosen_order`; NULL when no known layout fits."""
    plain = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?!\d)"), text)
    bare = F.regexp_replace(plain, _HALF_DAY, "").try_cast("timestamp_ntz")
    shift = F.when(text.rlike("[Pp][Mm]$"), 12).otherwise(0) - F.when(F.hour(bare) == 12, 12).otherwise(0)
    half = F.when(plain.rlike(r"\d:\d{2} ?[AaPp][Mm]$") & F.hour(bare).between(1, 12),
                  (bare + F.make_dt_interval(F.lit(0), shift)).cast("timestamp"))
    return F.when(text.rlike("[AaPp][Mm]$"), half).otherwise(plain.try_cast("timestamp"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_timestamp(c: Column, day_first: bool = False) -> Column:
    """Timestamp from text; NULL when no known layout fits.

    Year-first text and named months are never ambiguous; otherwise the month comes first, or the day with ``day_first``.
    The cleaner takes the three steps in columns of their own, which is faster on whole files.
    """
    return _bound(date_text(c), lambda text: _bound(chosen_order(text, F.lit(day_first)), time_of))


def status_group(c: Column) -> Column:
    """Successful / Refunded / Cancelled / Pending; NULL for an unknown status."""
    s = strip_ws(c)
    out = None
    for name, raw in V.STATUS_GROUPS.items():
        out = F.when(s.isin(raw), name) if out is None else out.when(s.isin(raw), name)
    return out


def is_successful() -> Column:
    return F.col("order_status").isin(V.STATUS_GROUPS["Successful"])


def usable_supplier_id(c: Column) -> Column:
    s = strip_ws(c)
    return F.when(~F.lower(s).isin("", "--", "-", "nan"), s)


def scrub_country(c: Column, junk=config.COUNTRY_JUNK) -> Column:
    """NULL for stray timestamps and application names."""
    bad = c.rlike(r"^\s*\d{4}-\d\d-\d\d") | F.lower(strip_ws(c)).isin(list(junk))
    return F.when(~bad, c)


def operator_from_brand(operator: Column, brand: Column, product: Column) -> Column:
    """Operator, else brand, else the product name without its marketing suffix."""
    stripped = strip_ws(F.regexp_replace(product, V.PRODUCT_SUFFIX_PATTERN, ""))
    return F.coalesce(*[F.when(strip_ws(c) != "", strip_ws(c)) for c in (operator, brand, stripped)])


def _volume(text: Column) -> Column:
    """Megabytes named in one text, NULL when it names none."""
    t = F.translate(text, "，．（）", ",.()")

    def amount(unit: str) -> Column:
        return F.regexp_extract(t, rf"(?i)(\d+(?:\.\d+)?)\s*{unit}", 1).try_cast("double")

    return (F.when(text.rlike(V.UNLIMITED_PATTERN), F.lit(float(config.UNLIMITED_MB)))
            .otherwise(F.coalesce(amount("TB") * (1024.0 * 1024.0), amount("GB") * 1024.0,
                                  amount("MB"), amount("G(?![A-Za-z])") * 1024.0)))


def package_mb(sku: Column, product: Column) -> Column:
    """Data volume of a package in MB: from the SKU, else from the product name."""
    return F.coalesce(_volume(sku), _volume(product))


def package_label(mb: Column) -> Column:
    gb = mb / 1024.0
    text = F.when(mb >= 1024.0, F.concat(F.regexp_replace(gb.cast("string"), r"\.0$", ""), F.lit("GB")))
    small = F.concat(F.regexp_replace(mb.cast("string"), r"\.0$", ""), F.lit("MB"))
    return F.when(mb >= float(config.UNLIMITED_MB), "Unlimited").otherwise(F.coalesce(text, small))


def bands(c: Column, edges, unit: str = "") -> Column:
    """Label of the half-open band ``[edge, next edge)`` that holds the value."""
    out = F.when(c < edges[0], f"<{edges[0]}{unit}")
    for low, high in zip(edges, edges[1:]):
        out = out.when(c < high, f"{low}-{high}{unit}")
    return out.when(c.isNotNull(), f">={edges[-1]}{unit}")


def is_data_category(c: Column) -> Column:
    return c.rlike(V.DATA_CATEGORY_PATTERN)


def is_airtime_category(c: Column) -> Column:
    return c.rlike(V.AIRTIME_CATEGORY_PATTERN)


def denomination_label(sku: Column, denomination: Column) -> Column:
    number = to_number(denomination)
    formatted = F.regexp_replace(F.format_string("%.2f", number), r"\.?0+$", "")
    return F.coalesce(F.when(strip_ws(sku) != "", strip_ws(sku)),
                      F.when(number.isNotNull(), formatted))


def ipv4_to_long(c: Column) -> Column:
    """Unsigned value of a dotted IPv4 address; NULL when it is not one."""
    s = strip_ws(c)
    octets = F.transform(F.split(s, r"\."), lambda o: F.when(F.length(o) <= 3, o.try_cast("bigint")))
    valid = s.rlike(r"^\d+\.\d+\.\d+\.\d+$") & F.forall(octets, lambda o: F.coalesce(o <= 255, F.lit(False)))
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    return F.when(valid, value)


def month(c: Column) -> Column:
    return F.trunc(c, "month")


def month_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero or missing denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def ip_halves(c: Column) -> Column:
    """The two 64-bit halves (hi, lo) of an IPv6 or IPv4 address; NULL for any other text.

    IPv4 addresses lie in ``::ffff:0:0/96``, as they are written inside IPv6.
    """
    s = F.lower(strip_ws(c.cast("string")))
    v4 = ipv4_to_long(F.regexp_extract(s, r"([0-9.]+)$", 1))
    digits = F.lpad(F.lower(F.hex(v4)), 8, "0")
    # A trailing dotted part becomes two groups; a dotted address alone stands behind ::ffff:.
    front = F.regexp_replace(s, r"[0-9.]+$", "")
    dotted = F.when(v4.isNotNull() & ((front == "") | front.endswith(":")), F.concat(
        F.when(front == "", "::ffff:").otherwise(front), F.left(digits, F.lit(4)), F.lit(":"), F.right(digits, F.lit(4))))
    text = F.when(s.contains("."), dotted).otherwise(F.when(s.contains(":"), s))
    return _bound(text, _halves_of)


def _halves_of(text: Column) -> Column:
    halves = F.split(text, "::", -1)

    def groups(k: int) -> Column:
        part = F.get(halves, F.lit(k))
        return F.when(part.isNull() | (part == ""), F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))

    def joined(left: Column, right: Column) -> Column:
        missing = 8 - F.size(left) - F.size(right)
        whole = F.when(F.size(halves) == 1, missing == 0).otherwise((F.size(halves) == 2) & (missing > 0))
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        return F.when(whole & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
                      F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    digits = joined(groups(0), groups(1))
    return _bound(digits, lambda d: F.when(d.isNotNull(), F.struct(
        F.conv(F.left(d, F.lit(16)), 16, -10).cast("bigint").alias("hi"),
        F.conv(F.right(d, F.lit(16)), 16, -10).cast("bigint").alias("lo"))))


def network_of(halves: Column, length: Column) -> Column:
    """The first ``length`` of 128 bits of an address, as (hi, lo) of what is left of them."""
    def top(half: Column, bits: Column) -> Column:
        return F.when(bits <= 0, F.lit(0).cast("bigint")).otherwise(
            F.call_function("shiftrightunsigned", half, (F.lit(64) - bits).cast("int")))

    return F.struct(top(halves["hi"], F.least(length, F.lit(64))).alias("hi"), top(halves["lo"], length - 64).alias("lo"))
