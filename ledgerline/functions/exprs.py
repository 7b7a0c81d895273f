"""Column expressions that several operators share. All run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000

#: Endings of company names, taken off once each, in this order.
NAME_ENDINGS = (
    " incorporated", " inc.", " inc", " corporation", " corp.", " corp", " limited", " ltd.", " ltd", " company", " co.", " co",
    " holdings", " holding", " group", " plc", " se", " sa", " nv", " l.l.c.", " llc", " l.p.", " lp",
    " class a", " class b", " class c", ",", ".", " ",
)

#: Source sectors and the standard ones they stand for.
SECTORS = {
    "Technology": "Information Technology", "Telecommunications": "Communication Services", "Health Care": "Health Care",
    "Finance": "Financials", "Energy": "Energy", "Real Estate": "Real Estate", "Utilities": "Utilities", "Public Utilities": "Utilities",
    "Basic Materials": "Materials", "Basic Industries": "Materials", "Industrials": "Industrials", "Capital Goods": "Industrials",
    "Transportation": "Industrials", "Consumer Discretionary": "Consumer Discretionary", "Consumer Services": "Consumer Discretionary",
    "Consumer Durables": "Consumer Discretionary", "Consumer Staples": "Consumer Staples", "Consumer Non-Durables": "Consumer Staples",
    "Miscellaneous": "Other",
}


def midpoint(low: Column, high: Column) -> Column:
    """The dollar estimate of a range: its middle, or the side that is known, or 0."""
    both = F.floor((low + high) / 2).cast("long")
    return F.coalesce(both, low, high, F.lit(0)).cast("long")


def valid_ticker(ticker: Column) -> Column:
    return ticker.isNotNull() & ~ticker.isin("", "--", "N/A", "OT")


def sane_date(at: Column) -> Column:
    return (at >= F.lit("2000-01-01").cast("timestamp")) & (at < F.lit("2100-01-01").cast("timestamp"))


def trade_kind(raw: Column) -> Column:
    """purchase, sale_full, sale_partial, exchange, or null, from the spellings that sources use."""
    text = F.lower(F.trim(raw))
    return (
        F.when(text.isin("purchase", "buy", "p"), "purchase")
        .when(text.startswith("sale") & text.contains("partial") | (text == "s (partial)"), "sale_partial")
        .when(text.startswith("sale") | text.isin("sell", "s"), "sale_full")
        .when(text.isin("exchange", "e"), "exchange")
    )


def week_of(at: Column) -> Column:
    """The Monday of the ISO week."""
    return F.date_trunc("week", at).cast("date")


def days_between(later: Column, earlier: Column) -> Column:
    """Days with their fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(float(DAY_MICROS))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ladder(x: Column, steps: Sequence[tuple[float, float]], above: float) -> Column:
    """The value of the first step whose bound is not exceeded, else ``above``."""
    out = None
    for bound, value in steps:
        out = F.when(x <= bound, float(value)) if out is None else out.when(x <= bound, float(value))
    return out.otherwise(float(above))


def format_dollars(x: Column) -> Column:
    x = x.cast("double")
    return (
        F.when(x >= 1e6, F.format_string("%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("%.0fK", x / 1e3)).otherwise(F.format_string("%.0f", x))
    )


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def normalize_name(name: Column) -> Column:
    """A company's name for matching: lower case, without a state suffix and without legal endings."""
    out = F.regexp_replace(F.lower(F.trim(name)), r"^(.+)/.{0,3}$", "$1")
    out = F.trim(out)
    for ending in NAME_ENDINGS:
        plain = "".join("\\" + c if c in ".," else c for c in ending)
        out = F.regexp_replace(out, f"{plain}$", "")
    return F.trim(out)


def standard_sector(raw: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SECTORS.items() for x in pair])
    return F.when(F.coalesce(raw, F.lit("")) == "", "").otherwise(F.coalesce(F.try_element_at(known, raw), F.lit("Other")))


def id_text(*parts: Column) -> Column:
    """What the id of an event is the hash of."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def source_id(*parts: Column) -> Column:
    """The deterministic id of an event."""
    return hashed(id_text(*parts))


def parse_time(text: Column) -> Column:
    """A timestamp from any of the layouts that sources use; null if none fits."""
    shapes = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MMM dd, yyyy")
    plain = F.regexp_replace(text, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d).*$", "$1")
    every = F.coalesce(*[F.try_to_timestamp(text, F.lit(s)) for s in shapes], F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss")))
    # a shape that doesn't fit costs an exception, so the common one is told by its look: no other shape fits it
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d\z"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).otherwise(every)


def amount_range(text: Column) -> tuple[Column, Column]:
    """(low, high) of a text such as ``$1,001 - $15,000``."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([\d,]+)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("long"))
    return F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
