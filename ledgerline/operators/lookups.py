"""Point lookups, listings with counts, range scans, contributors of a score. Arguments are checked before anything is read."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a ticker and a slug look like.
TICKER = r"^[A-Z]{1,5}$"
SLUG = r"^[a-z][a-z0-9-]{0,80}$"
MOST, USUAL = 100, 50


def valid_ticker_text(text: str) -> bool:
    return re.search(TICKER, text) is not None


def valid_slug_text(text: str) -> bool:
    return re.search(SLUG, text) is not None


def page_of(limit: int | None = None, offset: int | None = None) -> tuple[int, int]:
    """(limit, offset) within bounds: 1 to 100 rows, 50 where none is asked for; no negative offset."""
    limit = USUAL if limit is None or limit < 1 else min(limit, MOST)
    return limit, max(0, offset or 0)


def time_range(since: dt.datetime, until: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """A range in order, of a year at most."""
    if until < since:
        raise ValueError("the range ends before it begins")
    if until - since > dt.timedelta(days=366):
        raise ValueError("the range is longer than a year")
    return since, until


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows with this key; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def list_persons_by(persons: DataFrame, totals: DataFrame | None = None, sort: str = "name", limit: int = USUAL, offset: int = 0, **equal: object) -> DataFrame:
    """Persons by tier, role, branch, state or party, with their totals (person_id, trades, tickers, volume). sort: name, or influence: volume, trades, tier, name."""
    chosen = filter_equal(persons, equal)
    if totals is not None:
        chosen = chosen.join(totals, "person_id", "left").na.fill(0, ["trades", "tickers", "volume"])
    order = [F.desc("volume"), F.desc("trades"), F.col("tier"), F.col("name")] if sort == "influence" else [F.col("name")]
    return chosen.orderBy(*order, "person_id").offset(offset).limit(limit)


def filter_equal(df: DataFrame, equal: dict[str, object]) -> DataFrame:
    """A column filter for each value that is given."""
    for key, value in equal.items():
        if value is not None:
            df = df.filter(F.col(key) == F.lit(value))
    return df


def person_totals(trades: DataFrame) -> DataFrame:
    """One aggregate of all persons, which stands for a subquery each."""
    return trades.groupBy("person_id").agg(F.count("*").alias("trades"), F.count_distinct("ticker").alias("tickers"), F.sum("est").alias("volume"))


def range_scan(df: DataFrame, at: str, since: str, until: str, *tie: str, **equal: object) -> DataFrame:
    """Rows from ``since`` to ``until``, both inclusive, oldest first; rows without a date aren't in any range."""
    inside = filter_equal(df, equal).filter(F.col(at).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
    return inside.orderBy(at, *tie)


def lobbying_records(records: DataFrame, companies: DataFrame, limit: int = USUAL) -> DataFrame:
    """Newest first, with amounts as text in whole dollars; the client's company if there is one."""
    amount = F.concat(F.lit("$"), F.format_number(F.expr("amount_cents div 100"), 0))
    return records.join(companies, "company_id", "left").withColumn("amount", amount).orderBy(F.desc("filed_at"), F.desc("id")).limit(limit)


def top_contributors(df: DataFrame, by: Column, category: str, label: Column, n: int = 5, at: str = "at", *tie: str) -> DataFrame:
    """The n largest rows of every ticker in a category of its score: ticker, category, rank, label, at, weight."""
    order = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("weight"), F.desc(at), *[F.col(t) for t in tie])
    rows = df.withColumn("weight", by.cast("double")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return rows.select("ticker", F.lit(category).alias("category"), "rank", label.cast("string").alias("label"), F.col(at).cast("timestamp").alias("at"), "weight")


def score_breakdown(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def unresolved_after(events: DataFrame, last_id: int, limit: int) -> DataFrame:
    """The next events without a company, by id: a page of a keyset."""
    return events.filter(F.col("company_id").isNull() & (F.col("id") > last_id)).orderBy("id").limit(limit)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def search_names(names: DataFrame, companies: DataFrame) -> DataFrame:
    """id and company_id: the company of the same name in any case, else of a name that begins with it or that it begins with; the shortest name wins, then the smallest id.

    Names meet by their first word, so that a prefix is compared only with names that share it. A name of less than a word, as the beginning of another name's first word,
    meets by that word's beginnings of the same length.
    """
    word = lambda c: F.regexp_extract(c, r"^\S+", 0)
    mine = names.select("id", F.lower(F.trim("name")).alias("n")).filter("n <> ''")
    own = companies.select(F.col("id").alias("company_id"), F.lower(F.trim("name")).alias("c"), F.length("name").alias("length")).filter("c <> ''")
    lengths = F.sequence(F.lit(1), F.length(word("c")))
    whole = mine.withColumn("k", word("n")).join(own.withColumn("k", F.explode(F.transform(lengths, lambda i: F.substring(word("c"), F.lit(1), i)))), "k")
    back = mine.withColumn("k", F.explode(F.transform(F.sequence(F.lit(1), F.length(word("n"))), lambda i: F.substring(word("n"), F.lit(1), i)))).join(own.withColumn("k", word("c")), "k")
    pairs = whole.select("id", "n", "c", "company_id", "length").unionByName(back.select("id", "n", "c", "company_id", "length"))
    rank = F.when(F.col("n") == F.col("c"), 0).when(F.col("c").startswith(F.col("n")) | F.col("n").startswith(F.col("c")), 1)
    best = pairs.withColumn("rank", rank).filter("rank is not null").groupBy("id").agg(F.min(F.struct("rank", "length", "company_id")).alias("hit"))
    return best.select("id", F.col("hit.company_id").alias("company_id"))
