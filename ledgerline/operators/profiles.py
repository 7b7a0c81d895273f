"""Parts of profiles in bulk: all persons in one plan, where an application would ask for one at a time. Also the activity strip and labelled networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import standard_sector
from .signals import latencies
from .trades import count_if, is_buy, is_sell


def summaries(trades: DataFrame, late_days: int = 45) -> DataFrame:
    """person_id with counts, estimated volumes, first and last trade, median latency in whole days and the share of late filings."""
    def volume(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("est")).otherwise(0))

    own = trades.groupBy("person_id").agg(
        F.count("*").alias("trades"), F.count_distinct("ticker").alias("tickers"), count_if(is_buy()).alias("buys"), count_if(is_sell()).alias("sells"),
        F.sum("est").alias("volume"), volume(is_buy()).alias("bought"), volume(is_sell()).alias("sold"), F.min("traded_at").alias("first_trade"), F.max("traded_at").alias("last_trade"),
    )
    late = latencies(trades).groupBy("person_id").agg(
        F.floor(F.percentile("days", 0.5) + 0.5).cast("long").alias("median_days"), F.round(count_if(F.col("days") > late_days) / F.count("*"), 6).alias("late_pct")
    )
    return own.join(late, "person_id", "left")


def biggest_trades(trades: DataFrame) -> DataFrame:
    """The largest trade of each person with an estimate over 0; of several the latest, then by ticker, order and line. No sort: one row a person is combined before the shuffle."""
    rows = trades.filter("traded_at is not null and est > 0")
    last = F.struct("est", "traded_at", "ticker", "trade_type", "order_id", "line")
    best = rows.groupBy("person_id").agg(F.max(last).alias("x"))
    return best.select("person_id", "x.ticker", "x.trade_type", "x.est", "x.traded_at")


def solo_top(trades: DataFrame, ticker: str = "ticker", top: int = 10) -> DataFrame:
    """The tickers that only one person ever traded, the person's largest first."""
    per = trades.filter(F.col(ticker).isNotNull() & F.col("person_id").isNotNull()).groupBy(ticker).agg(
        F.min("person_id").alias("person_id"), F.max("person_id").alias("other"), F.count("*").alias("trades"), F.sum("est").alias("volume"), count_if(is_buy()).alias("buys"), count_if(is_sell()).alias("sells")
    )
    place = Window.partitionBy("person_id").orderBy(F.desc("volume"), F.desc("trades"), ticker)
    own = per.filter("person_id = other").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return own.select("person_id", "rank", ticker, "trades", "volume", "buys", "sells")


def party_history(trades: DataFrame) -> DataFrame:
    """The spans in which a person's trades were filed under one party: person_id, party, since, until, trades. A span ends where the party changes; changes are found in days, so that a
    person's many trades of a day are one row when they are sorted."""
    days = trades.filter("person_id is not null and traded_at is not null").groupBy("person_id", F.to_date("traded_at").alias("day"), "party").agg(F.count("*").alias("n"))
    order = Window.partitionBy("person_id").orderBy("day", "party")
    new = (~F.col("party").eqNullSafe(F.lag("party").over(order)) | F.lag("day").over(order).isNull()).cast("int")
    spans = days.withColumn("new", new).withColumn("span", F.sum("new").over(order))
    return spans.groupBy("person_id", "span").agg(F.first("party").alias("party"), F.min("day").alias("since"), F.max("day").alias("until"), F.sum("n").alias("trades"))


def activity_strip(events: DataFrame, scores: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """One row: events of the last day and week before ``as_of``, companies with a score, and companies. Events: ts, event_type."""
    now = F.lit(as_of).cast("timestamp")
    recent = events.filter(F.col("ts") >= now - F.expr("INTERVAL 7 DAYS")).filter(F.col("ts") < now)
    counts = recent.agg(count_if(F.col("ts") >= now - F.expr("INTERVAL 1 DAY")).alias("events_day"), F.count("*").alias("events_week"))
    scored = scores.agg(F.count_distinct("ticker").alias("companies_scored"))
    whole = companies.agg(F.count_distinct("ticker").alias("companies"))
    one = [df.withColumn("__k", F.lit(1)) for df in (counts, scored, whole)]  # a row each
    return one[0].join(one[1], "__k").join(one[2], "__k").drop("__k")


def activity_categories(events: DataFrame, as_of: str, hours: int = 24, top: int = 20) -> DataFrame:
    """The most frequent kinds of events of the last hours."""
    now = F.lit(as_of).cast("timestamp")
    own = events.filter((F.col("ts") >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") < now))
    return own.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(top)


def label(name: Column, party: Column) -> Column:
    return F.when(F.coalesce(party, F.lit("")) != "", F.concat(name, F.lit(" ("), party, F.lit(")"))).otherwise(name)


def labelled_network(pairs: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (person_id, label, slug) and edges (a, b, relationship, label_a, label_b) of pairs of co-traders (a, b, shared; smaller id first)."""
    named = persons.select("person_id", label(F.col("name"), F.col("party")).alias("label"), "slug")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("person_id")).distinct()
    edges = pairs.select("a", "b", F.concat(F.lit("co_trader:"), "shared").alias("relationship"))
    for end in "ab":
        edges = edges.join(named.select(F.col("person_id").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    return named.join(ids, "person_id", "left_semi"), edges.select("a", "b", "relationship", "label_a", "label_b")


def backfilled_sectors(companies: DataFrame, records: DataFrame) -> DataFrame:
    """Companies (ticker, sector, subsector) with what records (ticker, sector, industry, place) know: of a ticker's records the first by ``place`` that has a sector, and the first that has an
    industry. Sectors become standard ones; without an industry the record's own sector is the subsector. Tickers without records stay as they are."""
    def filled(name: str) -> Column:
        return F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit(""))

    own = records.select(F.upper(F.trim("ticker")).alias("ticker"), filled("sector").alias("s"), filled("industry").alias("i"), "place").filter("ticker not in ('', '--') and (s is not null or i is not null)")
    first = own.groupBy("ticker").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in "si"])
    found = first.select("ticker", F.nullif(standard_sector(F.col("s")), F.lit("")).alias("__sector"), F.coalesce("i", "s").alias("__sub"), F.lit(True).alias("__found"))
    both = companies.join(found, "ticker", "left")
    kept = {"sector": F.when(F.col("__found"), F.col("__sector")).otherwise(F.col("sector")), "subsector": F.coalesce("__sub", "subsector")}
    return both.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in companies.columns])
