"""Aggregates over trades: tickers, persons, heatmaps, listings, drill-downs. Every ordered limit ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_buy() -> Column:
    return F.col("trade_type") == "purchase"


def is_sell() -> Column:
    return F.col("trade_type").startswith("sale")


def count_if(x: Column) -> Column:
    return F.count(F.when(x, 1))


def distinct_if(x: Column, what: str) -> Column:
    return F.count_distinct(F.when(x, F.col(what)))


def top_tickers(trades: DataFrame, limit: int = 50) -> DataFrame:
    return (
        trades.groupBy("ticker")
        .agg(
            F.count("*").alias("trades"), F.count_distinct("person_id").alias("reps"), count_if(is_buy()).alias("buys"), count_if(is_sell()).alias("sells"),
            distinct_if(F.col("party") == "R", "person_id").alias("r_count"), distinct_if(F.col("party") == "D", "person_id").alias("d_count"),
            F.sum("est").alias("volume"), F.min("traded_at").alias("first_trade"), F.max("traded_at").alias("last_trade"),
        )
        .orderBy(F.desc("reps"), F.desc("trades"), "ticker")
        .limit(limit)
    )


def ticker_persons(trades: DataFrame) -> DataFrame:
    """For every ticker its persons: trades, buys, sells, volume, last trade."""
    return trades.groupBy("ticker", "person_id", "name", "party").agg(
        F.count("*").alias("trades"), count_if(is_buy()).alias("buys"), count_if(is_sell()).alias("sells"), F.sum("est").alias("volume"), F.max("traded_at").alias("last_trade")
    )


def list_persons(trades: DataFrame, persons: DataFrame, party: str | None = None, limit: int = 50) -> DataFrame:
    """Persons by influence: volume, then trades, then name. One aggregate, joined back."""
    totals = trades.groupBy("person_id").agg(F.count("*").alias("trades"), F.count_distinct("ticker").alias("tickers"), F.sum("est").alias("volume"))
    chosen = persons if party is None else persons.filter(F.col("party") == party)
    out = chosen.join(totals, "person_id", "left").na.fill(0, ["trades", "tickers", "volume"])
    return out.select("person_id", "name", "party", "state", "trades", "tickers", "volume").orderBy(F.desc("volume"), F.desc("trades"), "name").limit(limit)


def person_headline(trades: DataFrame) -> DataFrame:
    """For every person: totals, concentration over tickers (Herfindahl), largest share, biggest trade."""
    per = trades.groupBy("person_id", "ticker").agg(F.sum("est").alias("v"), F.count("*").alias("n"), F.max(F.struct("est", "traded_at", "ticker", "order_id", "line")).alias("big"))
    whole = per.withColumn("whole", F.sum("v").over(Window.partitionBy("person_id")))
    share = F.col("v") / F.col("whole")
    return whole.groupBy("person_id").agg(
        F.sum("n").alias("trades"), F.count("*").alias("tickers"), F.sum("v").alias("volume"), F.round(F.sum(share * share), 6).alias("hhi"), F.round(F.max(share), 6).alias("top_share"),
        F.max("big")["est"].alias("biggest"),
    )


def person_top_tickers(trades: DataFrame, top: int = 10) -> DataFrame:
    per = trades.groupBy("person_id", "ticker").agg(F.count("*").alias("trades"), F.sum("est").alias("volume"))
    window = Window.partitionBy("person_id").orderBy(F.desc("volume"), "ticker")
    return per.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)


def solo_tickers(trades: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Tickers that one person alone trades."""
    alone = trades.groupBy(ticker).agg(F.count_distinct("person_id").alias("reps"), F.min("person_id").alias("person_id"), F.count("*").alias("trades"))
    return alone.filter("reps = 1").select(ticker, "person_id", "trades")


def net_flow(trades: DataFrame) -> DataFrame:
    month = F.date_format("traded_at", "yyyy-MM").alias("month")
    buys, sells = F.sum(F.when(is_buy(), F.col("est")).otherwise(0)), F.sum(F.when(is_sell(), F.col("est")).otherwise(0))
    return trades.groupBy("person_id", month).agg(buys.alias("bought"), sells.alias("sold"), (buys - sells).alias("net"))


def owner_split(trades: DataFrame, owner: Column) -> DataFrame:
    known = F.when(owner.isNull() | owner.isin("", "--"), "unspecified").otherwise(owner)
    return trades.groupBy(known.alias("owner")).agg(F.count("*").alias("trades"), F.sum("est").alias("volume"))


def heat_day_month(trades: DataFrame) -> DataFrame:
    return trades.groupBy((F.dayofweek("traded_at") - 1).alias("dow"), F.month("traded_at").alias("month")).agg(F.count("*").alias("trades"), F.sum("est").alias("volume"))


def heat_party_sector(trades: DataFrame) -> DataFrame:
    party = F.when(F.coalesce("party", F.lit("")) == "", "?").otherwise(F.col("party")).alias("party")
    return trades.groupBy(party, "sector").agg(F.count("*").alias("trades"), count_if(is_buy()).alias("buys"), count_if(is_sell()).alias("sells"), F.sum("est").alias("volume"))


def _top(trades: DataFrame, key: str, n: int) -> DataFrame:
    return trades.groupBy(key).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), key).limit(n).select(key)


def heat_person_month(trades: DataFrame, top: int = 15) -> DataFrame:
    chosen = trades.join(F.broadcast(_top(trades, "person_id", top)), "person_id", "left_semi")  # at most ``top`` rows
    return chosen.groupBy("person_id", "name", F.date_format("traded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("trades"))


def heat_person_ticker(trades: DataFrame, persons: int = 15, tickers: int = 10) -> DataFrame:
    people, names = _top(trades, "person_id", persons), _top(trades, "ticker", tickers)
    chosen = trades.join(F.broadcast(people), "person_id", "left_semi").join(F.broadcast(names), "ticker", "left_semi")
    return chosen.groupBy("person_id", "ticker").agg(F.count("*").alias("trades"), F.sum("est").alias("volume"))


def activity(trades: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Counts over the last days, in one pass."""
    recent = trades.filter((F.col("traded_at") >= F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("traded_at") < F.lit(as_of).cast("date")))
    return recent.agg(F.count("*").alias("trades"), F.count_distinct("person_id").alias("persons"), F.count_distinct("ticker").alias("tickers"), F.sum("est").alias("volume"))


def drill(trades: DataFrame, limit: int = 500, **equal: object) -> DataFrame:
    """Trades behind one cell of a heatmap, newest first. Keys: dow, month, year_month, or any column."""
    derived = {"dow": F.dayofweek("traded_at") - 1, "month": F.month("traded_at"), "year_month": F.date_format("traded_at", "yyyy-MM")}
    for key, value in equal.items():
        trades = trades.filter(derived.get(key, F.col(key)) == value)
    out = trades.select(F.date_format("traded_at", "yyyy-MM-dd").alias("day"), "person_id", "name", "party", "ticker", "sector", "trade_type", "est", "order_id", "line")
    return out.orderBy(F.desc("day"), F.desc("order_id"), F.desc("line"), F.desc("est"), "ticker", "trade_type").limit(limit)


def list_companies(companies: DataFrame, latest: DataFrame, sector: str | None = None, contains: str | None = None, least: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Tickers with their sectors; joined with the latest score only if a bound asks for it."""
    out = companies if sector is None else companies.filter(F.col("sector") == sector)
    if contains:
        out = out.filter(F.col("ticker").ilike(f"%{contains}%"))
    out = out.groupBy("ticker", "sector").agg(F.count("*").alias("parts"))
    if least is not None:
        out = out.join(latest.filter(F.col("composite") >= least).select("ticker", "composite"), "ticker")
    return out.orderBy("ticker", "sector").offset(offset).limit(limit)


def list_events(events: DataFrame, kind: str | None = None, since: str | None = None, until: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first, within [since, until)."""
    if kind:
        events = events.filter(F.col("event_type") == kind)
    if since:
        events = events.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        events = events.filter(F.col("ts") < F.lit(until).cast("timestamp"))
    return events.select("event_id", "ts", "user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def timeline(events: DataFrame, scores: DataFrame, top: int = 20) -> DataFrame:
    """Events and score snapshots as one feed, newest first: the newest of each before they are merged."""
    a = events.select("at", F.lit("event").alias("kind"), "what").orderBy(F.desc("at"), "what").limit(top)
    b = scores.select(F.col("computed_at").alias("at"), F.lit("score").alias("kind"), F.col("ticker").alias("what")).orderBy(F.desc("at"), "what").limit(top)
    return a.unionByName(b).orderBy(F.desc("at"), "kind", "what").limit(top)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def freshness(meta: DataFrame, as_of: Column) -> DataFrame:
    """Grade of every source: A to D by how many polling intervals ago it last succeeded."""
    late = (F.unix_seconds(as_of) - F.unix_seconds(F.col("last_success").cast("timestamp"))) / F.col("poll_interval_seconds")
    grade = F.when((F.col("status") != "healthy") | late.isNull(), "D").when(late < 2, "A").when(late < 5, "B").when(late < 10, "C").otherwise("D")
    return meta.withColumn("grade", grade)
