"""Weekly clusters, consensus, first movers, round trips, co-trading, disclosure latency, accountability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import DAY_MICROS, clamp, days_between, sane_date, valid_ticker, week_of
from .temporal import band_join, next_sale
from .trades import count_if, distinct_if, is_buy, is_sell

#: Part of a committee's name and the sectors it oversees, for accountability.
OVERSIGHT = (
    ("Armed", ("Industrials", "Defense")), ("Banking", ("Financials",)), ("Energy", ("Energy", "Utilities")),
    ("Health", ("Health Care",)), ("Commerce", ("Technology", "Communication Services")),
)
LATE_DAYS = 45


def swarms(trades: DataFrame, least: int = 4, limit: int | None = 100) -> DataFrame:
    """Tickers that at least so many persons traded in one ISO week."""
    fine = trades.filter(valid_ticker(F.col("ticker")) & sane_date(F.col("traded_at")))
    found = (
        fine.groupBy("ticker", week_of(F.col("traded_at")).alias("week"))
        .agg(
            F.count_distinct("person_id").alias("reps"), F.count("*").alias("trades"), count_if(is_buy()).alias("buys"), count_if(is_sell()).alias("sells"),
            distinct_if(F.col("party") == "R", "person_id").alias("r_count"), distinct_if(F.col("party") == "D", "person_id").alias("d_count"),
            F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"),
        )
        .filter(F.col("reps") >= least)
    )
    return found if limit is None else found.orderBy(F.desc("week"), F.desc("reps"), "ticker").limit(limit)


def enriched_swarms(trades: DataFrame, insiders: DataFrame, prices: DataFrame, least: int = 4) -> DataFrame:
    """Swarms with insider trades of [week, week + 7 days), the week's volume against the 90 days before, and the week's price move."""
    found = swarms(trades, least, None).select("ticker", "week", "reps").withColumn("start", F.col("week").cast("timestamp"))
    inside = band_join(found, insiders.select("ticker", F.col("traded_at").alias("it"), F.col("trade_type").alias("ik")), ["ticker"], "start", "it", 0, 7)
    inside = inside.filter(F.col("it") < F.col("start") + F.expr("INTERVAL 7 DAYS")).groupBy("ticker", "week").agg(
        F.count("*").alias("insider_trades"), count_if(F.col("ik") == "purchase").alias("insider_buys")
    )
    market = band_join(found, prices.select("ticker", "at", "price_cents", "volume"), ["ticker"], "start", "at", -90, 7)
    now = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.expr("INTERVAL 7 DAYS"))
    before = F.col("at") < F.col("start")
    market = market.groupBy("ticker", "week").agg(
        F.avg(F.when(now, F.col("volume"))).alias("__v"), F.avg(F.when(before, F.col("volume"))).alias("__b"),
        F.min_by(F.when(now, F.col("price_cents")), F.when(now, F.col("at"))).alias("__p"), F.max_by(F.when(now, F.col("price_cents")), F.when(now, F.col("at"))).alias("__q"),
    )
    out = found.drop("start").join(inside, ["ticker", "week"], "left").join(market, ["ticker", "week"], "left").na.fill(0, ["insider_trades", "insider_buys"])
    return out.select(
        "ticker", "week", "reps", "insider_trades", "insider_buys", F.round(F.try_divide("__v", "__b"), 6).alias("volume_ratio"),
        F.round(F.try_divide((F.col("__q") - F.col("__p")) * 100.0, F.col("__p")), 6).alias("price_move"),
    )


def partisan(trades: DataFrame, mode: str | None = None, least: int = 4, limit: int = 50) -> DataFrame:
    """score = (R - D) / (R + D) over distinct buyers and sellers, and what it says of the ticker. mode: consensus or contrarian order."""
    def who(party: str, buy: bool) -> Column:
        return distinct_if((F.col("party") == party) & (is_buy() if buy else is_sell()), "person_id")

    per = trades.filter(valid_ticker(F.col("ticker"))).groupBy("ticker").agg(
        who("R", True).alias("r_buyers"), who("R", False).alias("r_sellers"), who("D", True).alias("d_buyers"), who("D", False).alias("d_sellers"), F.count_distinct("person_id").alias("reps")
    )
    r, d = F.col("r_buyers") + F.col("r_sellers"), F.col("d_buyers") + F.col("d_sellers")
    score = F.round(F.try_divide((r - d).cast("double"), (r + d).cast("double")), 6)
    r_net, d_net = F.signum(F.col("r_buyers") - F.col("r_sellers")), F.signum(F.col("d_buyers") - F.col("d_sellers"))
    kind = (
        F.when(F.col("score") >= 0.6, "partisan_r").when(F.col("score") <= -0.6, "partisan_d")
        .when(r_net * d_net < 0, "contrarian").when(r_net * d_net > 0, "consensus").otherwise("noise")
    )
    out = per.filter(F.col("reps") >= least).withColumn("score", score).withColumn("kind", kind)
    total = r + d
    order = {"contrarian": F.round(total * F.abs("score"), 6), "consensus": F.round(total * (1 - F.abs("score")), 6)}.get(mode, total.cast("double"))
    return out.withColumn("weight", order).orderBy(F.desc("weight"), "ticker").limit(limit)


def first_movers(trades: DataFrame, ticker: str = "ticker", least: int = 3, followers: int = 4) -> DataFrame:
    """For every ticker with enough buyers: who bought first, and the next few with their lag in days."""
    first = trades.filter(is_buy()).groupBy(ticker, "person_id").agg(F.min("traded_at").alias("first_buy"))
    order = Window.partitionBy(ticker).orderBy("first_buy", "person_id")
    whole = Window.partitionBy(ticker)
    ranked = first.withColumn("rank", F.row_number().over(order)).withColumn("buyers", F.count("*").over(whole)).withColumn("lead", F.first("first_buy").over(order))
    return ranked.filter((F.col("buyers") >= least) & (F.col("rank") <= followers + 1)).select(
        ticker, "person_id", "rank", "buyers", "first_buy", F.datediff("first_buy", "lead").alias("lag_days")
    )


def round_trips(trades: DataFrame, max_hold: int = 90, min_amount: int = 0, limit: int | None = 100) -> DataFrame:
    """Every purchase with the next sale of the same person and ticker, if it came soon enough."""
    found = next_sale(trades.select("person_id", "ticker", "trade_type", "traded_at", "est", "order_id", "line"))
    hold = days_between(F.col("sold_at"), F.col("traded_at")).cast("int")
    found = found.withColumn("hold_days", hold).filter((F.col("hold_days") <= max_hold) & (F.col("est") >= min_amount)).drop("trade_type")
    if limit is None:
        return found
    return found.orderBy("hold_days", F.desc("est"), "person_id", "ticker", "order_id", "line").limit(limit)


def co_trade_pairs(trades: DataFrame, ticker: str = "part_id", days: int = 14) -> DataFrame:
    """Pairs of persons (a < b) who traded the same ticker within so many days, with the ticker."""
    own = trades.select(ticker, F.col("person_id").alias("a"), F.col("traded_at").alias("at_a")).distinct()
    other = trades.select(ticker, F.col("person_id").alias("b"), F.col("traded_at").alias("at_b")).distinct()
    return band_join(own, other, [ticker], "at_a", "at_b", -days, days).filter("a < b")


def co_trader_network(trades: DataFrame, ticker: str = "part_id", days: int = 14, least: int = 2, since: str | None = None, limit: int = 500) -> DataFrame:
    if since:
        trades = trades.filter(F.col("traded_at") >= F.lit(since).cast("timestamp"))
    pairs = co_trade_pairs(trades, ticker, days).groupBy("a", "b").agg(F.count_distinct(ticker).alias("shared"))
    return pairs.filter(F.col("shared") >= least).orderBy(F.desc("shared"), "a", "b").limit(limit)


def co_traders(trades: DataFrame, person: int, ticker: str = "part_id", days: int = 14, limit: int = 25) -> DataFrame:
    own = trades.filter(F.col("person_id") == person).select(ticker, F.col("traded_at").alias("at_a")).distinct()
    other = trades.filter(F.col("person_id") != person).select(ticker, "person_id", F.col("traded_at").alias("at_b"))
    pairs = band_join(own, other, [ticker], "at_a", "at_b", -days, days)
    return pairs.groupBy("person_id").agg(F.count_distinct(ticker).alias("shared")).orderBy(F.desc("shared"), "person_id").limit(limit)


def latencies(trades: DataFrame) -> DataFrame:
    """Trades that can be scored, with whole days from trade to filing."""
    fine = trades.filter((F.col("filed_at") >= F.col("traded_at")) & sane_date(F.col("traded_at")))
    return fine.withColumn("days", F.round(days_between(F.col("filed_at"), F.col("traded_at"))).cast("int"))


def latency_leaderboard(trades: DataFrame, least: int = 5, limit: int = 50) -> DataFrame:
    found = latencies(trades).groupBy("person_id", "name").agg(
        F.count("*").alias("trades"), F.round(F.percentile("days", 0.5)).cast("int").alias("median_days"), F.round(F.percentile("days", 0.9)).cast("int").alias("p90_days"),
        F.max("days").alias("worst_days"), F.max_by("ticker", F.struct("days", "ticker")).alias("worst_ticker"), count_if(F.col("days") > LATE_DAYS).alias("late"),
    )
    found = found.filter(F.col("trades") >= least).withColumn("late_pct", F.round(F.col("late") * 100.0 / F.col("trades"), 4))
    return found.orderBy(F.desc("median_days"), F.desc("late_pct"), F.desc("trades"), "person_id").limit(limit)


def latency_summary(trades: DataFrame) -> DataFrame:
    return latencies(trades).agg(
        F.count("*").alias("trades"), F.count_distinct("person_id").alias("persons"), F.round(F.percentile("days", 0.5), 4).alias("p50"),
        F.round(F.percentile("days", 0.9), 4).alias("p90"), count_if(F.col("days") > LATE_DAYS).alias("late"),
    )


def oversees(committee: Column, sector: Column, rules: tuple = OVERSIGHT) -> Column:
    out = F.lit(False)
    for part, sectors in rules:
        out = out | (F.lower(committee).contains(part.lower()) & sector.isin(*sectors))
    return out


def accountability(trades: DataFrame, events: DataFrame, rules: tuple = OVERSIGHT, least: int = 5, trip_days: int = 60, event_days: int = 14) -> DataFrame:
    """Inputs of the accountability score for every person with enough trades, and the score.

    ``events``: part_id, at. Round trips are all pairs of a purchase and a sale 1 to 60 days later; event trades come 1 to 14 days before an event.
    """
    # windows and sums over a person need its rows together: a join by person has dealt them so, or a shuffle by person and ticker does
    filed = F.round(days_between(F.col("filed_at"), F.col("traded_at"))).cast("int")
    scoreable = (F.col("filed_at") >= F.col("traded_at")) & sane_date(F.col("traded_at")) & F.col("person_id").isNotNull()
    own = trades.select(
        "person_id", "ticker", is_buy().alias("buy"), is_sell().alias("sell"), F.unix_micros(F.col("traded_at").cast("timestamp")).alias("at"),
        F.when(scoreable, filed).alias("days"), scoreable.alias("scoreable"), oversees(F.col("committee"), F.col("sector"), rules).alias("overseen"),
    )
    later = Window.partitionBy("person_id", "ticker").orderBy("at").rangeBetween(DAY_MICROS, trip_days * DAY_MICROS)
    paired = F.col("buy") & F.col("at").isNotNull() & F.col("ticker").isNotNull() & F.col("person_id").isNotNull()
    base = own.withColumn("trips", F.when(paired, count_if(F.col("sell")).over(later)).otherwise(0)).groupBy("person_id").agg(
        F.count("*").alias("trades"), count_if(F.col("overseen")).alias("committee_trades"), count_if(F.col("scoreable")).alias("scoreable"), count_if(F.col("scoreable") & (F.col("days") > LATE_DAYS)).alias("late"),
        F.percentile("days", 0.5).alias("median_days"), F.sum("trips").alias("round_trips"),
    ).filter(F.col("trades") >= least)
    # companies without events go first, without a shuffle: a number for each that has some is broadcast; events are fewer than trades: theirs are the rows that meet two buckets
    near = trades.join(F.broadcast(events.select("part_id").distinct()), "part_id", "left_semi").select("person_id", "part_id", "traded_at", "order_id", "line", "est")
    ahead = band_join(events.select("part_id", "at"), near, ["part_id"], "at", "traded_at", -event_days, -1)
    ahead = ahead.groupBy("person_id").agg(F.count_distinct("order_id", "line", "part_id", "est").alias("pre_events"))
    out = base.join(ahead, "person_id", "left").na.fill(0)
    share = F.coalesce(F.try_divide(F.col("late").cast("double"), F.col("scoreable").cast("double")), F.lit(0.0))
    ratio = F.col("committee_trades") / F.col("trades")
    out = out.withColumn("late_pct", F.round(share, 6))
    return out.withColumn("score", F.round(accountability_score(F.col("median_days"), share, ratio, F.col("round_trips"), F.col("pre_events")), 8))


def accountability_score(median_days: Column, late_share: Column, committee_ratio: Column, trips: Column, events: Column) -> Column:
    """0 to 100: late filing, share of late filings, trades in overseen sectors, round trips, trades ahead of events."""
    trip_part = F.when(trips > 0, clamp(30 + 40 * F.log2(F.greatest(trips, F.lit(1))))).otherwise(0.0)
    event_part = F.when(events > 0, clamp(30 + 45 * F.log2(F.greatest(events, F.lit(1))))).otherwise(0.0)
    return 0.30 * clamp(median_days - 20.0) + 0.10 * clamp(late_share * 100) + 0.25 * clamp(committee_ratio / 0.5 * 100) + 0.20 * trip_part + 0.15 * event_part
