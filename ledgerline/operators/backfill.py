"""Scores of every company at every snapshot date, as one plan.

Facts are first added up by ticker and day, before anything is sorted, so that a ticker has two rows a day at most whatever its share of all facts; then range
frames of 30 and 90 days over the ticker's days give each snapshot what its scores need. A window has both ends in it: what happened at the very instant of a snapshot
counts, and so does what happened to the instant 30 or 90 days before. For that a day's facts at midnight, where snapshots are, are kept apart from the rest of the day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import DAY_MICROS, clamp
from .scores import composite, insider_score, insider_steps, policy_score

MARKET_DAYS, POLICY_DAYS, INSIDER_DAYS, TREND_PRICES = 30, 90, 90, 5
#: Kinds of facts besides prices; each comes as ticker, at and, where it has an amount, cents.
KINDS = ("form4", "congress", "sanction", "contract", "donation")


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def daily(facts: dict[str, DataFrame]) -> DataFrame:
    """ticker, us, and for each kind its number and cents; us is a day's midnight for facts at midnight, else its noon."""
    parts = None
    for kind in KINDS:
        if kind not in facts:
            continue
        own = facts[kind]
        cents = F.coalesce(F.col("cents").cast("long"), F.lit(0)) if "cents" in own.columns else F.lit(0)
        rest = F.pmod(_micros("at"), F.lit(DAY_MICROS))
        slot = _micros("at") - rest + F.when(rest > 0, F.lit(DAY_MICROS // 2)).otherwise(F.lit(0))
        own = own.filter("ticker is not null and at is not null").select("ticker", slot.alias("us"), F.lit(kind).alias("kind"), cents.cast("long").alias("cents"))
        parts = own if parts is None else parts.unionByName(own)
    of = [F.col("kind") == kind for kind in KINDS]
    counts = [F.count(F.when(x, 1)).alias(f"{kind}_n") for x, kind in zip(of, KINDS, strict=True)]
    sums = [F.sum(F.when(x, F.col("cents")).otherwise(0)).alias(f"{kind}_cents") for x, kind in zip(of, KINDS, strict=True)]
    return parts.groupBy("ticker", "us").agg(*counts, *sums)


def month_starts(days: DataFrame) -> DataFrame:
    """ticker, at: the first instant of every month after a ticker's first fact, up to the one after its last."""
    month = [F.date_trunc("month", F.timestamp_micros(f("us"))) for f in (F.min, F.max)]
    span = days.groupBy("ticker").agg(month[0].alias("a"), month[1].alias("b"))
    one = F.expr("INTERVAL 1 MONTH")
    return span.select("ticker", F.explode(F.sequence(F.col("a") + one, F.col("b") + one, one)).alias("at"))


def _prices(prices: DataFrame) -> DataFrame:
    """One row for a ticker and instant, with the last few prices up to it."""
    own = prices.filter("ticker is not null and at is not null").groupBy("ticker", _micros("at").alias("us")).agg(F.max("price_cents").alias("price"), F.max("volume").alias("traded"), F.lit(True).alias("market_row"))
    tail = Window.partitionBy("ticker").orderBy("us").rowsBetween(-TREND_PRICES + 1, 0)
    priced = own.filter("price is not null").select("ticker", "us", F.collect_list(F.struct("us", "price")).over(tail).alias("recent"))
    return own.join(priced, ["ticker", "us"], "left").drop("price")


def trend(recent: Column, since: Column) -> Column:
    """Change from the first to the last of a window's last few prices: -10 % is 0, +10 % is 100; 50 with fewer than two or a first price of 0."""
    inside = F.filter(recent, lambda p: p["us"] >= since)
    first, last = F.get(inside, F.lit(0))["price"].cast("double"), F.element_at(inside, -1)["price"].cast("double")
    return F.when((F.coalesce(F.size(inside), F.lit(0)) < 2) | (first == 0), 50.0).otherwise(clamp(((last - first) / F.nullif(first, F.lit(0.0)) + 0.1) / 0.2 * 100))


def score_history(prices: DataFrame, facts: dict[str, DataFrame], snapshots: DataFrame | None = None) -> DataFrame:
    """ticker, computed_at, market, policy, insider, composite at each snapshot (ticker, at: midnights), by default at the start of each month of a ticker's facts."""
    days, market = daily(facts), _prices(prices)
    rows = days.unionByName(market, allowMissingColumns=True)
    if snapshots is None:
        snapshots = month_starts(rows.select("ticker", "us"))
    asked = snapshots.select("ticker", _micros("at").alias("us"), F.col("at").cast("timestamp").alias("computed_at")).distinct()
    rows = rows.unionByName(asked, allowMissingColumns=True)

    def back(n: int):
        return Window.partitionBy("ticker").orderBy("us").rangeBetween(-n * DAY_MICROS, 0)

    def total(column: str, n: int) -> Column:
        return F.coalesce(F.sum(column).over(back(n)), F.lit(0))

    month = back(MARKET_DAYS)
    wide = rows.select(
        "ticker", "us", "computed_at",
        F.last("recent", ignorenulls=True).over(month).alias("recent"), F.last("traded", ignorenulls=True).over(month).alias("latest"), F.avg("traded").over(month).alias("usual"),
        F.count("market_row").over(month).alias("market_rows"), total("form4_n", MARKET_DAYS).alias("form4_month"), total("form4_n", INSIDER_DAYS).alias("form4"), total("congress_n", INSIDER_DAYS).alias("congress"),
        total("sanction_n", POLICY_DAYS).alias("sanctions"), total("contract_cents", POLICY_DAYS).alias("contract_cents"), total("donation_n", POLICY_DAYS).alias("donations"), total("donation_cents", POLICY_DAYS).alias("donation_cents"),
    ).filter("computed_at is not null")
    volume = F.when(F.col("usual") > 0, clamp((F.col("latest").cast("double") / F.nullif("usual", F.lit(0.0)) - 0.5) / 1.5 * 100)).otherwise(50.0)
    known = (F.col("market_rows") > 0) | (F.col("form4_month") > 0)
    traded = 0.30 * trend(F.col("recent"), F.col("us") - MARKET_DAYS * DAY_MICROS) + 0.30 * volume + 0.40 * insider_steps(F.col("form4_month"))
    scored = wide.select(
        "ticker", "computed_at", F.when(known, clamp(traded)).otherwise(50.0).alias("market"), clamp(policy_score(F.col("sanctions"), F.col("contract_cents"), F.col("donations"))).alias("policy"),
        clamp(insider_score(F.col("form4"), F.col("congress"), F.col("donation_cents") / 100, F.col("donations"))).alias("insider"),
    )
    whole = composite(F.col("market"), F.col("policy"), F.col("insider"))
    return scored.select("ticker", "computed_at", *[F.round(c, 4).alias(c) for c in ("market", "policy", "insider")], F.round(whole, 4).alias("composite"))
