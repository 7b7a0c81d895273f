"""Composite scores: sub-scores from facts, rankings, movers, heatmap, scoreboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import clamp, ladder
from .temporal import latest_per_key

MARKET, POLICY, INSIDER = 0.35, 0.40, 0.25


def composite(market: Column, policy: Column, insider: Column) -> Column:
    return clamp(MARKET * market + POLICY * policy + INSIDER * insider)


def latest_scores(scores: DataFrame) -> DataFrame:
    return latest_per_key(scores, ["ticker"], F.desc("computed_at"))


def rankings(scores: DataFrame, limit: int = 50) -> DataFrame:
    return latest_scores(scores).orderBy(F.desc("composite"), "ticker").limit(limit)


def movers(scores: DataFrame, since: str, limit: int = 20) -> DataFrame:
    """The latest score of the window against the one before it, by the size of the change."""
    window = Window.partitionBy("ticker").orderBy("computed_at")
    both = scores.withColumn("previous", F.lag("composite").over(window)).filter(F.col("computed_at") >= F.lit(since).cast("timestamp"))
    last = latest_per_key(both, ["ticker"], F.desc("computed_at")).filter("previous is not null")
    out = last.select("ticker", F.col("composite").alias("current"), "previous", F.round(F.col("composite") - F.col("previous"), 4).alias("delta"))
    return out.withColumn("change", F.abs("delta")).orderBy(F.desc("change"), "ticker").limit(limit)


def sector_heat(scores: DataFrame, companies: DataFrame) -> DataFrame:
    sectors = companies.select("ticker", "sector").distinct()
    return latest_scores(scores).join(sectors, "ticker").groupBy("sector").agg(F.count("*").alias("tickers"), F.round(F.avg("composite"), 4).alias("composite"))


def trend_score(prices: DataFrame, tail: int = 5) -> DataFrame:
    """Change over the last few prices: -10 % is 0, +10 % is 100; 50 with fewer than two or a first price of 0."""
    window = Window.partitionBy("ticker").orderBy(F.desc("at"))
    last = prices.filter("price_cents is not null").withColumn("__r", F.row_number().over(window)).filter(F.col("__r") <= tail)
    ends = last.groupBy("ticker").agg(F.min_by("price_cents", "at").alias("a"), F.max_by("price_cents", "at").alias("b"), F.count("*").alias("n"))
    change = F.try_divide((F.col("b") - F.col("a")).cast("double"), F.col("a").cast("double"))
    return ends.select("ticker", F.when((F.col("n") < 2) | (F.col("a") == 0), 50.0).otherwise(clamp((change + 0.1) / 0.2 * 100)).alias("trend"))


def volume_score(prices: DataFrame) -> DataFrame:
    ratio = F.try_divide(F.max_by("volume", "at").cast("double"), F.avg("volume"))
    return prices.filter("volume is not null").groupBy("ticker").agg(clamp((ratio - 0.5) / 1.5 * 100).alias("volume"))


def insider_steps(n: Column) -> Column:
    return ladder(n, ((0, 50), (2, 60), (5, 75)), 90)


def market_score(prices: DataFrame, insiders: DataFrame) -> DataFrame:
    """0.30 price trend, 0.30 volume, 0.40 insider trades; what is missing counts as neutral."""
    n = insiders.groupBy("ticker").agg(F.count("*").alias("n"))
    out = trend_score(prices).join(volume_score(prices), "ticker", "full").join(n, "ticker", "full")
    return out.select(
        "ticker",
        F.round(0.30 * F.coalesce("trend", F.lit(50.0)) + 0.30 * F.coalesce("volume", F.lit(50.0)) + 0.40 * insider_steps(F.coalesce("n", F.lit(0))), 4).alias("market"),
    )


def policy_score(sanctions: Column, contract_cents: Column, donations: Column) -> Column:
    contracts = F.when(contract_cents == 0, 50.0).when(contract_cents < 10_000_000_000, 50 + 25 * contract_cents / 1e10).otherwise(90.0)
    return 0.40 * ladder(sanctions, ((0, 50), (2, 70), (5, 85)), 95) + 0.35 * contracts + 0.25 * ladder(donations, ((0, 50), (5, 60), (20, 70)), 80)


def insider_score(form4: Column, congressional: Column, donated_dollars: Column, donations: Column | None = None) -> Column:
    """Weights are spread over the sources that have rows; 50 without any. Without the number of donations, dollars tell whether there are any."""
    parts = (
        (0.30, form4, ladder(form4, ((0, 50), (3, 65), (10, 80)), 90)),
        (0.50, congressional, ladder(congressional, ((0, 50), (2, 60), (5, 70), (10, 80)), 90)),
        (0.20, donated_dollars if donations is None else donations, F.when(donated_dollars == 0, 50.0).when(donated_dollars < 10_000, 60.0).when(donated_dollars < 100_000, 75.0).otherwise(90.0)),
    )
    top = sum((F.when(n > 0, w * s).otherwise(0.0) for w, n, s in parts), F.lit(0.0))
    bottom = sum((F.when(n > 0, w).otherwise(0.0) for w, n, _ in parts), F.lit(0.0))
    return F.coalesce(F.try_divide(top, bottom), F.lit(50.0))


def scoreboard(accountable: DataFrame, limit: int = 100) -> DataFrame:
    out = accountable.select("person_id", F.col("score").cast("int").alias("score"), "trades")
    return out.orderBy(F.desc("score"), F.desc("trades"), "person_id").limit(limit)
