"""Fourteen detectors with one shape of finding, and their common ranking.

A finding: kind, subject (person id or empty), ticker (or sector), at, rarity (0 to 100), data (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import clamp, days_between, format_dollars, week_of
from .signals import enriched_swarms, oversees, round_trips
from .temporal import asof_join, band_join
from .trades import count_if, is_buy, is_sell

#: Part of a committee's name and the sectors it oversees, for the detectors.
COMMITTEE_SECTORS = (
    ("Armed Services", ("Aerospace & Defense", "Industrials")),
    ("Banking", ("Financials", "Banks")),
    ("Financial Services", ("Financials", "Banks")),
    ("Energy and Commerce", ("Energy", "Utilities")),
    ("Energy and Natural Resources", ("Energy", "Utilities")),
    ("Agriculture", ("Consumer Staples", "Materials")),
    ("Health", ("Health Care",)),
    ("Commerce, Science, and Transportation", ("Technology", "Communication Services")),
    ("Science, Space, and Technology", ("Technology",)),
    ("Veterans' Affairs", ("Health Care",)),
)


def _finding(df: DataFrame, kind: str, subject: Column, ticker: Column, at: Column, rarity: Column, *data: str) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), ticker.cast("string").alias("ticker"), at.cast("timestamp").alias("at"),
        F.round(clamp(rarity), 4).alias("rarity"), F.to_json(F.struct(*data)).alias("data"),
    )


def _size_bonus(est: Column, steps: tuple[float, float, float]) -> Column:
    return F.when(est >= 250_000, float(steps[2])).when(est >= 50_000, float(steps[1])).otherwise(float(steps[0]))


def upper_median(df: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """key, middle: the value at place n / 2 (from 0) of each key with enough rows. Equal values are counted first, so that no list of a key's values is ever held."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("__c"))
    order = Window.partitionBy(key).orderBy(value)
    upto = counts.withColumn("__upto", F.sum("__c").over(order)).withColumn("__n", F.sum("__c").over(Window.partitionBy(key)))
    return upto.filter((F.col("__n") >= least) & (F.col("__upto") > F.expr("__n div 2"))).groupBy(key).agg(F.min(value).alias("middle"))


def coordinated(trades: DataFrame, ticker: str = "ticker", least: int = 3) -> DataFrame:
    # one distinct count beside a set of a few kinds: two would send every row three times
    per = trades.groupBy(ticker, week_of(F.col("traded_at")).alias("week")).agg(
        F.count_distinct("name").alias("reps"), F.size(F.collect_set("trade_type")).alias("kinds"), F.max("traded_at").alias("last")
    )
    rarity = 40 + 20 * F.log2(F.col("reps") - 2.0) + F.when(F.col("kinds") == 1, 10.0).otherwise(0.0)
    return _finding(per.filter(F.col("reps") >= least), "coordinated_trades", F.lit(""), F.col(ticker), F.col("week"), rarity, "reps", "kinds")


def committee_relevant(trades: DataFrame, rules: tuple = COMMITTEE_SECTORS) -> DataFrame:
    own = trades.filter(oversees(F.col("committee"), F.col("sector"), rules))
    own = own.groupBy("person_id", "ticker", F.col("traded_at").cast("date").alias("day")).agg(F.max("est").alias("est"), F.min("committee").alias("committee"))
    return _finding(own, "committee_relevant", F.col("person_id"), F.col("ticker"), F.col("day"), _size_bonus(F.col("est"), (70, 80, 90)), "est", "committee")


def pre_event(trades: DataFrame, events: DataFrame, kind: str = "pre_event", days: int = 14, cut: bool = True) -> DataFrame:
    """Trades 1 to 14 days before an event of the same company (events: part_id, at); of several the nearest."""
    # events are fewer than trades: theirs are the rows that meet two buckets
    near = band_join(events.select("part_id", "at"), trades.select("person_id", "part_id", "traded_at", "est"), ["part_id"], "at", "traded_at", -days, -1, cut)
    near = near.withColumn("gap", days_between(F.col("at"), F.col("traded_at")).cast("int"))
    one = near.groupBy("person_id", "part_id", "traded_at").agg(F.min("gap").alias("gap"), F.max("est").alias("est"))
    rarity = 60 + (14 - F.col("gap")) * 3.0 + _size_bonus(F.col("est"), (0, 3, 5))
    return _finding(one, kind, F.col("person_id"), F.col("part_id"), F.col("traded_at"), rarity, "gap", "est")


def court_trade(trades: DataFrame, filings: DataFrame, cut: bool = True) -> DataFrame:
    return pre_event(trades, filings, "court_trade", cut=cut)


def quick_round_trip(trades: DataFrame, baseline_days: int = 365, days: int = 30, amount: int = 10_000) -> DataFrame:
    """Trips of a month at most, held against the person's usual holding time (upper median of five trips or more)."""
    # all trips once: a person's rows come together, those of each ticker within them, and windows give the middle one
    needed = trades.select("person_id", "ticker", "trade_type", "traded_at", "est", "order_id", "line").repartition("person_id")
    counted = F.col("hold_days") <= baseline_days
    own = Window.partitionBy("person_id")
    trips = round_trips(needed, max(baseline_days, days), 0, None).withColumn("__n", F.count(F.when(counted, 1)).over(own)).withColumn("__place", F.row_number().over(own.orderBy("hold_days")))
    middle = F.max(F.when(F.col("__place") == F.expr("__n div 2 + 1"), F.col("hold_days"))).over(own)
    usual = F.when((F.col("__n") >= 5) & F.col("person_id").isNotNull(), middle)
    quick = trips.withColumn("usual", usual).filter((F.col("hold_days") <= days) & (F.col("est") >= amount))
    off = (F.col("usual") - F.col("hold_days")) / F.col("usual")
    rarity = F.when(F.col("usual").isNull(), F.when(F.col("hold_days") <= 14, 60 + (14 - F.col("hold_days")) * 2.0)).otherwise(F.when(off > 0.3, 50 + off * 50))
    return _finding(quick.withColumn("__r", rarity).filter("__r is not null"), "round_trip", F.col("person_id"), F.col("ticker"), F.col("sold_at"), F.col("__r"), "hold_days", "est", "usual")


def swarm_outlier(trades: DataFrame, insiders: DataFrame, prices: DataFrame) -> DataFrame:
    """Tickers by their swarms: more if insiders traded in a swarm's week, and for each week whose volume was under 1.5 times the usual."""
    per = enriched_swarms(trades, insiders, prices, 4).groupBy("ticker").agg(
        F.sum("reps").alias("reps"), F.count("*").alias("weeks"), F.max("week").alias("week"),
        F.sum("insider_trades").alias("insider_trades"), count_if(F.col("volume_ratio") < 1.5).alias("low_volume_weeks"),
    )
    rarity = 30 + 5.0 * F.col("reps") + 10.0 * F.col("weeks") + F.when(F.col("insider_trades") > 0, 10.0).otherwise(0.0) + 5.0 * F.col("low_volume_weeks")
    return _finding(per.filter(rarity >= 50), "swarm_outlier", F.lit(""), F.col("ticker"), F.col("week"), rarity, "reps", "weeks", "insider_trades", "low_volume_weeks")


def lone_wolf(trades: DataFrame, factor: float = 4.0, least: int = 5, top: int = 3) -> DataFrame:
    """A person's largest trades, if they are several times the person's own upper median."""
    # one shuffle by person of what is needed; its windows give the middle and the largest
    needed = trades.select("person_id", "ticker", "trade_type", "traded_at", "est", "order_id", "line").filter("person_id is not null").repartition("person_id")
    own, positive = Window.partitionBy("person_id"), F.when(F.col("est") > 0, F.col("est"))
    placed = needed.withColumn("__n", F.count(positive).over(own)).withColumn("__place", F.row_number().over(own.orderBy(positive.asc_nulls_last())))
    placed = placed.withColumn("middle", F.max(F.when(F.col("__place") == F.expr("__n div 2 + 1"), positive)).over(own))
    window = own.orderBy(F.desc("est"), F.desc("traded_at"), "ticker", "order_id", "line")
    largest = placed.withColumn("__r", F.row_number().over(window)).filter((F.col("__r") <= top) & (F.col("__n") >= least))
    largest = largest.withColumn("ratio", F.col("est") / F.col("middle")).filter(F.col("ratio") >= factor)
    return _finding(largest, "lone_wolf", F.col("person_id"), F.col("ticker"), F.col("traded_at"), 50 + 25 * F.log10("ratio"), "est", "middle", "trade_type")


def copy_trader(trades: DataFrame, prices: DataFrame, least: int = 3) -> DataFrame:
    """Average return of a person's purchases: last price at or before the trade, first price 25 to 35 days after."""
    buys = trades.filter(is_buy()).select("person_id", "ticker", "traded_at", "order_id", "line")
    entry = asof_join(buys, prices.select("ticker", "at", "price_cents"), ["ticker"], "traded_at", "at", ["price_cents"]).withColumnRenamed("price_cents", "entry").drop("matched_at")
    entry = entry.withColumn("__from", F.col("traded_at") + F.expr("INTERVAL 25 DAYS"))
    out = asof_join(entry, prices.select("ticker", "at", "price_cents"), ["ticker"], "__from", "at", ["price_cents"], forward=True)
    out = out.filter((F.col("matched_at") < F.col("traded_at") + F.expr("INTERVAL 35 DAYS")) & (F.col("entry") > 0) & (F.col("price_cents") > 0))
    gain = (F.col("price_cents") - F.col("entry")) * 100.0 / F.col("entry")
    per = out.groupBy("person_id").agg(F.count("*").alias("trades"), F.round(F.avg(gain), 4).alias("gain"), F.max("traded_at").alias("last")).filter((F.col("trades") >= least) & (F.col("gain") > 0))
    return _finding(per, "copy_trader", F.col("person_id"), F.lit(""), F.col("last"), 50 + 3 * F.col("gain"), "trades", "gain")


def sector_rotation(trades: DataFrame, as_of: str, months: int = 4) -> DataFrame:
    """Sectors whose share of purchases in the current month is 10 points over or under their share in the months before."""
    now = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    recent = trades.filter((F.col("traded_at") >= F.add_months(F.lit(as_of).cast("date"), -months)) & (F.col("traded_at") < F.lit(as_of).cast("date") + F.expr("INTERVAL 1 DAY")))
    current = F.date_trunc("month", "traded_at") == now
    bought = F.when(is_buy(), F.col("est")).otherwise(0)
    per = recent.groupBy("sector").agg(F.sum(F.when(current, bought).otherwise(0)).alias("new"), F.sum(F.when(~current, bought).otherwise(0)).alias("old"))
    whole = Window.partitionBy(F.lit(1))  # one row per sector
    shift = F.try_divide(F.col("new") * 100.0, F.sum("new").over(whole)) - F.try_divide(F.col("old") * 100.0, F.sum("old").over(whole))
    per = per.withColumn("shift", F.round(shift, 4)).filter(F.abs("shift") >= 10)
    return _finding(per, "sector_rotation", F.lit(""), F.col("sector"), F.lit(as_of).cast("timestamp"), 50 + 2 * F.abs("shift"), "shift", "new", "old")


def late_profitable(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Purchases filed over 45 days late whose price had risen by the filing."""
    late = trades.filter(is_buy()).withColumn("delay", F.datediff("filed_at", "traded_at")).filter("delay > 45").select("person_id", "ticker", "traded_at", "filed_at", "delay", "order_id", "line")
    px = prices.select("ticker", "at", "price_cents")
    both = asof_join(late, px, ["ticker"], "traded_at", "at", ["price_cents"]).withColumnRenamed("price_cents", "a").drop("matched_at")
    both = asof_join(both, px, ["ticker"], "filed_at", "at", ["price_cents"]).withColumnRenamed("price_cents", "b").filter("a > 0 and b > a")
    pct = (F.col("b") - F.col("a")) * 100.0 / F.col("a")
    return _finding(both.withColumn("pct", F.round(pct, 4)), "late_profitable", F.col("person_id"), F.col("ticker"), F.col("filed_at"), 50 + F.col("delay") / 5 + 2 * F.col("pct"), "delay", "pct")


def quiet_accumulation(trades: DataFrame, ticker: str = "ticker") -> DataFrame:
    per = trades.filter(is_buy()).groupBy("person_id", ticker).agg(
        F.count("*").alias("buys"), F.min("traded_at").alias("first"), F.max("traded_at").alias("last"), F.sum("est").alias("total"), F.avg("est").alias("mean")
    )
    per = per.withColumn("span", days_between(F.col("last"), F.col("first")).cast("int")).filter("buys >= 3 and span between 1 and 60 and mean > 0 and mean < 50000")
    return _finding(per, "quiet_accumulation", F.col("person_id"), F.col(ticker), F.col("last"), 40 + 10.0 * F.col("buys") + F.col("total") / 50_000, "buys", "span", "total")


def committee_insider(trades: DataFrame, events: DataFrame, rules: tuple = COMMITTEE_SECTORS, days: int = 7, cut: bool = True) -> DataFrame:
    own = trades.filter(oversees(F.col("committee"), F.col("sector"), rules)).select("person_id", "part_id", "traded_at", "est")
    near = band_join(events.select("part_id", "at"), own, ["part_id"], "at", "traded_at", -days, -1, cut)
    one = near.groupBy("person_id", "part_id", "traded_at").agg(F.min(days_between(F.col("at"), F.col("traded_at")).cast("int")).alias("gap"), F.max("est").alias("est"))
    return _finding(one, "committee_insider", F.col("person_id"), F.col("part_id"), F.col("traded_at"), 70 + 5.0 * (7 - F.col("gap")) + _size_bonus(F.col("est"), (0, 5, 10)), "gap", "est")


def bipartisan(trades: DataFrame, ticker: str = "ticker") -> DataFrame:
    # persons first: three distinct counts would send every row four times
    each = trades.groupBy(ticker, week_of(F.col("traded_at")).alias("week"), "person_id").agg(
        count_if(F.col("party") == "R").alias("__r"), count_if(F.col("party") == "D").alias("__d"), count_if(is_buy()).alias("buys"), count_if(is_sell()).alias("sells")
    )
    known = F.col("person_id").isNotNull()
    per = each.groupBy(ticker, "week").agg(
        count_if(known & (F.col("__r") > 0)).alias("r"), count_if(known & (F.col("__d") > 0)).alias("d"), F.count("person_id").alias("n"), F.sum("buys").alias("buys"), F.sum("sells").alias("sells")
    )
    rarity = 50 + 8.0 * F.col("n") + F.when((F.col("buys") == 0) | (F.col("sells") == 0), 15.0).otherwise(0.0)
    return _finding(per.filter("r >= 1 and d >= 1 and n >= 3"), "bipartisan_convergence", F.lit(""), F.col(ticker), F.col("week"), rarity, "r", "d", "n")


def insider_echo(trades: DataFrame, insiders: DataFrame, days: int = 14, cut: bool = True) -> DataFrame:
    """A person and a corporate insider in the same company within two weeks; of several the closest."""
    own = trades.select("person_id", "part_id", "traded_at", F.col("trade_type").alias("pk"))
    other = insiders.select("part_id", F.col("traded_at").alias("it"), F.col("trade_type").alias("ik"))
    near = band_join(own, other, ["part_id"], "traded_at", "it", -days, days, cut)
    same = (F.col("pk") == "purchase") == (F.col("ik") == "purchase")
    near = near.withColumn("gap", F.abs(days_between(F.col("it"), F.col("traded_at"))).cast("int")).withColumn("same", same.cast("int"))
    one = near.groupBy("person_id", "part_id", "traded_at").agg(F.min(F.struct("gap", (-F.col("same")).alias("s"))).alias("best")).select("*", F.col("best.gap").alias("gap"), (-F.col("best.s")).alias("same"))
    return _finding(one, "insider_echo", F.col("person_id"), F.col("part_id"), F.col("traded_at"), 55 + 3.0 * (14 - F.col("gap")) + 10.0 * F.col("same"), "gap", "same")


def ranked(findings: list[DataFrame], as_of: str, limit: int = 20) -> DataFrame:
    """The best of all findings: rarity, blended with a half-life of 30 days."""
    whole = findings[0]
    for more in findings[1:]:
        whole = whole.unionByName(more)
    age = F.greatest(F.lit(0.0), days_between(F.lit(as_of).cast("timestamp"), F.col("at")))
    blend = F.round(0.4 * F.col("rarity") + 0.6 * 100 * F.pow(F.lit(0.5), age / 30), 4)
    return whole.withColumn("blend", blend).orderBy(F.desc("blend"), "kind", "subject", "ticker", "at").limit(limit)


def evidence(findings: DataFrame) -> DataFrame:
    """Findings with ``steps``: the proof of each as a sequence of (date, kind, label), in order of time."""

    def get(path: str) -> Column:
        return F.get_json_object("data", f"$.{path}")

    def step(date: Column, kind: str, *label: Column | str) -> Column:
        return F.struct(date.cast("date").alias("date"), F.lit(kind).alias("kind"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in label]).alias("label"))

    at, ticker, who = F.col("at"), F.col("ticker"), F.concat(F.lit("person "), F.col("subject"))
    amount = F.concat(F.lit(" ($"), format_dollars(get("est").cast("long")), F.lit(")"))
    ahead = F.array(step(at, "trade", who, " traded ", ticker, amount), step(F.date_add(at, get("gap").cast("int")), "event", "event of ", ticker))
    trip = F.array(step(F.date_sub(at, get("hold_days").cast("int")), "trade", who, " buy ", ticker, amount), step(at, "trade", who, " sell ", ticker))
    times = F.format_string("%.1f", get("est").cast("double") / get("middle").cast("double"))
    steps = (
        F.when(F.col("kind").isin("pre_event", "court_trade", "committee_insider"), ahead)
        .when(F.col("kind") == "round_trip", trip)
        .when(F.col("kind") == "coordinated_trades", F.array(step(at, "cluster", get("reps"), " persons traded ", ticker)))
        .when(F.col("kind") == "bipartisan_convergence", F.array(step(at, "cluster", get("n"), " persons of both parties traded ", ticker)))
        .when(F.col("kind") == "committee_relevant", F.array(step(at, "trade", who, " traded ", ticker, " (committee: ", get("committee"), ")")))
        .when(F.col("kind") == "lone_wolf", F.array(step(at, "trade", who, " outsized ", get("trade_type"), " ", ticker, " (", times, " times the usual)")))
        .when(F.col("kind") == "late_profitable", F.array(step(at, "trade", who, " filed ", ticker, " after ", get("delay"), " days")))
        .otherwise(F.array(step(at, "event", F.col("kind"), F.when(ticker != "", F.concat(F.lit(" "), ticker)).otherwise(F.lit("")))))
    )
    return findings.withColumn("steps", steps)


def proof_steps(findings: DataFrame) -> DataFrame:
    """kind, subject, ticker, at, place (from 1), date, step, label: a row for each step of each finding."""
    rows = evidence(findings).select("kind", "subject", "ticker", "at", F.posexplode("steps").alias("place", "s"))
    return rows.select("kind", "subject", "ticker", "at", (F.col("place") + 1).alias("place"), "s.date", F.col("s.kind").alias("step"), "s.label")
