"""Score histories against the scorers' definitions, computed one company and date at a time."""

import datetime as dt
import random

import pytest

from ledgerline.operators import backfill

DAY = dt.timedelta(days=1)


def step(n, *bounds):
    return next((v for b, v in bounds if b is None or n <= b))


def plain(ticker, now, prices, facts):
    def inside(kind, days):
        return [r for r in facts.get(kind, []) if r[0] == ticker and r[1] is not None and now - days * DAY <= r[1] <= now]

    own = sorted((r for r in prices if r[0] == ticker and now - 30 * DAY <= r[1] <= now), key=lambda r: r[1])
    month = len(inside("form4", 30))
    market = 50.0
    if own or month:
        priced = [r[2] for r in own if r[2] is not None][-5:]
        trend = 50.0 if len(priced) < 2 or priced[0] == 0 else max(0, min(100, ((priced[-1] - priced[0]) / priced[0] + 0.1) / 0.2 * 100))
        traded = [r[3] for r in own if r[3] is not None]
        volume = max(0, min(100, (traded[-1] / (sum(traded) / len(traded)) - 0.5) / 1.5 * 100)) if traded and sum(traded) else 50.0
        market = 0.3 * trend + 0.3 * volume + 0.4 * step(month, (0, 50), (2, 60), (5, 75), (None, 90))
    cents = sum(r[2] or 0 for r in inside("contract", 90))
    contracts = 50 if cents == 0 else 50 + 25 * cents / 1e10 if cents < 1e10 else 90
    donated = inside("donation", 90)
    policy = 0.4 * step(len(inside("sanction", 90)), (0, 50), (2, 70), (5, 85), (None, 95)) + 0.35 * contracts + 0.25 * step(len(donated), (0, 50), (5, 60), (20, 70), (None, 80))
    form4, congress, gifts = len(inside("form4", 90)), len(inside("congress", 90)), sum(r[2] or 0 for r in donated)
    parts = [
        (0.3, step(form4, (0, 50), (3, 65), (10, 80), (None, 90)), form4), (0.5, step(congress, (0, 50), (2, 60), (5, 70), (10, 80), (None, 90)), congress),
        (0.2, 50 if gifts == 0 else 60 if gifts < 1_000_000 else 75 if gifts < 10_000_000 else 90, len(donated)),
    ]
    weight = sum(w for w, _, n in parts if n)
    insider = sum(w * s for w, s, n in parts if n) / weight if weight else 50.0
    return [max(0, min(100, x)) for x in (market, policy, insider)]


@pytest.fixture(scope="module")
def history():
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)

    def at():
        return start + rng.randint(0, 200) * DAY + rng.choice((0, 0, 1, 40_000, 86_399)) * dt.timedelta(seconds=1)

    tickers = ["A", "A", "A", "B", "C"]
    prices = {(rng.choice(tickers), at()): (rng.choice((None, 0, *range(900, 1100, 7))), rng.choice((None, 0, 100, 250, 900))) for _ in range(150)}
    facts = {kind: [(rng.choice(tickers), at(), rng.choice((None, -5, 0, 40_000, 3_000_000, 900_000_000, 6_000_000_000))) for _ in range(n)] for kind, n in (("form4", 60), ("congress", 40), ("sanction", 12), ("contract", 25), ("donation", 60))}
    facts["sanction"] += [("D", dt.datetime(2024, 3, 1), None), ("D", None, None), (None, dt.datetime(2024, 3, 1), None)]
    return [(*k, *v) for k, v in prices.items()], facts


def frames(spark, prices, facts):
    own = spark.createDataFrame([(*r, "clash", 1) for r in prices], "ticker string, at timestamp, price_cents long, volume long, kind string, us int")
    rest = {}
    for kind, rows in facts.items():
        df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "ticker string, at timestamp, cents long, kind string, us int")
        rest[kind] = df if kind in ("contract", "donation") else df.drop("cents")
    return own, rest


def test_score_history(spark, history):
    prices, facts = history
    got = backfill.score_history(*frames(spark, prices, facts)).collect()
    for ticker in "ABCD":
        times = [r[1] for r in prices if r[0] == ticker] + [r[1] for rows in facts.values() for r in rows if r[0] == ticker and r[1]]
        first, last = min(times), max(times)
        want = {dt.datetime(2024, m, 1) for m in range(first.month + 1, last.month + 2)}
        assert {r["computed_at"] for r in got if r["ticker"] == ticker} == want
    for r in got:
        market, policy, insider = plain(r["ticker"], r["computed_at"], prices, facts)
        assert [r["market"], r["policy"], r["insider"]] == pytest.approx([market, policy, insider], abs=1e-4)
        assert r["composite"] == pytest.approx(0.35 * market + 0.4 * policy + 0.25 * insider, abs=1e-3)


def test_ends_of_windows_are_inside(spark):
    now = dt.datetime(2024, 6, 1)
    asked = spark.createDataFrame([("A", now)], "ticker string, at timestamp")
    for gap, n in ((dt.timedelta(0), 1), (90 * DAY, 1), (90 * DAY + dt.timedelta(seconds=1), 0), (-dt.timedelta(seconds=1), 0)):
        prices, facts = frames(spark, [], {"sanction": [("A", now - gap, None)]})
        row = backfill.score_history(prices, facts, asked).first()
        assert row["policy"] == pytest.approx(0.4 * (70 if n else 50) + 0.35 * 50 + 0.25 * 50) and (row["market"], row["insider"]) == (50.0, 50.0)


def test_a_ticker_is_added_up_before_it_is_sorted(spark):
    """However many facts a ticker has, it has two rows a day at most when its windows are computed."""
    at = dt.datetime(2024, 5, 1)
    many = spark.range(20_000).selectExpr("'A' as ticker", f"timestamp'{at}' + make_interval(0, 0, 0, cast(id % 10 as int), 0, 0, id % 86400) as at")
    days = backfill.daily({"form4": many})
    assert days.count() <= 20 and days.groupBy().sum("form4_n").first()[0] == 20_000
