"""Bulk parts of profiles, labels, sectors and aliases on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import insights, profiles, signals, sketches
from ledgerline.sources import sinks

DAY = dt.datetime(2024, 1, 1)
TRADE = "person_id long, ticker string, trade_type string, est long, traded_at timestamp, filed_at timestamp, order_id long, line int, party string"


def trades(spark, *rows):
    return spark.createDataFrame([(p, t, k, e, at, at + dt.timedelta(days=late) if at else None, i, 1, party) for i, (p, t, k, e, at, late, party) in enumerate(rows)], TRADE)


def test_biggest_trade_takes_the_latest_of_equal_ones(spark):
    df = trades(spark, (1, "A", "purchase", 50, DAY, 1, "R"), (1, "B", "sale_full", 50, DAY + dt.timedelta(days=1), 1, "R"), (1, "C", "purchase", 90, None, 1, "R"), (2, "A", "purchase", 0, DAY, 1, "D"))
    assert [tuple(r) for r in profiles.biggest_trades(df).collect()] == [(1, "B", "sale_full", 50, DAY + dt.timedelta(days=1))]


def test_summaries(spark):
    df = trades(spark, (1, "A", "purchase", 10, DAY, 10, "R"), (1, "B", "sale_full", 30, DAY, 50, "R"), (1, "B", "sale_partial", 5, DAY, -3, "R"), (2, "A", "exchange", 7, DAY, 1, "D"))
    got = {r["person_id"]: r for r in profiles.summaries(df).collect()}
    one = got[1]
    assert (one["trades"], one["tickers"], one["buys"], one["sells"], one["volume"], one["bought"], one["sold"], one["median_days"], one["late_pct"]) == (3, 2, 1, 2, 45, 10, 35, 30, 0.5)
    assert (got[2]["buys"], got[2]["sells"], got[2]["median_days"]) == (0, 0, 1)


def test_party_history_finds_changes_and_returns(spark):
    days = [DAY + dt.timedelta(days=k) for k in range(6)]
    df = trades(spark, *[(1, "A", "purchase", 1, at, 1, party) for at, party in zip(days, "RRDDRR", strict=True)], (1, "B", "purchase", 1, days[0], 1, "R"), (2, "A", "purchase", 1, days[0], 1, None), (2, "A", "purchase", 1, days[3], 1, None))
    got = sorted((r["person_id"], r["since"].day, r["until"].day, r["party"], r["trades"]) for r in profiles.party_history(df).collect())
    assert got == [(1, 1, 2, "R", 3), (1, 3, 4, "D", 2), (1, 5, 6, "R", 2), (2, 1, 4, None, 2)]


def test_solo_tickers_of_a_person(spark):
    df = trades(spark, (1, "A", "purchase", 10, DAY, 1, "R"), (1, "A", "sale_full", 10, DAY, 1, "R"), (1, "B", "purchase", 99, DAY, 1, "R"), (2, "B", "purchase", 1, DAY, 1, "R"), (1, "C", "purchase", 30, DAY, 1, "R"), (None, "C", "purchase", 1, DAY, 1, "R"))
    assert [tuple(r) for r in profiles.solo_top(df).orderBy("rank").collect()] == [(1, 1, "C", 1, 30, 1, 0), (1, 2, "A", 2, 20, 1, 1)]


def test_labels_of_a_network(spark):
    pairs = spark.createDataFrame([(1, 2, 3), (2, 9, 4)], "a long, b long, shared long")
    persons = spark.createDataFrame([(1, "Ann", "R", "ann"), (2, "Bo", "", "bo"), (3, "Cy", "D", "cy")], "person_id long, name string, party string, slug string")
    nodes, edges = profiles.labelled_network(pairs, persons)
    assert {tuple(r) for r in nodes.collect()} == {(1, "Ann (R)", "ann"), (2, "Bo", "bo")}
    assert {tuple(r) for r in edges.collect()} == {(1, 2, "co_trader:3", "Ann (R)", "Bo"), (2, 9, "co_trader:4", "Bo", None)}


def test_sectors_are_filled_from_the_first_record_that_has_them(spark):
    companies = spark.createDataFrame([("AA", "old", "kept"), ("BB", None, None), ("CC", "same", "same")], "ticker string, sector string, subsector string")
    records = [(" aa ", "", "Chips", 1), ("AA", "Technology", "Later", 2), ("BB", "Finance", "", 3), ("BB", "Energy", "", 4), ("--", "Energy", "", 5), ("DD", "", " ", 6)]
    got = profiles.backfilled_sectors(companies, spark.createDataFrame(records, "ticker string, sector string, industry string, place int"))
    assert {tuple(r) for r in got.collect()} == {("AA", "Information Technology", "Chips"), ("BB", "Financials", "Finance"), ("CC", "same", "same")}


def test_activity(spark):
    now = DAY + dt.timedelta(days=10)
    events = spark.createDataFrame([(now - dt.timedelta(hours=h), k) for h, k in ((1, "a"), (2, "a"), (23, "b"), (25, "c"), (24 * 8, "d"), (-1, "e"))], "ts timestamp, event_type string")
    scores, companies = spark.createDataFrame([("A",), ("A",)], "ticker string"), spark.createDataFrame([("A",), ("B",)], "ticker string")
    assert tuple(profiles.activity_strip(events, scores, companies, str(now)).first()) == (3, 4, 1, 2)
    assert [tuple(r) for r in profiles.activity_categories(events, str(now)).collect()] == [("a", 2), ("b", 1)]


def test_names_resolve_by_normalised_alias(spark):
    companies = spark.createDataFrame([(1, "ACM", "Acme Inc.")], "id int, ticker string, name string")
    aliases = spark.createDataFrame([(1, "Old Widget Works Inc.")], "entity_id int, alias string")
    names = spark.createDataFrame([(1, None, "OLD WIDGET WORKS CORP"), (2, None, "Old Widget"), (3, None, "old widget works inc.")], "id int, ticker string, name string")
    assert {(r["id"], r["company_id"]) for r in sinks.resolve(names, companies, aliases).collect()} == {(1, 1), (2, None), (3, 1)}


def test_accountability_reads_trades_twice(spark):
    """Once for what a person's own trades say, once for events; pairs of a purchase and a sale 1 to 60 days later count, whatever lies between."""
    days = "case id when 0 then 0 when 1 then 1 when 2 then 60 when 3 then 61 else 30 end"
    rows = spark.range(3, 9).selectExpr(
        "cast(1 as bigint) as person_id", "'T' as ticker", "7 as part_id", "'c' as committee", "'s' as sector", "id as order_id", "1 as line", "10 as est", "if(id in (3, 7), 'purchase', 'sale_full') as trade_type",
        f"timestamp'2020-01-01' + make_interval(0, 0, 0, cast({days.replace('id', '(id - 3)')} as int)) as traded_at", "timestamp'2020-06-01' as filed_at",
    )
    events = spark.createDataFrame([(7, dt.datetime(2020, 1, 15))], "part_id int, at timestamp")
    got = signals.accountability(rows, events)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (3, 9") == 2
    row = got.first()
    # day 0 pairs with the sales of days 1, 30 and 60; day 30 with those of days 60 and 61; days 0 and 1 lie 14 and 13 days ahead of the event
    assert (row["trades"], row["scoreable"], row["late"], row["round_trips"], row["pre_events"]) == (6, 6, 6, 5, 2)


def test_detectors_over_persons_read_trades_once(spark):
    """And insights of several distinct counts send a row no more than once for each (no Expand)."""
    rows = spark.range(3, 13).selectExpr(
        "cast(1 as bigint) as person_id", "'P' as name", "if(id % 2 = 0, 'R', 'D') as party", "'T' as ticker", "id as order_id", "1 as line", "if(id = 12, 100000, 10000 + id) as est",
        "if(id % 2 = 1, 'purchase', 'sale_full') as trade_type", "timestamp'2020-01-01' + make_interval(0, 0, 0, cast(if(id = 12, 3 + id, 3 * id) as int)) as traded_at",
    )
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    trips, wolves = insights.quick_round_trip(rows), insights.lone_wolf(rows)
    assert plan(trips).count("Range (3, 13") == plan(wolves).count("Range (3, 13") == 1
    assert [(r["subject"], r["ticker"]) for r in wolves.collect()] == [("1", "T")]
    assert "Expand" not in plan(insights.coordinated(rows)) and "Expand" not in plan(insights.bipartisan(rows))


def test_accountability_leaves_out_companies_without_events(spark):
    """Before trades are shuffled to meet events, by a broadcast of the companies that have some."""
    rows = spark.range(12).selectExpr(
        "id % 2 as person_id", "'T' as ticker", "id % 3 as part_id", "'c' as committee", "'s' as sector", "id as order_id", "1 as line", "10 as est", "'purchase' as trade_type",
        "timestamp'2020-01-10' as traded_at", "timestamp'2020-06-01' as filed_at",
    )
    events = spark.createDataFrame([(1, dt.datetime(2020, 1, 15)), (1, dt.datetime(2020, 1, 12)), (9, dt.datetime(2020, 1, 12))], "part_id long, at timestamp")
    got = signals.accountability(rows, events)
    assert "Join LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["person_id"]: r["pre_events"] for r in got.collect()} == {0: 2, 1: 2}


def test_persons_are_counted_in_as_many_tasks_as_trades_ask_for(spark):
    rows = spark.range(600).selectExpr("if(id % 3 = 0, 'T', 'U') as ticker", "if(id % 50 = 0, null, id % 40) as person_id", "id as est", "timestamp'2020-01-06' as traded_at")
    spans = sketches.estimates(sketches.merged(sketches.weekly(rows), "ticker"), 0.5, 0.9)
    few, many = (sketches.checked(rows, spans, [F.col("ticker")], (0.5, 0.9), n) for n in (600, 8 * sketches.TRADES_A_TASK))
    shown = [df._jdf.queryExecution().optimizedPlan().toString() for df in (few, many)]
    assert "RepartitionByExpression [ticker" in shown[0] and ", 4\n" in shown[0] and ", 8\n" in shown[1]
    got = [{r["ticker"]: tuple(r[c] for c in ("trades", "persons", "persons_within", "quantiles_within")) for r in df.collect()} for df in (few, many)]
    assert got[0] == got[1] == {"T": (200, 40, True, True), "U": (400, 40, True, True)}
