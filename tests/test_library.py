import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import exprs
from ledgerline.operators import graph, insights, scores, signals
from ledgerline.operators.temporal import asof_join, band_join
from ledgerline.plans import fql
from ledgerline.sources import payloads, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_expressions(spark):
    low, high = F.lit(1000), F.lit(15001)
    assert one(spark, exprs.midpoint(low, high), exprs.midpoint(F.lit(None).cast("long"), high)) == (8000, 15001)
    assert one(spark, exprs.normalize_name(F.lit("Acme Widgets Inc./DE")), exprs.slugify(F.lit(" Ann B. Lee "))) == ("acme widgets", "ann-b-lee")
    assert one(spark, exprs.trade_kind(F.lit("Sale (Partial)")), exprs.trade_kind(F.lit("Purchase"))) == ("sale_partial", "purchase")
    a, b = exprs.amount_range(F.lit("$1,001 - $15,000"))
    assert one(spark, a, b) == (1001, 15000)
    assert one(spark, exprs.format_dollars(F.lit(2_500_000)), exprs.format_dollars(F.lit(900))) == ("2.5M", "900")


def test_composite_and_steps(spark):
    got = one(spark, scores.composite(F.lit(80.0), F.lit(60.0), F.lit(70.0)), scores.insider_steps(F.lit(2)), scores.insider_score(F.lit(0), F.lit(0), F.lit(0)))
    assert got == (pytest.approx(69.5), 60.0, 50.0)


def test_market_score(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("A", day + dt.timedelta(days=i), p, None) for i, p in enumerate((10000, 10100, 10200, 10300, 10500))]
    prices = spark.createDataFrame(rows, "ticker string, at timestamp, price_cents long, volume long")
    insiders = spark.createDataFrame([("A",), ("A",)], "ticker string")
    assert scores.market_score(prices, insiders).first()["market"] == pytest.approx(0.3 * 75 + 0.3 * 50 + 0.4 * 60)


def test_band_and_asof_against_brute_force(spark):
    rng = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    left = [(rng.choice("ab"), i, day + dt.timedelta(hours=rng.randint(0, 2000))) for i in range(60)]
    right = [(rng.choice("ab"), i, day + dt.timedelta(hours=rng.randint(0, 2000))) for i in range(60)]
    a, b = spark.createDataFrame(left, "k string, i int, x timestamp"), spark.createDataFrame(right, "k string, j int, y timestamp")
    got = {(r["i"], r["j"]) for r in band_join(a, b, ["k"], "x", "y", -3, 5).collect()}
    assert got == {(i, j) for k, i, x in left for m, j, y in right if k == m and dt.timedelta(days=-3) <= y - x <= dt.timedelta(days=5)}
    for forward in (False, True):
        got = {(r["i"], r["matched_at"]) for r in asof_join(a, b, ["k"], "x", "y", ["j"], forward=forward).collect()}
        want = set()
        for k, i, x in left:
            fits = [y for m, _, y in right if m == k and (y >= x if forward else y <= x)]
            want.add((i, (min(fits) if forward else max(fits)) if fits else None))
        assert got == want


def test_round_trip_takes_the_next_sale(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, "X", "purchase", day, 10, 1, 1), (1, "X", "sale_full", day, 10, 2, 1), (1, "X", "sale_full", day + dt.timedelta(days=9), 10, 3, 1), (1, "X", "sale_full", day + dt.timedelta(days=20), 10, 4, 1)]
    trades = spark.createDataFrame(rows, "person_id int, ticker string, trade_type string, traded_at timestamp, est long, order_id int, line int")
    assert [r["hold_days"] for r in signals.round_trips(trades).collect()] == [9]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("x", "y"), ("a", "a")], "a string, b string")
    found = graph.bfs(edges, "a", 2)
    assert {(r["node"], r["level"]) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.bfs_edges(edges, found).count() == 2
    assert graph.budget_of(4, 500) == 100


def test_graph_query_takes_all_edges(spark):
    import __spark_entry__

    directory = "/root/testdata/sf0.001"
    near = {}
    for name, a, b, x, y in (("orders", "o_orderkey", "o_custkey", "o", "c"), ("lineitem", "l_orderkey", "l_partkey", "o", "p")):
        for r in spark.read.parquet(f"{directory}/{name}.parquet").select(a, b).collect():
            u, v = f"{x}{r[0]}", f"{y}{r[1]}"
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    level, left, edge = {"c7": 0}, 199, ["c7"]
    for k in (1, 2):
        edge = sorted({n for e in edge for n in near.get(e, ())} - set(level))[:left]
        left -= len(edge)
        level |= dict.fromkeys(edge, k)
    got = __spark_entry__.queries()["graph_bfs"](spark, directory).collect()
    assert {r["node"]: r["level"] for r in got} == level and any(n[0] == "p" and int(n[1:]) >= 50 for n in level)


def test_swarm_outlier_adds_insiders_and_quiet_weeks(spark):
    day = dt.datetime(2024, 3, 6)
    trades = spark.createDataFrame([(i, f"N{i}", t, "purchase", "R", day) for t in ("AAA", "BBB", "CCC") for i in range(4)], "person_id int, name string, ticker string, trade_type string, party string, traded_at timestamp")
    insiders = spark.createDataFrame([("AAA", day, "purchase"), ("BBB", day + dt.timedelta(days=9), "purchase")], "ticker string, traded_at timestamp, trade_type string")
    prices = spark.createDataFrame([(t, day - dt.timedelta(days=d), 100, v) for t, now in (("AAA", 149), ("BBB", 150)) for d, v in ((0, now), (20, 100))], "ticker string, at timestamp, price_cents int, volume int")
    got = {r["ticker"]: r["rarity"] for r in insights.swarm_outlier(trades, insiders, prices).collect()}
    assert got == {"AAA": 75.0, "BBB": 60.0, "CCC": 60.0}


def test_fql_parser():
    q = fql.parse('type:trade,insider -ticker:A,B amount:>50k "two words" limit:20 sort:amount')
    assert [c.key for c in q.clauses] == ["type", "ticker", "amount"] and q.clauses[1].negated and q.clauses[2].low == 50_000 and q.clauses[2].low_open
    assert q.words == ["two words"] and (q.limit, q.sort) == (20, "amount")
    for bad in ('"open', "nope:1", "limit:0", "sort:up", "-limit:3", "amount:x", "since:2000,2001", "ticker:"):
        with pytest.raises(fql.FqlError):
            fql.parse(bad)
    day = dt.date(2024, 3, 31)
    assert fql.resolve_date("1m", day) == dt.date(2024, 2, 29) and fql.resolve_date("2023-02", day) == dt.date(2023, 2, 1)
    cursor = fql.write_cursor("recent", {"occurred_at": "2024-01-02T00:00:00", "event_id": 7}, 1, "v1")
    assert fql.read_cursor(cursor, data_as_of="v1")["key"] == {"occurred_at": "2024-01-02T00:00:00", "event_id": 7}
    for sort, version, code in (("amount", "v1", "CURSOR_SORT_ERROR"), ("recent", "v2", "CURSOR_STALE")):
        with pytest.raises(fql.FqlError) as e:
            fql.read_cursor(cursor, sort, version)
        assert e.value.code == code
    assert fql.complexity(fql.parse("")) == 7 and fql.complexity(fql.parse("type:trade since:2000 group:week")) == 2


ROWS = [(1, dt.datetime(2024, 1, d % 3 + 1), f"T{d % 2}", "Acme 5%", d * 10 if d % 4 else None) for d in range(12)]


@pytest.mark.parametrize("sort", ["recent", "amount"])
def test_fql_pages_lose_and_repeat_nothing(spark, sort):
    """All rows share an id, and many a time: pages still hold every row once."""
    df = spark.createDataFrame(ROWS, "event_id long, occurred_at timestamp, ticker string, company_name string, amount_mid long")
    seen, after = [], None
    for _ in range(10):
        page = fql.plan(fql.parse(f"type:trade sort:{sort} limit:5"), {"trade": lambda: df}, dt.date(2024, 2, 1), after=after, data_as_of="v").page()
        seen += [(r["occurred_at"], r["ticker"], r["amount_mid"]) for r in page["results"]]
        after = page["meta"]["next_cursor"]
        if not after:
            break
    assert sorted(seen, key=repr) == sorted(((at, t, n) for _, at, t, _, n in ROWS), key=repr)


def test_fql_warnings_and_errors(spark):
    df = spark.createDataFrame(ROWS, "event_id long, occurred_at timestamp, ticker string, company_name string, amount_mid long")
    builders = {"trade": lambda: df, "warn": lambda: df}

    def plan(text, **more):
        return fql.plan(fql.parse(text), builders, dt.date(2024, 2, 1), **more)

    assert plan("by:5% type:trade").rows.count() == 0 and plan('"5%"').rows.count() == 24 and plan('"5_"').rows.count() == 0
    assert any("party does not apply to warn" in w for w in plan("party:R").warnings) and plan("-party:R type:warn").rows.count() == 0
    assert any("no date" in w for w in plan("since:2024-02 before:2024-01").warnings)
    assert any("no scores" in w for w in plan("score:>50").warnings) and plan("score:>50 workers:>5 score-delta:>1 type:trade").rows.count() == 12
    assert any("repeated" in w for w in plan("ticker:T0 ticker:T1").warnings) and any("no list" in w for w in plan("signal:swarm").warnings)
    assert plan("type:nosuch").rows.count() == 0
    with pytest.raises(fql.FqlError) as e:
        plan("group:week", max_complexity=6)
    assert e.value.code == "COMPLEXITY_LIMIT"
    assert plan("", max_complexity=6).rows.columns == list(fql.CANONICAL) and len(fql.CANONICAL) == 27


def test_lookups(spark):
    from ledgerline.operators import lookups

    assert lookups.page_of() == (50, 0) and lookups.page_of(1000, -3) == (100, 0) and lookups.page_of(7, 2) == (7, 2)
    assert lookups.valid_ticker_text("AAPL") and not lookups.valid_ticker_text("aapl") and lookups.valid_slug_text("ann-b-lee") and not lookups.valid_slug_text("1x")
    with pytest.raises(ValueError):
        lookups.time_range(dt.datetime(2020, 1, 1), dt.datetime(2022, 1, 1))
    events = spark.createDataFrame([(i, None if i % 2 else 5) for i in range(10)], "id long, company_id long")
    assert [r["id"] for r in lookups.unresolved_after(events, 3, 2).collect()] == [5, 7]


def test_asof_crosses_buckets(spark):
    rng = random.Random(5)
    day = dt.datetime(2020, 1, 1)
    left = [("a", i, day + dt.timedelta(days=rng.randint(0, 2000))) for i in range(80)]
    right = [("a", i, day + dt.timedelta(days=rng.randint(0, 2000))) for i in range(12)]
    a, b = spark.createDataFrame(left, "k string, i int, x timestamp"), spark.createDataFrame(right, "k string, j int, y timestamp")
    for forward in (False, True):
        for strict, days in ((False, 7), (True, 7), (False, None), (True, None)):
            got = {(r["i"], r["matched_at"]) for r in asof_join(a, b, ["k"], "x", "y", ["j"], forward=forward, strict=strict, days=days).collect()}
            fits = lambda x, y: (y > x if strict else y >= x) if forward else (y < x if strict else y <= x)
            assert got == {(i, (min if forward else max)((y for *_, y in right if fits(x, y)), default=None)) for _, i, x in left}


def test_sinks(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    meta = spark.createDataFrame([("a", "healthy", 0, t, None, 60), ("b", "degraded", 9, t, "old", 60), ("c", "healthy", 0, t, None, 60)], "source_name string, status string, failures int, last_success timestamp, last_error string, poll_interval_seconds int")
    polls = spark.createDataFrame([("a", t, True, None), ("a", t + dt.timedelta(hours=1), False, "e"), ("b", t, False, "f")], "source_name string, at timestamp, ok boolean, error string")
    got = {r["source_name"]: (r["status"], r["failures"], r["last_error"]) for r in sinks.record_health(meta, polls).collect()}
    assert got == {"a": ("degraded", 1, "e"), "b": ("down", 10, "f"), "c": ("healthy", 0, None)}
    gone = sinks.delete(meta, spark.createDataFrame([("a",)], "source_name string"))
    assert {r["source_name"] for r in gone.collect()} == {"b", "c"}
    sinks.export_all({"source-health": meta}, str(tmp_path), {"source-health": ("status",)})
    assert spark.read.json(f"{tmp_path}/source-health").count() == 3
    lists = sinks.signal_lists(round_trips=spark.createDataFrame([("X",), ("X",), (None,)], "ticker string"))
    assert [tuple(r) for r in lists.collect()] == [("round-trips", "X")]


def test_cooldown_and_budget(spark):
    from ledgerline.streaming import streams

    t = dt.datetime(2024, 1, 1)
    due = spark.createDataFrame([(i, t + dt.timedelta(seconds=i)) for i in range(5)], "user_id long, at timestamp")
    done = spark.createDataFrame([(0, t - dt.timedelta(minutes=1)), (1, t - dt.timedelta(minutes=6))], "user_id long, last timestamp")
    assert [r["user_id"] for r in streams.limited(due, done, budget=3).collect()] == [1, 2, 3]


def test_engine(spark):
    from ledgerline.engine import Engine

    engine = Engine(spark, "/root/testdata/sf0.001")
    assert engine.persons("influence", 5, party="R").count() == 5 and engine.top_tickers(3).count() == 3
    page = engine.fql("type:warn since:1999 limit:3").page()
    assert page["meta"]["result_count"] == 3 and page["meta"]["next_cursor"] and not page["warnings"]
    assert engine.profile("customer#000000007")["headline"].count() == 1 and engine.companies(limit=5).count() == 5


def test_engine_serves_every_route(spark):
    """Connections, sources, streams, activity, profiles and detectors without anything that the caller has to bring."""
    from ledgerline.engine import Engine
    from ledgerline.plans.registry import DETECTORS

    engine = Engine(spark, "/root/testdata/sf0.001")
    assert engine.connections("c7", 1, 10).count() > 1
    of = engine.connections_of(spark.createDataFrame([("c7",), ("c8",)], "node string"), 1, 5)
    assert {r["source"] for r in of["nodes"].collect()} == {"c7", "c8"} and of["edges"].count() > 0
    assert {r["grade"] for r in engine.sources("2024-01-31 12:00:00").collect()} <= set("ABCD")
    assert engine.stream("error").isStreaming and engine.stream(part_id=3).isStreaming
    strip = engine.activity_strip("2024-01-25 00:00:00")
    assert strip["counts"].first()["events_week"] > 0 and strip["categories"].count() == 5
    profile = engine.profile("customer#000000007")
    assert profile["biggest_trade"].count() == profile["summary"].count() == 1 and profile["party"].count() >= 1
    assert engine.network()["edges"].columns == ["a", "b", "relationship", "label_a", "label_b"]
    kinds = {name: DETECTORS[name][0] for name in ("coordinated", "bipartisan")} | {"broken": lambda c: c.read("no_such_table")}
    found = engine.detect(kinds, 5, 300)
    assert {r["detector"]: r["ok"] for r in found["status"].collect()} == {"coordinated": True, "bipartisan": True, "broken": False} and "steps" in found["findings"].columns


def test_payloads(spark):
    def raw(body):
        return spark.createDataFrame([(body, dt.datetime(2024, 1, 1))], "body string, ingest_ts timestamp")

    got = payloads.parse_json(raw('{"results":[{"sub_id":"1","contribution_receipt_date":"2024-02-03"},{"sub_id":"1"},{"sub_id":"2"}]}'), "fec").collect()
    assert len(got) == 2 and {r["event_type"] for r in got} == {"political_contribution"}
    assert payloads.parse_json(raw("not json"), "fec").count() == 0
    assert payloads.parse_json(raw('{"hits":{"hits":[{"_source":{"adsh":"a","file_date":"2024-05-06"}}]}}'), "edgar_form4").first()["occurred_at"] == dt.datetime(2024, 5, 6)
    assert payloads.parse_json(raw('[{"ticker":"X","senator":"S","transaction_date":"05/06/2024","type":"Purchase","ptr_link":"p"}]'), "senate_stock_watcher").first()["occurred_at"] == dt.datetime(2024, 5, 6)
    xml = payloads.parse_xml(raw("<f><filing><report_id>7</report_id><filing_date>01/02/2024</filing_date></filing></f>"), "efds_senate", "congressional_disclosure", "filing", "report_id string, filing_date string", "report_id", "filing_date")
    assert xml.first()["occurred_at"] == dt.datetime(2024, 1, 2)
    html = payloads.parse_html_rows(raw("<tr><th>a</th></tr><tr><td><b>Acme &amp; Co</b></td><td>01/05/2024</td></tr>"), "warn", "warn_filing", ("company", "notice"), ("company", "notice"), "notice")
    assert "Acme & Co" in html.first()["event_data"]


def test_merge_and_resolve(spark):
    old = spark.createDataFrame([("s", "1", "a", 5), ("s", "2", "b", None)], "source string, source_id string, data string, company int")
    new = spark.createDataFrame([("s", "1", "A", None), ("s", "3", "c", 9)], "source string, source_id string, data string, company int")
    merged = sinks.upsert(old, new, ["source", "source_id"], ("company",))
    want = {("s", "1", "A", 5), ("s", "2", "b", None), ("s", "3", "c", 9)}
    assert {tuple(r) for r in merged.collect()} == want
    assert {tuple(r) for r in sinks.upsert(merged, new, ["source", "source_id"], ("company",)).collect()} == want
    companies = spark.createDataFrame([(1, "ACM", "Acme Inc."), (2, "BET", "Beta Corp")], "id int, ticker string, name string")
    names = spark.createDataFrame([(1, "acm", None), (2, None, "beta corporation"), (3, None, "nobody"), (4, None, "Bee")], "id int, ticker string, name string")
    aliases = spark.createDataFrame([(2, "BEE")], "entity_id int, alias string")
    assert {(r["id"], r["company_id"]) for r in sinks.resolve(names, companies, aliases).collect()} == {(1, 1), (2, 2), (3, None), (4, 2)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
