"""Queries for lookups, listings, range scans, set operations and sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookups, profiles, signals, trades
from ..sources import sinks
from .mapping import AS_OF, PX, SC, T, Catalog

P = """p AS (SELECT c_custkey AS person_id, c_name AS name, lower(c_name) AS slug, CASE c_custkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'D' ELSE 'I' END AS party,
 CASE c_custkey % 2 WHEN 0 THEN 'senator' ELSE 'representative' END AS role, 'legislative' AS person_branch, (c_custkey % 4 + 1)::INT AS tier, c_mktsegment AS committee, n_name AS state
 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
TOTALS = "tot AS (SELECT person_id, count(*) AS trades, count(DISTINCT ticker) AS tickers, sum(est)::BIGINT AS volume FROM t GROUP BY 1)"
LATEST = "la AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY computed_at DESC) = 1)"
COMPANY = "p_partkey AS part_id, p_brand AS ticker, p_name AS company, p_type AS sector"
BASE = "1995-01-01"


def _days(c: Catalog, key: str) -> F.Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit(BASE).cast("timestamp")) + F.col(key) % 2400 * 86400)


def _lobbying(c: Catalog) -> DataFrame:
    own = c.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("company_id"), F.col("c_name").alias("registrant"), F.round(F.col("c_acctbal") * 100).cast("long").alias("amount_cents"), _days(c, "c_custkey").alias("filed_at"))
    return lookups.lobbying_records(own.filter("amount_cents >= 0"), c.companies.select(F.col("part_id").alias("company_id"), "ticker")).select("id", "registrant", "ticker", "amount", "filed_at")


def _contributors(c: Catalog) -> DataFrame:
    own = c.facts(person=False)
    return lookups.score_breakdown([
        lookups.top_contributors(own, F.abs(F.col("est")), "insider", F.col("trade_type"), 3, "traded_at", "order_id", "line", "part_id", "high"),
        lookups.top_contributors(c.prices, F.abs(F.col("volume")), "market", F.col("price_cents"), 3, "at"),
    ])


def signal_lists(c: Catalog) -> DataFrame:
    """The tickers of each signal, as one table that the filter language can read."""
    facts = c.facts()
    return sinks.signal_lists(swarms=signals.swarms(facts, 8, None), partisan_consensus=signals.partisan(facts, "consensus"), round_trips=signals.round_trips(facts, 3, 0, None))


def _freshness(c: Catalog) -> DataFrame:
    return trades.freshness(c.source_meta, F.lit("2024-01-31 12:00:00").cast("timestamp"))


def register(add) -> None:
    add("company_by_ticker", f"SELECT {COMPANY} FROM part WHERE p_brand = 'Brand#2'", lambda c: lookups.lookup(c.companies.select("part_id", "ticker", "company", "sector"), "ticker", "Brand#2"))
    add("person_by_slug", "SELECT * FROM p WHERE slug = 'customer#000000007'", lambda c: lookups.lookup(c.persons, "slug", "customer#000000007"), P)
    add("event_by_id", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_id = 77", lambda c: lookups.lookup(c.read("events").select("event_id", "ts", "user_id", "event_type", "value"), "event_id", 77))
    add(
        "persons_filtered", "SELECT p.*, coalesce(trades, 0) AS trades, coalesce(tickers, 0) AS tickers, coalesce(volume, 0) AS volume FROM p LEFT JOIN tot USING (person_id) WHERE tier = 3 AND role = 'senator' AND party = 'D' "
        "ORDER BY volume DESC, trades DESC, tier, name, person_id LIMIT 40 OFFSET 2",
        lambda c: lookups.list_persons_by(c.persons, lookups.person_totals(c.facts(person=False)), "influence", 40, 2, tier=3, role="senator", party="D", state=None), P, TOTALS,
    )
    add("persons_by_name", "SELECT * FROM p WHERE state = 'NATION_3' AND person_branch = 'legislative' ORDER BY name, person_id LIMIT 50", lambda c: lookups.list_persons_by(c.persons, state="NATION_3", person_branch="legislative"), P)
    add("persons_count", "SELECT count(*) AS n FROM p WHERE party = 'R' AND tier = 1", lambda c: lookups.count_rows(lookups.filter_equal(c.persons, {"party": "R", "tier": 1})), P)
    add("companies_count", "SELECT count(*) AS n FROM part WHERE p_type = 'ECONOMY'", lambda c: lookups.count_rows(lookups.filter_equal(c.companies, {"sector": "ECONOMY"})))
    since, until = "2000-03-01", "2000-03-20"
    between = f"BETWEEN TIMESTAMP '{since}' AND TIMESTAMP '{until}'"
    add("scan_market_data", f"SELECT * FROM px WHERE at {between} AND ticker = 'Brand#2'", lambda c: lookups.range_scan(c.prices, "at", since, until, "ticker", ticker="Brand#2"), PX)
    add("scan_congressional_trades", f"SELECT person_id, ticker, traded_at, order_id, line, est FROM t WHERE traded_at {between} AND ticker = 'Brand#2'",
        lambda c: lookups.range_scan(c.facts(person=False).select("person_id", "ticker", "traded_at", "order_id", "line", "est"), "traded_at", since, until, "order_id", "line", ticker="Brand#2"))
    add("scan_insider_trades", f"SELECT insider_id, ticker, filed_at, order_id, line, est FROM t WHERE filed_at {between} AND ticker = 'Brand#2'",
        lambda c: lookups.range_scan(c.facts(person=False, order=False).select("insider_id", "ticker", "filed_at", "order_id", "line", "est"), "filed_at", since, until, "order_id", "line", ticker="Brand#2"))
    for kind, columns in (("sanction", "event_id, occurred_at, entity_name, program"), ("contract", "event_id, occurred_at, agency, amount_mid"), ("donation", "event_id, occurred_at, ticker, amount_mid")):
        names = columns.split(", ")
        at = ("1995-01-10", "1996-06-30") if kind == "sanction" else ("2000-01-03", "2000-01-20")
        inside = f"BETWEEN TIMESTAMP '{at[0]}' AND TIMESTAMP '{at[1]}'"

        def scan(c: Catalog, kind: str = kind, names: list = names, at: tuple = at) -> DataFrame:
            from .fql import canonical

            rows = c.branches()[kind]()
            if kind != "sanction":
                rows = rows.withColumn("amount_mid", F.expr("amount_mid div 100"))
            return lookups.range_scan(canonical(rows, kind).select(*names), "occurred_at", *at, "event_id")

        from .mapping import FQ

        add(f"scan_{kind}s", f"SELECT {columns} FROM fq WHERE event_type = '{kind}' AND occurred_at {inside}", scan, FQ)
    add("lobbying_list", "SELECT c_custkey AS id, c_name AS registrant, p_brand AS ticker, '$' || format('{:,}', CAST(round(c_acctbal * 100) AS BIGINT) // 100) AS amount, TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2400 AS INT)) AS filed_at "
        "FROM customer LEFT JOIN part ON p_partkey = c_custkey WHERE CAST(round(c_acctbal * 100) AS BIGINT) >= 0 ORDER BY filed_at DESC, id DESC LIMIT 50", _lobbying)  # fmt: skip
    add("score_breakdown", "SELECT ticker, 'insider' AS category, rank, trade_type AS label, traded_at AS at, est::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY est DESC, traded_at DESC, order_id, line, part_id, high)::INT AS rank FROM t) WHERE rank <= 3 "
        "UNION ALL SELECT ticker, 'market', rank, price_cents::VARCHAR, at, volume::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY volume DESC, at DESC)::INT AS rank FROM px) WHERE rank <= 3", _contributors, PX)  # fmt: skip
    add("cube", "SELECT party, trade_type, count(*) AS trades, sum(est)::BIGINT AS volume FROM t GROUP BY CUBE (party, trade_type)", lambda c: c.facts(company=False).cube("party", "trade_type").agg(F.count("*").alias("trades"), F.sum("est").alias("volume")))
    add("rollup", "SELECT sector, ticker, count(*) AS trades FROM t GROUP BY ROLLUP (sector, ticker)", lambda c: c.facts(person=False, order=False).rollup("sector", "ticker").agg(F.count("*").alias("trades")))
    for name, op, do in (("union_distinct", "UNION", lambda a, b: a.union(b).distinct()), ("intersect", "INTERSECT", lambda a, b: a.intersect(b)), ("except", "EXCEPT", lambda a, b: a.subtract(b))):
        add(f"set_{name}", f"SELECT person_id FROM t WHERE ticker = 'Brand#2' AND est > 60000 {op} SELECT person_id FROM t WHERE ticker = 'Brand#3' AND est > 30000",
            lambda c, do=do: do(*[c.facts(person=False).filter((F.col("ticker") == b) & (F.col("est") > e)).select("person_id") for b, e in (("Brand#2", 60000), ("Brand#3", 30000))]))
    for name, column in (("agencies", "o_orderpriority"), ("programs", "r_name"), ("committees", "c_mktsegment"), ("active_traders", "o_custkey")):
        table = {"o": "orders", "r": "region", "c": "customer"}[column[0]]
        add(f"distinct_{name}", f"SELECT DISTINCT {column} FROM {table}", lambda c, t=table, k=column: trades.distinct_values(c.read(t), k))
    add("freshness", "SELECT *, CASE WHEN status <> 'healthy' THEN 'D' WHEN late < 2 THEN 'A' WHEN late < 5 THEN 'B' WHEN late < 10 THEN 'C' ELSE 'D' END AS grade FROM (SELECT source_name, last_success, poll_interval_seconds, status FROM "
        "(SELECT event_type AS source_name, max(ts) AS last_success, count(*) % 7 * 3600 + 60 AS poll_interval_seconds, CASE WHEN event_type = 'view' THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY event_type)) "
        "JOIN (SELECT event_type AS source_name, (epoch(TIMESTAMP '2024-01-31 12:00:00')::BIGINT - floor(epoch(max(ts)))::BIGINT) / (count(*) % 7 * 3600 + 60)::DOUBLE AS late FROM events GROUP BY 1) USING (source_name)".replace("SELECT *, CASE", "SELECT source_name, last_success, poll_interval_seconds, status, CASE"), _freshness)  # fmt: skip
    add("prune_scores", "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY computed_at DESC) AS r FROM sc) WHERE computed_at >= TIMESTAMP '2001-07-01' OR r = 1", lambda c: sinks.prune_scores(c.scores, F.lit("2001-07-01").cast("timestamp")), SC)
    _profiles(add)


EVENTS_NOW = "2024-01-25 06:00:00"
HISTORY = """pd AS (SELECT person_id, traded_at::DATE AS day, CASE WHEN year(traded_at) % 4 = 0 THEN 'I' ELSE party END AS party, count(*) AS n FROM t GROUP BY ALL),
ps AS (SELECT *, coalesce(lag(party) OVER w <> party, TRUE)::INT AS new FROM pd WINDOW w AS (PARTITION BY person_id ORDER BY day, party)),
pq AS (SELECT *, sum(new) OVER (PARTITION BY person_id ORDER BY day, party) AS span FROM ps)"""


def _histories(c: Catalog) -> DataFrame:
    """Every fourth year all trade as independents, so that there are changes to find."""
    party = F.when(F.year("traded_at") % 4 == 0, "I").otherwise(F.col("party"))
    return profiles.party_history(c.facts(company=False).withColumn("party", party))


def _profiles(add) -> None:
    buy, sell = "trade_type = 'purchase'", "trade_type LIKE 'sale%'"
    late = "pl AS (SELECT person_id, floor(quantile_cont(days, 0.5) + 0.5)::BIGINT AS median_days, round(count(*) FILTER (WHERE days > 45)::DOUBLE / count(*), 6) AS late_pct FROM (SELECT *, date_diff('day', traded_at, filed_at) AS days FROM t WHERE filed_at >= traded_at AND traded_at >= TIMESTAMP '2000-01-01') GROUP BY 1)"
    add("person_summaries", f"SELECT a.*, median_days, late_pct FROM (SELECT person_id, count(*) AS trades, count(DISTINCT ticker) AS tickers, count(*) FILTER (WHERE {buy}) AS buys, count(*) FILTER (WHERE {sell}) AS sells, sum(est)::BIGINT AS volume, "
        f"coalesce(sum(est) FILTER (WHERE {buy}), 0)::BIGINT AS bought, coalesce(sum(est) FILTER (WHERE {sell}), 0)::BIGINT AS sold, min(traded_at) AS first_trade, max(traded_at) AS last_trade FROM t GROUP BY 1) a LEFT JOIN pl USING (person_id)",
        lambda c: profiles.summaries(c.facts(person=False)), late)
    add("person_biggest_trade", "SELECT person_id, ticker, trade_type, est, traded_at FROM t WHERE est > 0 QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY est DESC, traded_at DESC, ticker DESC, trade_type DESC, order_id DESC, line DESC) = 1",
        lambda c: profiles.biggest_trades(c.facts(person=False)))
    add("person_solo_tickers", f"SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY volume DESC, trades DESC, part_id)::INT AS rank, part_id, trades, volume, buys, sells FROM (SELECT part_id, min(person_id) AS person_id, count(*) AS trades, sum(est)::BIGINT AS volume, count(*) FILTER (WHERE {buy}) AS buys, count(*) FILTER (WHERE {sell}) AS sells "
        "FROM t GROUP BY 1 HAVING min(person_id) = max(person_id)) QUALIFY rank <= 10", lambda c: profiles.solo_top(c.facts(company=False, person=False), "part_id"))  # fmt: skip
    add("person_party_history", "SELECT person_id, span::BIGINT AS span, any_value(party) AS party, min(day) AS since, max(day) AS until, sum(n)::BIGINT AS trades FROM pq GROUP BY 1, 2", _histories, HISTORY)
    since, until = f"TIMESTAMP '{EVENTS_NOW}' - INTERVAL {{}} DAY", f"ts < TIMESTAMP '{EVENTS_NOW}'"
    add("activity_strip", f"SELECT count(*) FILTER (WHERE ts >= {since.format(1)}) AS events_day, count(*) AS events_week, (SELECT count(DISTINCT ticker) FROM sc) AS companies_scored, (SELECT count(DISTINCT p_brand) FROM part) AS companies FROM events WHERE ts >= {since.format(7)} AND {until}",
        lambda c: profiles.activity_strip(c.read("events"), c.scores, c.companies, EVENTS_NOW), SC)
    add("activity_categories", f"SELECT event_type AS category, count(*) AS n FROM events WHERE ts >= {since.format(1)} AND {until} GROUP BY 1 ORDER BY n DESC, category LIMIT 20", lambda c: profiles.activity_categories(c.read("events"), EVENTS_NOW))
    pairs = "np AS (SELECT a.person_id AS a, b.person_id AS b, count(DISTINCT a.part_id) AS shared FROM t a JOIN t b ON a.part_id = b.part_id AND a.person_id < b.person_id AND abs(date_diff('day', a.traded_at, b.traded_at)) <= 14 GROUP BY 1, 2 HAVING shared >= 2 ORDER BY shared DESC, 1, 2 LIMIT 500)"
    named = "CASE WHEN party <> '' THEN name || ' (' || party || ')' ELSE name END"

    def network(c: Catalog, edges: bool) -> DataFrame:
        return profiles.labelled_network(signals.co_trader_network(c.facts(company=False, person=False)), c.persons)[int(edges)]

    add("network_nodes", f"SELECT person_id, {named} AS label, slug FROM p WHERE person_id IN (SELECT a FROM np UNION SELECT b FROM np)", lambda c: network(c, False), P, pairs)
    add("network_edges", f"SELECT a, b, 'co_trader:' || shared AS relationship, {named.replace('name', 'x.name').replace('party', 'x.party')} AS label_a, {named.replace('name', 'y.name').replace('party', 'y.party')} AS label_b FROM np JOIN p x ON x.person_id = a JOIN p y ON y.person_id = b", lambda c: network(c, True), P, pairs)
