"""All queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, graph, graph_many, insights, scores, signals, sketches, trades
from ..operators.temporal import asof_join
from ..sources import datasets, variant
from ..streaming import streams
from ..streaming.loads import shared_root
from . import feed_queries, fql_queries, more_queries, stream_queries
from .mapping import AS_OF, PX, SC, T, Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BUILDS: dict[str, Callable[[Catalog], DataFrame]] = {}
SQL: dict[str, str] = {}
RULES = (("BUILD", ("ECONOMY", "SMALL")), ("AUTO", ("STANDARD",)), ("MACHINE", ("PROMO", "LARGE")))
RULE_SQL = "((committee LIKE '%BUILD%' AND sector IN ('ECONOMY', 'SMALL')) OR (committee LIKE '%AUTO%' AND sector = 'STANDARD') OR (committee LIKE '%MACHINE%' AND sector IN ('PROMO', 'LARGE')))"
BUY, SELL = "trade_type = 'purchase'", "trade_type LIKE 'sale%'"
DAYS = "(epoch_us({b}) - epoch_us({a})) / 86400000000.0"


def add(name: str, sql: str | None, build: Callable[[Catalog], DataFrame], *tables: str) -> None:
    """Registers a query; ``tables`` are the common table expressions its SQL needs besides the trades."""
    BUILDS[name] = build
    QUERIES[name] = lambda spark, directory: build(Catalog(spark, directory))
    if sql:
        whole = sql if sql.startswith("WITH") else f"WITH {', '.join([T, *tables])} {sql}"
        SQL[name] = re.sub(r'(?<!")\bat\b(?!")', '"at"', whole)  # a reserved word there


def n_if(x: str) -> str:
    return f"count(*) FILTER (WHERE {x})"


def d_if(x: str, what: str = "person_id") -> str:
    return f"count(DISTINCT CASE WHEN {x} THEN {what} END)"


add(
    "top_tickers",
    f"SELECT ticker, count(*) AS trades, count(DISTINCT person_id) AS reps, {n_if(BUY)} AS buys, {n_if(SELL)} AS sells, {d_if("party = 'R'")} AS r_count, {d_if("party = 'D'")} AS d_count, "
    "sum(est)::BIGINT AS volume, min(traded_at) AS first_trade, max(traded_at) AS last_trade FROM t GROUP BY ticker ORDER BY reps DESC, trades DESC, ticker LIMIT 50",
    lambda c: trades.top_tickers(c.facts()),
)
add(
    "ticker_persons",
    f"SELECT ticker, person_id, name, party, count(*) AS trades, {n_if(BUY)} AS buys, {n_if(SELL)} AS sells, sum(est)::BIGINT AS volume, max(traded_at) AS last_trade FROM t GROUP BY ALL",
    lambda c: trades.ticker_persons(c.facts()),
)
add(
    "persons_by_influence",
    "SELECT c_custkey AS person_id, c_name AS name, 'R' AS party, n_name AS state, coalesce(a.trades, 0) AS trades, coalesce(a.tickers, 0) AS tickers, coalesce(a.volume, 0) AS volume "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT person_id, count(*) AS trades, count(DISTINCT ticker) AS tickers, sum(est)::BIGINT AS volume FROM t GROUP BY 1) a ON a.person_id = c_custkey "
    "WHERE c_custkey % 3 = 0 ORDER BY volume DESC, trades DESC, name LIMIT 50",
    lambda c: trades.list_persons(c.trades, c.persons, party="R"),
)
add(
    "person_headline",
    "SELECT person_id, sum(n)::BIGINT AS trades, count(*) AS tickers, sum(v)::BIGINT AS volume, round(sum((v::DOUBLE / whole) * (v::DOUBLE / whole)), 6) AS hhi, round(max(v::DOUBLE / whole), 6) AS top_share, max(big) AS biggest "
    "FROM (SELECT person_id, ticker, count(*) AS n, sum(est)::BIGINT AS v, max(est) AS big, sum(sum(est)) OVER (PARTITION BY person_id)::BIGINT AS whole FROM t GROUP BY 1, 2) GROUP BY person_id",
    lambda c: trades.person_headline(c.facts(person=False)),
)
add(
    "person_top_tickers",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY volume DESC, ticker)::INT AS rank FROM (SELECT person_id, ticker, count(*) AS trades, sum(est)::BIGINT AS volume FROM t GROUP BY 1, 2)) WHERE rank <= 10",
    lambda c: trades.person_top_tickers(c.facts(person=False)),
)
add(
    "solo_tickers",
    "SELECT part_id, min(person_id) AS person_id, count(*) AS trades FROM t GROUP BY part_id HAVING count(DISTINCT person_id) = 1",
    lambda c: trades.solo_tickers(c.facts(company=False, person=False), "part_id"),
)
add(
    "net_flow",
    f"SELECT person_id, strftime(traded_at, '%Y-%m') AS month, coalesce(sum(est) FILTER (WHERE {BUY}), 0)::BIGINT AS bought, coalesce(sum(est) FILTER (WHERE {SELL}), 0)::BIGINT AS sold, (coalesce(sum(est) FILTER (WHERE {BUY}), 0) - coalesce(sum(est) FILTER (WHERE {SELL}), 0))::BIGINT AS net FROM t GROUP BY 1, 2",
    lambda c: trades.net_flow(c.facts(company=False, person=False)),
)
add(
    "owner_split",
    "SELECT CASE WHEN committee = 'FURNITURE' THEN 'unspecified' ELSE committee END AS owner, count(*) AS trades, sum(est)::BIGINT AS volume FROM t GROUP BY 1",
    lambda c: trades.owner_split(c.trades, F.when(F.col("committee") == "FURNITURE", "--").otherwise(F.col("committee"))),
)
add("heat_day_month", "SELECT dayofweek(traded_at)::INT AS dow, month(traded_at)::INT AS month, count(*) AS trades, sum(est)::BIGINT AS volume FROM t GROUP BY 1, 2", lambda c: trades.heat_day_month(c.facts(company=False, person=False)))
add(
    "heat_party_sector",
    f"SELECT party, sector, count(*) AS trades, {n_if(BUY)} AS buys, {n_if(SELL)} AS sells, sum(est)::BIGINT AS volume FROM t GROUP BY 1, 2",
    lambda c: trades.heat_party_sector(c.facts()),
)
TOP_P = "p AS (SELECT person_id FROM t GROUP BY 1 ORDER BY count(*) DESC, person_id LIMIT 15)"
add(
    "heat_person_month",
    "SELECT person_id, name, strftime(traded_at, '%Y-%m') AS month, count(*) AS trades FROM t WHERE person_id IN (SELECT person_id FROM p) GROUP BY ALL",
    lambda c: trades.heat_person_month(c.facts(company=False)), TOP_P,
)
add(
    "heat_person_ticker",
    "SELECT person_id, ticker, count(*) AS trades, sum(est)::BIGINT AS volume FROM t WHERE person_id IN (SELECT person_id FROM p) AND ticker IN (SELECT ticker FROM k) GROUP BY ALL",
    lambda c: trades.heat_person_ticker(c.facts(person=False)), TOP_P, "k AS (SELECT ticker FROM t GROUP BY 1 ORDER BY count(*) DESC, ticker LIMIT 10)",
)
add(
    "activity",
    f"SELECT count(*) AS trades, count(DISTINCT person_id) AS persons, count(DISTINCT ticker) AS tickers, sum(est)::BIGINT AS volume FROM t WHERE traded_at >= DATE '{AS_OF}' - 365 AND traded_at < DATE '{AS_OF}'",
    lambda c: trades.activity(c.facts(person=False), AS_OF),
)
add(
    "drill_party_sector",
    "SELECT strftime(traded_at, '%Y-%m-%d') AS day, person_id, name, party, ticker, sector, trade_type, est, order_id, line FROM t WHERE party = 'D' AND sector = 'ECONOMY' ORDER BY day DESC, order_id DESC, line DESC, est DESC, ticker, trade_type LIMIT 500",
    lambda c: trades.drill(c.trades, party="D", sector="ECONOMY"),
)
add(
    "drill_day_month",
    "SELECT strftime(traded_at, '%Y-%m-%d') AS day, person_id, name, party, ticker, sector, trade_type, est, order_id, line FROM t WHERE dayofweek(traded_at) = 2 AND month(traded_at) = 3 ORDER BY day DESC, order_id DESC, line DESC, est DESC, ticker, trade_type LIMIT 500",
    lambda c: trades.drill(c.trades, dow=2, month=3),
)
LATEST = "la AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY computed_at DESC) = 1)"
add(
    "companies",
    "SELECT p_brand AS ticker, p_type AS sector, count(*) AS parts, any_value(composite) AS composite FROM part JOIN la ON la.ticker = p_brand AND composite >= 40 WHERE p_brand ILIKE '%#1%' GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 20 OFFSET 3",
    lambda c: trades.list_companies(c.companies, scores.latest_scores(c.scores), contains="#1", least=40, limit=20, offset=3), SC, LATEST,
)
add(
    "events_page",
    "SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50",
    lambda c: trades.list_events(c.read("events"), "error", "2024-01-05", "2024-01-20"),
)
add(
    "timeline",
    "SELECT * FROM (SELECT * FROM (SELECT ts AS at, 'event' AS kind, event_type AS what FROM events ORDER BY at DESC, what LIMIT 20) UNION ALL SELECT * FROM (SELECT computed_at, 'score', ticker FROM sc ORDER BY 1 DESC, 3 LIMIT 20)) ORDER BY at DESC, kind, what LIMIT 20",
    lambda c: trades.timeline(c.read("events").select(F.col("ts").alias("at"), F.col("event_type").alias("what")), c.scores), SC,
)
add("sectors", "SELECT DISTINCT sector FROM t", lambda c: trades.distinct_values(c.facts(person=False, order=False), "sector"))
SW = f"""sw AS (SELECT ticker, date_trunc('week', traded_at)::DATE AS week, count(DISTINCT person_id) AS reps, count(*) AS trades, {n_if(BUY)} AS buys, {n_if(SELL)} AS sells, {d_if("party = 'R'")} AS r_count,
 {d_if("party = 'D'")} AS d_count, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM t WHERE traded_at >= TIMESTAMP '2000-01-01' GROUP BY 1, 2 HAVING count(DISTINCT person_id) >= 4)"""
add("swarms", "SELECT * FROM sw ORDER BY week DESC, reps DESC, ticker LIMIT 100", lambda c: signals.swarms(c.facts()), SW)
SE = (
    "se AS (SELECT ticker, week, reps, (SELECT count(*) FROM t i WHERE i.ticker = sw.ticker AND i.filed_at >= week AND i.filed_at < week + INTERVAL 7 DAY) AS insider_trades, "
    f"(SELECT count(*) FROM t i WHERE i.ticker = sw.ticker AND i.{BUY} AND i.filed_at >= week AND i.filed_at < week + INTERVAL 7 DAY) AS insider_buys, "
    "round((SELECT avg(volume) FROM px p WHERE p.ticker = sw.ticker AND at >= week AND at < week + INTERVAL 7 DAY) / (SELECT avg(volume) FROM px p WHERE p.ticker = sw.ticker AND at >= week - INTERVAL 90 DAY AND at < week), 6) AS volume_ratio, "
    "round((SELECT (arg_max(price_cents, at) - arg_min(price_cents, at)) * 100.0::DOUBLE / arg_min(price_cents, at) FROM px p WHERE p.ticker = sw.ticker AND at >= week AND at < week + INTERVAL 7 DAY), 6) AS price_move FROM sw)"
)
add(
    "swarms_enriched",
    "SELECT * FROM se",
    lambda c: signals.enriched_swarms(c.trades, c.trades.select("ticker", F.col("filed_at").alias("traded_at"), "trade_type"), c.prices), PX, SW, SE,
)
_NET = "sign(r_buyers - r_sellers) * sign(d_buyers - d_sellers)"
for _mode, _weight in (("consensus", "round(total * (1 - abs(score)), 6)"), ("contrarian", "round(total * abs(score), 6)")):
    add(
        f"partisan_{_mode}",
        f"SELECT ticker, r_buyers, r_sellers, d_buyers, d_sellers, reps, score, CASE WHEN score >= 0.6 THEN 'partisan_r' WHEN score <= -0.6 THEN 'partisan_d' WHEN {_NET} < 0 THEN 'contrarian' WHEN {_NET} > 0 THEN 'consensus' ELSE 'noise' END AS kind, {_weight} AS weight "
        "FROM (SELECT *, r_buyers + r_sellers + d_buyers + d_sellers AS total, round((r_buyers + r_sellers - d_buyers - d_sellers)::DOUBLE / nullif(r_buyers + r_sellers + d_buyers + d_sellers, 0), 6) AS score FROM ("
        + "SELECT ticker, " + ", ".join(f"{d_if(f"party = '{p.upper()}' AND {x}")} AS {p}_{n}" for p in "rd" for n, x in (("buyers", BUY), ("sellers", SELL)))
        + ", count(DISTINCT person_id) AS reps FROM t GROUP BY 1)) WHERE reps >= 4 ORDER BY weight DESC, ticker LIMIT 50",
        lambda c, m=_mode: signals.partisan(c.facts(), m),
    )
add(
    "first_movers",
    f"SELECT part_id, person_id, rank::INT AS rank, buyers, first_buy, date_diff('day', lead, first_buy)::INT AS lag_days FROM (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY part_id) AS buyers, first_value(first_buy) OVER w AS lead FROM (SELECT part_id, person_id, min(traded_at) AS first_buy FROM t WHERE {BUY} GROUP BY 1, 2) WINDOW w AS (PARTITION BY part_id ORDER BY first_buy, person_id)) WHERE buyers >= 3 AND rank <= 5",
    lambda c: signals.first_movers(c.facts(company=False, person=False), "part_id"),
)
TRIPS = f"""rt AS (SELECT *, (epoch(sold_at) - epoch(traded_at))::BIGINT // 86400 AS hold_days FROM (SELECT b.person_id, b.ticker, b.traded_at, b.est, b.order_id, b.line, (SELECT min(s.traded_at) FROM t s WHERE s.person_id = b.person_id AND s.ticker = b.ticker AND s.{SELL} AND s.traded_at > b.traded_at) AS sold_at
 FROM t b WHERE b.{BUY}) WHERE sold_at IS NOT NULL)"""
add(
    "round_trips",
    "SELECT person_id, ticker, traded_at, est, order_id, line, sold_at, hold_days::INT AS hold_days FROM rt WHERE hold_days <= 90 ORDER BY hold_days, est DESC, person_id, ticker, order_id, line LIMIT 100",
    lambda c: signals.round_trips(c.facts(person=False)), TRIPS,
)
PAIR = "a.part_id = b.part_id AND a.person_id < b.person_id AND abs(date_diff('day', a.traded_at, b.traded_at)) <= 14"
add(
    "co_trader_network",
    f"SELECT a.person_id AS a, b.person_id AS b, count(DISTINCT a.part_id) AS shared FROM t a JOIN t b ON {PAIR} WHERE a.traded_at >= TIMESTAMP '1996-01-01' AND b.traded_at >= TIMESTAMP '1996-01-01' GROUP BY 1, 2 HAVING shared >= 2 ORDER BY shared DESC, 1, 2 LIMIT 500",
    lambda c: signals.co_trader_network(c.facts(company=False, person=False), since="1996-01-01"),
)
add(
    "co_traders",
    "SELECT b.person_id, count(DISTINCT a.part_id) AS shared FROM t a JOIN t b ON a.part_id = b.part_id AND a.person_id = 7 AND b.person_id <> 7 AND abs(date_diff('day', a.traded_at, b.traded_at)) <= 14 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    lambda c: signals.co_traders(c.facts(company=False, person=False), 7),
)
LAT = "lat AS (SELECT *, date_diff('day', traded_at, filed_at) AS days FROM t WHERE filed_at >= traded_at AND traded_at >= TIMESTAMP '2000-01-01')"
add(
    "latency_leaderboard",
    "SELECT person_id, name, count(*) AS trades, round(quantile_cont(days, 0.5))::INT AS median_days, round(quantile_cont(days, 0.9))::INT AS p90_days, max(days)::INT AS worst_days, arg_max(ticker, (days, ticker)) AS worst_ticker, "
    f"{n_if('days > 45')} AS late, round({n_if('days > 45')} * 100.0::DOUBLE / count(*), 4) AS late_pct FROM lat GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY median_days DESC, late_pct DESC, trades DESC, person_id LIMIT 50",
    lambda c: signals.latency_leaderboard(c.facts()), LAT,
)
add(
    "latency_summary",
    f"SELECT count(*) AS trades, count(DISTINCT person_id) AS persons, round(quantile_cont(days, 0.5), 4) AS p50, round(quantile_cont(days, 0.9), 4) AS p90, {n_if('days > 45')} AS late FROM lat",
    lambda c: signals.latency_summary(c.facts(company=False, person=False)), LAT,
)


def _events(c: Catalog) -> DataFrame:
    """Company events: events' users are parts, moved to the years of the trades."""
    return c.read("events").select(F.col("user_id").alias("part_id"), F.expr("date_trunc('day', ts) - make_interval(24)").alias("at"), "event_type")


EV = "ev AS (SELECT user_id AS part_id, date_trunc('day', ts)::TIMESTAMP - INTERVAL 24 YEAR AS at, event_type FROM events)"
_TRIP_PART = "CASE WHEN {n} > 0 THEN least(100, 30 + {k} * log2(greatest({n}, 1))) ELSE 0 END"
ACCOUNTABLE = (
    "SELECT *, round(0.30 * greatest(0, least(100, median_days - 20.0)) + 0.10 * greatest(0, least(100, coalesce(late::DOUBLE / nullif(scoreable, 0), 0) * 100)) + 0.25 * greatest(0, least(100, committee_trades::DOUBLE / trades / 0.5 * 100)) + "
    f"0.20 * {_TRIP_PART.format(n='round_trips', k=40)} + 0.15 * {_TRIP_PART.format(n='pre_events', k=45)}, 8) AS score FROM (SELECT b.person_id, trades, committee_trades, coalesce(scoreable, 0) AS scoreable, coalesce(late, 0) AS late, coalesce(median_days, 0)::DOUBLE AS median_days, "
    "coalesce(round_trips, 0) AS round_trips, coalesce(pre_events, 0) AS pre_events, round(coalesce(late::DOUBLE / nullif(scoreable, 0), 0), 6) AS late_pct FROM "
    f"(SELECT person_id, count(*) AS trades, {n_if(RULE_SQL)} AS committee_trades FROM t GROUP BY 1 HAVING count(*) >= 5) b LEFT JOIN (SELECT person_id, count(*) AS scoreable, {n_if('days > 45')} AS late, quantile_cont(days, 0.5) AS median_days FROM lat GROUP BY 1) l USING (person_id) "
    f"LEFT JOIN (SELECT b.person_id, count(*) AS round_trips FROM t b JOIN t s ON b.person_id = s.person_id AND b.ticker = s.ticker AND b.{BUY} AND s.{SELL} AND date_diff('day', b.traded_at, s.traded_at) BETWEEN 1 AND 60 GROUP BY 1) r USING (person_id) "
    "LEFT JOIN (SELECT person_id, count(DISTINCT (order_id, line, t.part_id, est)) AS pre_events FROM t JOIN ev ON t.part_id = ev.part_id AND date_diff('day', traded_at, at) BETWEEN 1 AND 14 GROUP BY 1) p USING (person_id))"
)
add("accountability", ACCOUNTABLE, lambda c: signals.accountability(c.facts(), _events(c), RULES), LAT, EV)
add("score_backfill", "SELECT * FROM sc", lambda c: c.scores, SC)
add("score_rankings", "SELECT * FROM la ORDER BY composite DESC, ticker LIMIT 50", lambda c: scores.rankings(c.scores), SC, LATEST)
add(
    "score_movers",
    "SELECT ticker, composite AS current, previous, round(composite - previous, 4) AS delta, abs(round(composite - previous, 4)) AS change FROM (SELECT *, lag(composite) OVER (PARTITION BY ticker ORDER BY computed_at) AS previous FROM sc) WHERE computed_at >= TIMESTAMP '2000-06-01' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY computed_at DESC) = 1 ORDER BY change DESC, ticker LIMIT 20",
    lambda c: scores.movers(c.scores, "2000-06-01"), SC,
)
add(
    "score_sector_heat",
    "SELECT sector, count(*) AS tickers, round(avg(composite), 4) AS composite FROM la JOIN (SELECT DISTINCT p_brand AS ticker, p_type AS sector FROM part) USING (ticker) GROUP BY 1",
    lambda c: scores.sector_heat(c.scores, c.companies), SC, LATEST,
)
add(
    "market_score",
    "SELECT ticker, round(0.30 * CASE WHEN n < 2 OR a = 0 THEN 50.0 ELSE greatest(0, least(100, ((b - a)::DOUBLE / a + 0.1) / 0.2 * 100)) END + 0.30 * greatest(0, least(100, (lv::DOUBLE / av - 0.5) / 1.5 * 100)) + 0.40 * CASE WHEN i <= 0 THEN 50.0 WHEN i <= 2 THEN 60 WHEN i <= 5 THEN 75 ELSE 90 END, 4) AS market "
    "FROM (SELECT ticker, count(*) AS n, arg_min(price_cents, at) AS a, arg_max(price_cents, at) AS b FROM (SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY at DESC) <= 5) GROUP BY 1) "
    "JOIN (SELECT ticker, arg_max(volume, at) AS lv, avg(volume) AS av FROM px GROUP BY 1) USING (ticker) JOIN (SELECT ticker, count(*) AS i FROM t GROUP BY 1) USING (ticker)",
    lambda c: scores.market_score(c.prices, c.trades), PX,
)
add(
    "asof_prices",
    "SELECT b.person_id, b.ticker, b.traded_at, b.order_id, b.line, p.price_cents, p.at AS matched_at FROM (SELECT person_id, ticker, filed_at AS traded_at, order_id, line FROM t) b ASOF JOIN px p ON b.ticker = p.ticker AND p.at <= b.traded_at",
    lambda c: asof_join(c.trades.select("person_id", "ticker", F.col("filed_at").alias("traded_at"), "order_id", "line"), c.prices, ["ticker"], "traded_at", "at", ["price_cents"]).filter("matched_at is not null"), PX,
)


#: Where a finding's SQL takes the columns of its data.
_DATA = "/*data*/"
_TEXTS = ("committee", "trade_type")


def _spread(df: DataFrame, names: list[str]) -> DataFrame:
    """Findings with their data in columns of their own."""
    values = [F.get_json_object("data", f"$.{n}").cast("string" if n in _TEXTS else "double").alias(f"d_{n}") for n in names]
    return df.select("kind", "subject", "ticker", "at", "rarity", *values)


def finding(kind: str, subject: str, ticker: str, at: str, rarity: str, rest: str) -> str:
    return f"SELECT '{kind}' AS kind, ({subject})::VARCHAR AS subject, ({ticker})::VARCHAR AS ticker, ({at})::TIMESTAMP AS at, round(greatest(0.0, least(100.0, ({rarity})::DOUBLE)), 4) AS rarity{_DATA} {rest}"


def _with_data(sql: str, data: dict[str, str]) -> str:
    return sql.replace(_DATA, "".join(f", ({x})::{'VARCHAR' if n in _TEXTS else 'DOUBLE'} AS d_{n}" for n, x in data.items()))


def size_bonus(a: float, b: float, c: float) -> str:
    return f"CASE WHEN est >= 250000 THEN {c} WHEN est >= 50000 THEN {b} ELSE {a} END"


WEEK = "date_trunc('week', traded_at)::DATE"
NEAR = "(SELECT person_id, t.part_id, traded_at, min(date_diff('day', traded_at, at)) AS gap, max(est) AS est FROM t JOIN ev ON t.part_id = ev.part_id AND date_diff('day', traded_at, at) BETWEEN 1 AND {k} {where} GROUP BY ALL)"
GAIN = f"""en AS (SELECT b.*, p.price_cents AS entry FROM (SELECT person_id, ticker, traded_at, filed_at, traded_at + INTERVAL 25 DAY AS due FROM t WHERE {BUY}) b ASOF JOIN px p ON b.ticker = p.ticker AND p.at <= b.traded_at),
 ex AS (SELECT en.*, p.price_cents AS out_price, p.at AS out_at FROM en ASOF JOIN px p ON en.ticker = p.ticker AND p.at >= en.due)"""
DETECTORS: dict[str, tuple[Callable[[Catalog], DataFrame], str, tuple[str, ...]]] = {
    "coordinated": (
        lambda c: insights.coordinated(c.trades, "part_id"),
        finding("coordinated_trades", "''", "part_id", "week", "40 + 20 * log2(reps - 2) + CASE WHEN kinds = 1 THEN 10 ELSE 0 END", f"FROM (SELECT part_id, {WEEK} AS week, count(DISTINCT name) AS reps, count(DISTINCT trade_type) AS kinds FROM t GROUP BY 1, 2) WHERE reps >= 3"),
        (),
    ),
    "committee": (
        lambda c: insights.committee_relevant(c.trades, RULES),
        finding("committee_relevant", "person_id", "ticker", "day", size_bonus(70, 80, 90), f"FROM (SELECT person_id, ticker, traded_at::DATE AS day, max(est) AS est, min(committee) AS committee FROM t WHERE {RULE_SQL} GROUP BY ALL)"),
        (),
    ),
    "pre_event": (
        lambda c: insights.pre_event(c.trades, _events(c), cut=c.cut),
        finding("pre_event", "person_id", "part_id", "traded_at", f"60 + (14 - gap) * 3 + {size_bonus(0, 3, 5)}", "FROM " + NEAR.format(k=14, where="")),
        (EV,),
    ),
    "court_trade": (
        lambda c: insights.court_trade(c.trades, _events(c).filter("event_type = 'error'"), c.cut),
        finding("court_trade", "person_id", "part_id", "traded_at", f"60 + (14 - gap) * 3 + {size_bonus(0, 3, 5)}", "FROM " + NEAR.format(k=14, where="WHERE event_type = 'error'")),
        (EV,),
    ),
    "round_trip": (
        lambda c: insights.quick_round_trip(c.trades),
        finding("round_trip", "person_id", "ticker", "sold_at", "r", "FROM (SELECT *, CASE WHEN usual IS NULL THEN CASE WHEN hold_days <= 14 THEN 60 + (14 - hold_days) * 2 END WHEN (usual - hold_days)::DOUBLE / usual > 0.3 THEN 50 + (usual - hold_days)::DOUBLE / usual * 50 END AS r "
                "FROM rt LEFT JOIN (SELECT person_id, list_sort(list(hold_days))[count(*) // 2 + 1] AS usual FROM rt WHERE hold_days <= 365 GROUP BY 1 HAVING count(*) >= 5) USING (person_id) WHERE hold_days <= 30 AND est >= 10000) WHERE r IS NOT NULL"),
        (TRIPS,),
    ),
    "swarm_outlier": (
        lambda c: insights.swarm_outlier(c.trades, c.trades.select("ticker", F.col("filed_at").alias("traded_at"), "trade_type"), c.prices),
        finding("swarm_outlier", "''", "ticker", "week", "r", "FROM (SELECT ticker, max(week) AS week, sum(reps) AS x_reps, count(*) AS x_weeks, sum(insider_trades) AS x_insider, count(*) FILTER (WHERE volume_ratio < 1.5) AS x_low, 30 + 5 * sum(reps) + 10 * count(*) + CASE WHEN sum(insider_trades) > 0 THEN 10 ELSE 0 END + 5 * count(*) FILTER (WHERE volume_ratio < 1.5) AS r FROM se GROUP BY ticker) WHERE r >= 50"),
        (PX, SW, SE),
    ),
    "lone_wolf": (
        lambda c: insights.lone_wolf(c.trades),
        finding("lone_wolf", "person_id", "ticker", "traded_at", "50 + 25 * log10(est::DOUBLE / middle)", "FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY est DESC, traded_at DESC, ticker, order_id, line) AS r FROM t) "
                "JOIN (SELECT person_id, list_sort(list(est))[count(*) // 2 + 1] AS middle FROM t WHERE est > 0 GROUP BY 1 HAVING count(*) >= 5) USING (person_id) WHERE r <= 3 AND est::DOUBLE / middle >= 4"),
        (),
    ),
    "copy_trader": (
        lambda c: insights.copy_trader(c.trades, c.prices),
        finding("copy_trader", "person_id", "''", "last", "50 + 3 * gain", "FROM (SELECT person_id, count(*) AS n, round(avg((out_price - entry) * 100.0::DOUBLE / entry), 4) AS gain, max(traded_at) AS last FROM ex WHERE out_at < traded_at + INTERVAL 35 DAY AND entry > 0 AND out_price > 0 GROUP BY 1) WHERE n >= 3 AND gain > 0"),
        (PX, GAIN),
    ),
    "sector_rotation": (
        lambda c: insights.sector_rotation(c.trades, "2000-08-15"),
        finding("sector_rotation", "''", "sector", "TIMESTAMP '2000-08-15'", "50 + 2 * abs(shift)", f"FROM (SELECT sector, new, old, round(new * 100.0::DOUBLE / nullif(sum(new) OVER (), 0)::DOUBLE - old * 100.0::DOUBLE / nullif(sum(old) OVER (), 0)::DOUBLE, 4) AS shift FROM (SELECT sector, coalesce(sum(est) FILTER (WHERE {BUY} AND traded_at >= TIMESTAMP '2000-08-01'), 0)::BIGINT AS new, coalesce(sum(est) FILTER (WHERE {BUY} AND traded_at < TIMESTAMP '2000-08-01'), 0)::BIGINT AS old "
                "FROM t WHERE traded_at >= TIMESTAMP '2000-04-15' AND traded_at < TIMESTAMP '2000-08-16' GROUP BY 1)) WHERE abs(shift) >= 10"),
        (),
    ),
    "late_profitable": (
        lambda c: insights.late_profitable(c.trades, c.prices),
        finding("late_profitable", "person_id", "ticker", "filed_at", "50 + delay / 5.0 + 2 * pct", "FROM (SELECT *, round((b - a) * 100.0::DOUBLE / a, 4) AS pct FROM (SELECT en.person_id, en.ticker, en.filed_at, date_diff('day', en.traded_at, en.filed_at) AS delay, entry AS a, p.price_cents AS b FROM en ASOF JOIN px p ON en.ticker = p.ticker AND p.at <= en.filed_at WHERE date_diff('day', en.traded_at, en.filed_at) > 45) WHERE a > 0 AND b > a)"),
        (PX, GAIN),
    ),
    "quiet_accumulation": (
        lambda c: insights.quiet_accumulation(c.trades),
        finding("quiet_accumulation", "person_id", "ticker", "last", "40 + 10 * n + total / 50000.0", f"FROM (SELECT person_id, ticker, count(*) AS n, max(traded_at) AS last, date_diff('day', min(traded_at), max(traded_at)) AS span, sum(est)::BIGINT AS total, avg(est) AS mean FROM t WHERE {BUY} GROUP BY 1, 2) WHERE n >= 3 AND span BETWEEN 1 AND 60 AND mean > 0 AND mean < 50000"),
        (),
    ),
    "committee_insider": (
        lambda c: insights.committee_insider(c.trades, _events(c), RULES, cut=c.cut),
        finding("committee_insider", "person_id", "part_id", "traded_at", f"70 + 5 * (7 - gap) + {size_bonus(0, 5, 10)}", "FROM " + NEAR.format(k=7, where="WHERE " + RULE_SQL)),
        (EV,),
    ),
    "bipartisan": (
        lambda c: insights.bipartisan(c.trades, "part_id"),
        finding("bipartisan_convergence", "''", "part_id", "week", "50 + 8 * n + CASE WHEN buys = 0 OR sells = 0 THEN 15 ELSE 0 END", f"FROM (SELECT part_id, {WEEK} AS week, {d_if("party = 'R'")} AS r, {d_if("party = 'D'")} AS d, count(DISTINCT person_id) AS n, {n_if(BUY)} AS buys, {n_if(SELL)} AS sells FROM t GROUP BY 1, 2) WHERE r >= 1 AND d >= 1 AND n >= 3"),
        (),
    ),
    "insider_echo": (
        lambda c: insights.insider_echo(c.trades, c.trades.select("part_id", F.col("filed_at").alias("traded_at"), "trade_type"), cut=c.cut),
        finding("insider_echo", "person_id", "part_id", "traded_at", "55 + 3 * (14 - gap) + 10 * same", f"FROM (SELECT a.person_id, a.part_id, a.traded_at, min(abs(date_diff('day', a.traded_at, b.filed_at))) AS gap, arg_min((a.{BUY} = (b.{BUY}))::INT, (abs(date_diff('day', a.traded_at, b.filed_at)), -((a.{BUY}) = (b.{BUY}))::INT)) AS same FROM t a JOIN t b ON a.part_id = b.part_id AND abs(date_diff('day', a.traded_at, b.filed_at)) <= 14 GROUP BY ALL)".replace(f"(a.{BUY} = (b.{BUY}))::INT", f"((a.{BUY}) = (b.{BUY}))::INT")),
        (),
    ),
}
#: What a finding's data holds, and its SQL.
DATA = {
    "coordinated": {"reps": "reps", "kinds": "kinds"},
    "committee": {"est": "est", "committee": "committee"},
    "pre_event": {"gap": "gap", "est": "est"},
    "court_trade": {"gap": "gap", "est": "est"},
    "round_trip": {"hold_days": "hold_days", "est": "est", "usual": "usual"},
    "swarm_outlier": {"reps": "x_reps", "weeks": "x_weeks", "insider_trades": "x_insider", "low_volume_weeks": "x_low"},
    "lone_wolf": {"est": "est", "middle": "middle", "trade_type": "trade_type"},
    "copy_trader": {"trades": "n", "gain": "gain"},
    "sector_rotation": {"shift": "shift", "new": "new", "old": "old"},
    "late_profitable": {"delay": "delay", "pct": "pct"},
    "quiet_accumulation": {"buys": "n", "span": "span", "total": "total"},
    "committee_insider": {"gap": "gap", "est": "est"},
    "bipartisan": {"r": "r", "d": "d", "n": "n"},
    "insider_echo": {"gap": "gap", "same": "same"},
}
for _name, (_build, _sql, _tables) in DETECTORS.items():
    add(f"detect_{_name}", _with_data(_sql, DATA[_name]), lambda c, b=_build, d=tuple(DATA[_name]): _spread(b(c), d), *_tables)
_ALL = tuple(dict.fromkeys(x for _, _, ts in DETECTORS.values() for x in ts))


#: Columns of trades that detectors read.
DETECTED = ("person_id", "name", "party", "committee", "ticker", "sector", "part_id", "trade_type", "est", "traded_at", "filed_at", "order_id", "line")


def _detected(c: Catalog, **more: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All detectors over one table of trades, however long they take."""
    shared, kept = c.by_company(f"{shared_root(c.spark)}/once-{uuid.uuid4().hex}", DETECTED)
    try:
        return detect.detect(c.spark, {name: lambda b=b: b(shared) for name, (b, _, _) in DETECTORS.items()} | more, None)
    finally:
        kept.unpersist()


def _refuses() -> DataFrame:
    raise RuntimeError("this detector always fails")


add(
    "findings_ranked",
    "SELECT *, round(0.4 * rarity + 60 * pow(0.5, greatest(0, " + DAYS.format(a="at", b=f"TIMESTAMP '{AS_OF}'") + ") / 30), 4) AS blend FROM (" + " UNION ALL ".join(f"({_with_data(s, {})})" for _, s, _ in DETECTORS.values()) + ") ORDER BY blend DESC, kind, subject, ticker, at LIMIT 20",
    lambda c: insights.ranked([detect.whole(*_detected(c)).drop("data")], AS_OF), *_ALL,
)
add(
    "detector_status",
    " UNION ALL ".join(f"SELECT '{n}' AS detector, TRUE AS ok, count(*) AS findings FROM ({_with_data(s, {})})" for n, (_, s, _) in DETECTORS.items()) + " UNION ALL SELECT 'failing', FALSE, 0",
    lambda c: detect.summary(_detected(c, failing=_refuses)[1]), *_ALL,
)
_DOLLARS = "CASE WHEN est >= 1e6 THEN printf('%.1fM', est / 1e6) WHEN est >= 1e3 THEN round(est / 1000.0)::BIGINT || 'K' ELSE est::VARCHAR END"


_WHO = "'person ' || subject || "
_PROOFS = {
    "committee": (("at", "trade", f"{_WHO}' traded ' || ticker || ' (committee: ' || d_committee || ')'"),),
    "lone_wolf": (("at", "trade", f"{_WHO}' outsized ' || d_trade_type || ' ' || ticker || ' (' || printf('%.1f', round(d_est / d_middle, 1)) || ' times the usual)'"),),
    "round_trip": (("at::DATE - d_hold_days::INT", "trade", f"{_WHO}' buy ' || ticker || ' ($' || {_DOLLARS.replace('est', 'd_est::BIGINT')} || ')'"), ("at", "trade", f"{_WHO}' sell ' || ticker")),
    "pre_event": (("at", "trade", f"{_WHO}' traded ' || ticker || ' ($' || {_DOLLARS.replace('est', 'd_est::BIGINT')} || ')'"), ("at::DATE + d_gap::INT", "event", "'event of ' || ticker")),
}
for _name, _steps in _PROOFS.items():
    _rows = _with_data(DETECTORS[_name][1], DATA[_name])
    _made = " UNION ALL ".join(f"SELECT kind, subject, ticker, at, {k}::INT AS place, ({date})::DATE AS date, '{step}' AS step, {label} AS label FROM f" for k, (date, step, label) in enumerate(_steps, 1))
    add(f"proof_{_name}", _made, lambda c, b=DETECTORS[_name][0]: insights.proof_steps(b(c)), *DETECTORS[_name][2], f"f AS ({_rows})")
add(
    "company_timeline",
    "SELECT kind, subject, ticker, at, 1 AS place, at::DATE AS date, 'cluster' AS step, d_reps::BIGINT || ' persons traded ' || ticker AS label FROM f",
    lambda c: insights.proof_steps(insights.coordinated(c.facts(), "part_id")), f"f AS ({_with_data(DETECTORS['coordinated'][1], DATA['coordinated'])})",
)
add("scoreboard", f"SELECT person_id, floor(score)::INT AS score, trades FROM ({ACCOUNTABLE}) ORDER BY score DESC, trades DESC, person_id LIMIT 100", lambda c: scores.scoreboard(signals.accountability(c.facts(), _events(c), RULES)), LAT, EV)


fql_queries.register(add, SW)
more_queries.register(add)
stream_queries.register(add)
feed_queries.register(add)


def _edges(c: Catalog) -> DataFrame:
    return c.read("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b")).unionByName(
        c.read("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    )


_LEVEL = "n{k} AS (SELECT DISTINCT x.b AS node FROM e2 x JOIN n{j} ON x.a = n{j}.node WHERE x.b NOT IN (SELECT node FROM n0{more}))"
add(
    "graph_bfs",
    "WITH e AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n0 AS (SELECT 'c7' AS node), "
    + _LEVEL.format(k=1, j=0, more="") + ", " + _LEVEL.format(k=2, j=1, more=" UNION ALL SELECT node FROM n1")
    + " SELECT node, 0 AS level FROM n0 UNION ALL (SELECT node, 1 FROM n1 ORDER BY node LIMIT 199) UNION ALL (SELECT node, 2 FROM n2 ORDER BY node LIMIT 100)",
    lambda c: graph.bfs(_edges(c), "c7", 2, 200),
)
def _network(c: Catalog) -> tuple[graph_many.Graph, DataFrame]:
    """The catalog's network, and the customers of one country as starts."""
    return graph_many.Graph(*c.links()), c.read("customer").filter("c_nationkey = 7").select(F.concat(F.lit("c"), "c_custkey").alias("node"))


def _reached(c: Catalog, edges: bool) -> DataFrame:
    network, starts = _network(c)
    seen = network.search(starts, 2, 25)
    return network.between(seen) if edges else network.named(seen)


NETWORK = """WITH e AS (SELECT 'o' || o_orderkey AS x, 'c' || o_custkey AS y, 'placed' AS relationship FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey, l_returnflag FROM lineitem),
lb AS (SELECT 'c' || c_custkey AS node, c_name AS label FROM customer UNION ALL SELECT 'p' || p_partkey, p_name FROM part UNION ALL SELECT 'o' || o_orderkey, 'order ' || o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
e2 AS (SELECT DISTINCT a, b FROM (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e) WHERE b IN (SELECT node FROM lb)),
n0 AS (SELECT 'c' || c_custkey AS source, 'c' || c_custkey AS node, 0 AS level FROM customer WHERE c_nationkey = 7),
{levels}
seen AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2) """
_REACH = """n{k} AS (SELECT f.source, f.node, {k} AS level FROM (SELECT DISTINCT n{j}.source, e2.b AS node FROM n{j} JOIN e2 ON e2.a = n{j}.node) f ANTI JOIN ({seen}) s ON s.source = f.source AND s.node = f.node
 JOIN (SELECT source, count(*) AS had FROM ({seen}) GROUP BY 1) h ON h.source = f.source QUALIFY row_number() OVER (PARTITION BY f.source ORDER BY f.node) <= 25 - had),"""
NETWORK = NETWORK.replace("{levels}", _REACH.format(k=1, j=0, seen="SELECT * FROM n0") + _REACH.format(k=2, j=1, seen="SELECT * FROM n0 UNION ALL SELECT * FROM n1"))
add("graph_many_nodes", NETWORK + "SELECT source, seen.node, level, label FROM seen LEFT JOIN lb ON lb.node = seen.node", lambda c: _reached(c, False))
add("graph_many_edges", NETWORK + "SELECT s.source, least(x, y) AS a, greatest(x, y) AS b, relationship FROM e JOIN seen s ON s.node = x JOIN seen u ON u.source = s.source AND u.node = y", lambda c: _reached(c, True))
add(
    "stream_weekly_counts",
    "WITH x AS (SELECT 1) SELECT event_type, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') AS week, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    lambda c: streams.weekly_counts(c.spark, c.directory),
)
add(
    "stream_dedupe",
    "WITH x AS (SELECT 1) SELECT event_id, ts, user_id, event_type FROM events",
    lambda c: streams.deduplicated(c.spark, c.directory),
)
add("rebalanced_symbols", "SELECT ticker FROM la ORDER BY composite DESC, ticker LIMIT 30", lambda c: streams.top_symbols(scores.latest_scores(c.scores)), SC, LATEST)
add(
    "signal_lists",
    f"SELECT DISTINCT 'swarms' AS signal, ticker FROM sw WHERE reps >= 8 UNION ALL SELECT DISTINCT 'partisan-consensus', ticker FROM ({SQL['partisan_consensus']}) UNION ALL SELECT DISTINCT 'round-trips', ticker FROM rt WHERE hold_days <= 3",
    more_queries.signal_lists, SW, TRIPS,
)
add(
    "stream_interval_join",
    "WITH x AS (SELECT 1) SELECT s.user_id AS k, s.ts AS a, p.ts AS b FROM events s JOIN events p ON s.event_type = 'signup' AND p.event_type = 'purchase' AND s.user_id = p.user_id AND p.ts >= s.ts + INTERVAL 1 DAY AND p.ts <= s.ts + INTERVAL 14 DAY",
    lambda c: streams.pairs_in_time(c.spark, c.directory, "signup", "purchase"),
)
#: Published datasets: the query whose rows they are, and what their files are ordered by.
PUBLISHED = {
    "movers": ("score_movers", ()), "rankings": ("score_rankings", ()), "events-latest": ("events_page", ()), "sources": ("freshness", ()), "stats": ("activity", ()),
    "heatmap-day-month": ("heat_day_month", ()), "heatmap-party-sector": ("heat_party_sector", ()), "heatmap-person-month": ("heat_person_month", ()), "heatmap-person-ticker": ("heat_person_ticker", ()),
    "companies": ("companies", ("ticker",)), "persons": ("persons_by_influence", ()), "signals-swarms": ("swarms", ()), "signals-consensus": ("partisan_consensus", ()), "signals-contrarian": ("partisan_contrarian", ()),
    "signals-first-movers": ("first_movers", ("part_id",)), "signals-round-trips": ("round_trips", ()), "signals-latency": ("latency_leaderboard", ()), "signals-latency-summary": ("latency_summary", ()),
    "insights": ("findings_ranked", ()), "tickers": ("top_tickers", ()), "lobbying": ("lobbying_list", ()), "network": ("co_trader_network", ()), "scoreboard": ("scoreboard", ()), "company-scores": ("score_backfill", ("ticker", "computed_at")),
    "company-contributors": ("score_breakdown", ("ticker",)), "person-headlines": ("person_headline", ("person_id",)), "person-tickers": ("person_top_tickers", ("person_id",)), "person-flow": ("net_flow", ("person_id",)), "query-index": ("sectors", ()),
}


def _published(c: Catalog) -> DataFrame:
    root = f"{shared_root(c.spark)}/published-{uuid.uuid4().hex}"
    shared = c.once(f"{root}-facts")
    return datasets.publish(shared, {n: datasets.Dataset(BUILDS[q], order) for n, (q, order) in PUBLISHED.items()}, root).select("dataset", "rows")


add("published_manifest", "WITH x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS rows FROM ({SQL[q]})" for n, (q, _) in PUBLISHED.items()), _published)


def _sketched(c: Catalog) -> DataFrame:
    """Persons and amounts by ticker and quarter from weekly sketches: a week belongs to the quarter of its Monday."""
    own = c.facts(person=False).select("ticker", "person_id", "est", "traded_at")
    quarter = F.date_trunc("quarter", F.col("week")).cast("date").alias("quarter")
    made, path = sketches.weekly(own), f"{shared_root(c.spark)}/sketches-{uuid.uuid4().hex}"
    made.write.parquet(path)
    kept = c.spark.read.schema(made.schema).parquet(path)
    spans = sketches.estimates(sketches.merged(kept, "ticker", quarter), 0.5, 0.9)
    monday = F.date_trunc("quarter", F.date_trunc("week", "traded_at")).cast("date").alias("quarter")
    return sketches.checked(own, spans, [F.col("ticker"), monday], (0.5, 0.9), kept.agg(F.sum("trades")).first()[0] or 0).drop("estimate")


add(
    "sketch_quarters",
    "SELECT ticker, date_trunc('quarter', date_trunc('week', traded_at))::DATE AS quarter, count(*) AS trades, count(DISTINCT person_id) AS persons, TRUE AS persons_within, TRUE AS quantiles_within FROM t GROUP BY 1, 2",
    _sketched,
)
#: Payloads of several shapes made of the events' own.
_SHAPED = "CASE event_id % 5 WHEN 1 THEN replace(replace(props, ': ', ': ['), '}', ', 7]}') WHEN 2 THEN replace(props, '}', '') WHEN 3 THEN replace(replace(props, ': ', ': \"'), '}', '\"}') ELSE props END"


def _shaped(c: Catalog) -> DataFrame:
    rows = variant.with_variant(c.read("events").select("event_type", F.expr(_SHAPED.replace('\"', '"')).alias("payload")), "payload")
    k = variant.first_of("v", "k", "bigint")
    return rows.groupBy("event_type").agg(
        F.count("payload").alias("payloads"), F.count_if(variant.malformed("payload")).alias("malformed"), F.sum(k).alias("total"), F.count_if(k.isNull()).alias("missing"),
        F.sum(F.size(variant.all_of("v", "k", "bigint"))).alias("values"), F.schema_of_variant_agg("v").alias("shape"),
    )


add(
    "variant_payloads",
    "WITH e AS (SELECT event_type, event_id % 5 AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS payloads, count(*) FILTER (WHERE kind = 2) AS malformed, "
    "sum(k) FILTER (WHERE kind <> 2)::BIGINT AS total, count(*) FILTER (WHERE kind = 2) AS missing, (count(*) FILTER (WHERE kind <> 2) + count(*) FILTER (WHERE kind = 1))::BIGINT AS values, 'OBJECT<k: VARIANT>' AS shape FROM e GROUP BY 1",
    _shaped,
)
