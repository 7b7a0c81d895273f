"""One object with a method for each operator, over the tables of a directory. Methods return DataFrames; ``fql`` returns a result with warnings and cursor."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detect, graph, graph_many, insights, lookups, profiles, scores, signals, trades
from .plans import fql
from .plans.mapping import AS_OF, Catalog
from .streaming import streams
from .streaming.loads import shared_root


class Engine:
    def __init__(self, spark: SparkSession, directory: str, as_of: str = AS_OF, data_as_of: str = ""):
        self.catalog, self.as_of, self.data_as_of = Catalog(spark, directory), as_of, data_as_of

    # companies
    def companies(self, sector: str | None = None, contains: str | None = None, least: float | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        limit, offset = lookups.page_of(limit, offset)
        return trades.list_companies(self.catalog.companies, self.latest_scores(), sector, contains, least, limit, offset)

    def company(self, ticker: str) -> DataFrame:
        return lookups.lookup(self.catalog.companies, "ticker", ticker)

    def company_scores(self, ticker: str) -> DataFrame:
        return lookups.lookup(self.catalog.scores, "ticker", ticker).orderBy(F.desc("computed_at"))

    def company_events(self, ticker: str, since: dt.datetime, until: dt.datetime) -> DataFrame:
        since, until = lookups.time_range(since, until)
        events = self.catalog.happenings.join(self.catalog.companies.select("part_id", "ticker"), "part_id").filter(F.col("ticker") == ticker)
        return events.filter((F.col("at") >= F.lit(since)) & (F.col("at") < F.lit(until))).orderBy(F.desc("at"), F.desc("event_id"))

    def score_breakdown(self, ticker: str, n: int = 5) -> DataFrame:
        own = self.catalog.facts(person=False).filter(F.col("ticker") == ticker)
        prices = self.catalog.prices.filter(F.col("ticker") == ticker)
        return lookups.score_breakdown([
            lookups.top_contributors(own, F.abs(F.col("est")), "insider", F.col("trade_type"), n, "traded_at", "order_id", "line"),
            lookups.top_contributors(prices, F.abs(F.col("volume")), "market", F.col("price_cents"), n, "at"),
        ])

    def timeline(self, ticker: str, top: int = 20) -> DataFrame:
        events = self.catalog.happenings.join(self.catalog.companies.select("part_id", "ticker"), "part_id").filter(F.col("ticker") == ticker)
        return trades.timeline(events.select("at", F.col("event_type").alias("what")), self.catalog.scores.filter(F.col("ticker") == ticker), top)

    # events and scores
    def events(self, kind: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
        return trades.list_events(self.catalog.read("events"), kind, since, until, lookups.page_of(limit)[0])

    def event(self, event_id: int) -> DataFrame:
        return lookups.lookup(self.catalog.read("events"), "event_id", event_id)

    def latest_scores(self) -> DataFrame:
        return scores.latest_scores(self.catalog.scores)

    def rankings(self, limit: int = 50) -> DataFrame:
        return scores.rankings(self.catalog.scores, limit)

    def movers(self, since: str, limit: int = 20) -> DataFrame:
        return scores.movers(self.catalog.scores, since, limit)

    def sector_heatmap(self) -> DataFrame:
        return scores.sector_heat(self.catalog.scores, self.catalog.companies)

    def market_scores(self) -> DataFrame:
        return scores.market_score(self.catalog.prices, self.catalog.facts(person=False))

    # persons
    def persons(self, sort: str = "name", limit: int | None = None, offset: int | None = None, **equal: object) -> DataFrame:
        limit, offset = lookups.page_of(limit, offset)
        totals = lookups.person_totals(self.catalog.facts(person=False)) if sort == "influence" else None
        return lookups.list_persons_by(self.catalog.persons, totals, sort, limit, offset, **equal)

    def person(self, slug: str) -> DataFrame:
        return lookups.lookup(self.catalog.persons, "slug", slug)

    def profile(self, slug: str) -> dict[str, DataFrame]:
        """A person's parts of the profile; each is the bulk plan with a filter that reaches the scans."""
        facts = self.catalog.facts().filter(F.col("slug") == slug)
        return {
            "headline": trades.person_headline(facts), "top_tickers": trades.person_top_tickers(facts), "net_flow": trades.net_flow(facts), "owners": trades.owner_split(facts, F.col("owner")),
            "latency": signals.latency_leaderboard(facts, 1), "round_trips": signals.round_trips(facts),
            "summary": profiles.summaries(facts), "biggest_trade": profiles.biggest_trades(facts), "party": profiles.party_history(facts), "committees": self.person(slug).select("person_id", "committee"),
            "solo_tickers": profiles.solo_top(self.catalog.facts(person=False), "part_id").join(self.person(slug).select("person_id"), "person_id", "left_semi"),
            "swarms": signals.swarms(self.catalog.facts(), 4, None).join(facts.select("ticker").distinct(), "ticker", "left_semi").agg(F.count("*").alias("swarms")),
        }

    def co_traders(self, person_id: int, days: int = 14, limit: int = 25) -> DataFrame:
        return signals.co_traders(self.catalog.facts(company=False, person=False), person_id, days=days, limit=limit)

    def connections(self, start: str, depth: int = 2, budget: int = 200, edges: DataFrame | None = None) -> DataFrame:
        """What is reached from a node of the catalog's network, or of other edges (a, b)."""
        return graph.bfs(self.catalog.links()[0] if edges is None else edges, start, depth, budget)

    def connections_of(self, starts: DataFrame, depth: int = 2, budget: int = 200) -> dict[str, DataFrame]:
        """Nodes with labels and edges of a search from each of many nodes (column node)."""
        network = graph_many.Graph(*self.catalog.links())
        seen = network.search(starts, depth, budget)
        return {"nodes": network.named(seen), "edges": network.between(seen)}

    def co_trader_network(self, least: int = 2, since: str | None = None) -> DataFrame:
        return signals.co_trader_network(self.catalog.facts(company=False, person=False), least=least, since=since)

    def network(self, least: int = 2, since: str | None = None) -> dict[str, DataFrame]:
        nodes, edges = profiles.labelled_network(self.co_trader_network(least, since), self.catalog.persons)
        return {"nodes": nodes, "edges": edges}

    # sources and streams
    def sources(self, now: str) -> DataFrame:
        """Sources with their state and the grade of their freshness at a time."""
        return trades.freshness(self.catalog.source_meta, F.lit(now).cast("timestamp"))

    def stream(self, kind: str | None = None, part_id: int | None = None) -> DataFrame:
        """Events as they come, all or those of a kind or a company: a streaming DataFrame."""
        events = streams.event_stream(self.catalog.spark, self.catalog.directory)
        if kind is not None:
            events = events.filter(F.col("event_type") == kind)
        return events if part_id is None else events.filter(F.col("user_id") == part_id)

    # statistics
    def activity(self, days: int = 365) -> DataFrame:
        return trades.activity(self.catalog.facts(person=False), self.as_of, days)

    def activity_strip(self, now: str) -> dict[str, DataFrame]:
        events = self.catalog.read("events")
        return {"counts": profiles.activity_strip(events, self.catalog.scores, self.catalog.companies, now), "categories": profiles.activity_categories(events, now)}

    def heatmap(self, kind: str, top: int = 15) -> DataFrame:
        kinds = {
            "day-month": lambda: trades.heat_day_month(self.catalog.facts(company=False, person=False)), "party-sector": lambda: trades.heat_party_sector(self.catalog.facts()),
            "person-month": lambda: trades.heat_person_month(self.catalog.facts(company=False), top), "person-ticker": lambda: trades.heat_person_ticker(self.catalog.facts(person=False), top),
        }
        return kinds[kind]()

    def drill(self, limit: int = 500, **equal: object) -> DataFrame:
        return trades.drill(self.catalog.trades, min(limit, 500), **equal)

    # signals
    def latency(self, least: int = 5, limit: int = 50) -> DataFrame:
        return signals.latency_leaderboard(self.catalog.facts(), least, limit)

    def swarms(self, least: int = 4, limit: int = 100) -> DataFrame:
        return signals.swarms(self.catalog.facts(), least, limit)

    def partisan(self, mode: str = "consensus", least: int = 4, limit: int = 50) -> DataFrame:
        return signals.partisan(self.catalog.facts(), mode, least, limit)

    def first_movers(self, least: int = 3, limit: int = 50) -> DataFrame:
        return signals.first_movers(self.catalog.facts(person=False), "ticker", least).orderBy("ticker", "rank").limit(limit * 5)

    def round_trips(self, max_hold: int = 90, min_amount: int = 0, limit: int = 100) -> DataFrame:
        return signals.round_trips(self.catalog.facts(person=False), max_hold, min_amount, limit)

    def accountability(self, least: int = 5) -> DataFrame:
        return signals.accountability(self.catalog.trades, self.catalog.happenings, least=least)

    def scoreboard(self, limit: int = 100) -> DataFrame:
        return scores.scoreboard(self.accountability(), limit)

    def top_tickers(self, limit: int = 50) -> DataFrame:
        return trades.top_tickers(self.catalog.facts(), limit)

    def ticker(self, symbol: str, limit: int = 50) -> dict[str, DataFrame]:
        facts = self.catalog.facts().filter(F.col("ticker") == symbol)
        return {"headline": trades.top_tickers(facts, 1), "persons": trades.ticker_persons(facts), "recent": facts.orderBy(F.desc("traded_at"), F.desc("order_id"), F.desc("line")).limit(limit)}

    def findings(self, kinds: dict[str, DataFrame], limit: int = 20) -> DataFrame:
        return insights.evidence(insights.ranked(list(kinds.values()), self.as_of, limit))

    def detect(self, detectors: dict[str, Callable[[Catalog], DataFrame]], limit: int = 20, budget: float = 30.0) -> dict[str, DataFrame]:
        """The best findings of the detectors that end well within their seconds, with their proofs, and a status of each. All read one written table of trades."""
        shared = self.catalog.once(f"{shared_root(self.catalog.spark)}/once-{uuid.uuid4().hex}")
        found, status = detect.detect(self.catalog.spark, {name: partial(build, shared) for name, build in detectors.items()}, budget)
        return {"findings": insights.evidence(insights.ranked([found], self.as_of, limit)), "status": status}

    def fql(self, text: str, after: str | None = None, max_complexity: int | None = fql.MAX_COMPLEXITY, negate_words: bool = False) -> fql.Result:
        signals_ = {"swarms": signals.swarms(self.catalog.facts(), 4, None).select("ticker").distinct(), "round-trips": signals.round_trips(self.catalog.facts(person=False), limit=None).select("ticker").distinct()}
        query, as_of = fql.parse(text, negate_words), dt.date.fromisoformat(self.as_of)

        def planned(floor: str | None) -> fql.Result:
            return fql.plan(query, self.catalog.branches(floor), as_of, self.latest_scores, signals_, None, after, max_complexity, self.data_as_of, floor)

        return fql.newest(query, planned, self.catalog.dates(), as_of, shared_root(self.catalog.spark), after, max_complexity, self.data_as_of)
