"""Queries of the filter language over all nine kinds of rows, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..operators import scores, signals
from ..streaming.loads import shared_root
from . import fql
from .mapping import AS_OF, FQ, SC, Catalog

SCORED = ("trade", "contract", "sanction", "donation", "lobbying", "insider", "court", "warn")
OUT = ", ".join(c for c in fql.CANONICAL if c != "score")
ORDER = "occurred_at DESC NULLS LAST, event_id DESC NULLS LAST, " + ", ".join(f"{c} NULLS FIRST" for c in fql.CANONICAL if c not in ("occurred_at", "event_id", "score"))
LATEST = "la AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY computed_at DESC) = 1)"


def build(text: str, after: str | None = None, signal: bool = False, **options) -> object:
    def run(c: Catalog) -> DataFrame:
        lists = {"swarms": signals.swarms(c.trades, 6, None).select("ticker").distinct()} if signal else None
        query, as_of = fql.parse(text, **options), dt.date.fromisoformat(AS_OF)

        def planned(floor: str | None) -> fql.Result:
            return fql.plan(query, c.branches(floor), as_of, lambda: scores.latest_scores(c.scores), lists, after=after, floor=floor)

        return fql.newest(query, planned, c.dates(), as_of, shared_root(c.spark), after).rows

    return run


def sql_of(where: str, order: str = "", limit: int = 50, group: str | None = None, score: bool = False) -> str:
    if group:
        return (
            f"SELECT group_key, '{group}' AS group_by, count(*) AS count, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, sum(amount_mid)::BIGINT AS total_amount "
            f"FROM (SELECT *, {_GROUPS[group]} AS group_key FROM fq WHERE {where}) GROUP BY group_key ORDER BY count DESC, group_key NULLS FIRST LIMIT {limit}"
        )
    if score:
        return f"SELECT {', '.join('fq.' + c.strip() for c in OUT.split(','))}, composite AS score FROM fq LEFT JOIN la ON la.ticker = fq.ticker AND event_type <> 'tariff' WHERE {where} ORDER BY {order}{_prefixed(ORDER)} LIMIT {limit}"
    return f"SELECT {OUT}, NULL::DOUBLE AS score FROM fq WHERE {where} ORDER BY {order}{ORDER} LIMIT {limit}"


def _prefixed(order: str) -> str:
    return ", ".join("fq." + part.strip() for part in order.split(","))


_GROUPS = {
    "type": "event_type", "company": "ticker", "person": "person_slug", "sector": "sector",
    "week": "date_trunc('week', occurred_at)::DATE::VARCHAR", "month": "strftime(occurred_at, '%Y-%m')",
}


def _found(*columns: str, text: str) -> str:
    return "(" + " OR ".join(f"coalesce(contains(lower({c}), '{text}'), false)" for c in columns) + ")"


_WIDGET = f"({_found('ticker', 'company_name', 'person_name', text='widget')})"
#: name: text, where, and what else the SQL needs.
CASES: dict[str, tuple[str, str, dict]] = {
    "recent": ("", "true", {}),
    "filters": ("type:trade party:R action:buy amount:>50k since:2000 sort:amount limit:20", "event_type = 'trade' AND person_party = 'R' AND action = 'purchase' AND amount_mid > 50000 AND occurred_at >= TIMESTAMP '2000-01-01'", {"order": "amount_mid DESC NULLS LAST, ", "limit": 20}),
    "negation": ("type:trade,insider -sector:econ -amount:1000..60000 before:1998-05-09", "occurred_at < TIMESTAMP '1998-05-09' AND NOT contains(lower(sector), 'econ') AND (event_type = 'trade' AND NOT (amount_mid BETWEEN 1000 AND 60000) OR event_type = 'insider' AND NOT (cents BETWEEN 100000 AND 6000000))", {}),
    "words": ('widget "Customer#0000000" type:trade,insider limit:30', "event_type = 'trade' AND " + _WIDGET + " AND " + _found("ticker", "company_name", "person_name", text="customer#0000000"), {"limit": 30}),
    "not_words": ("-widget type:sanction,court", "event_type IN ('sanction', 'court') AND NOT " + _found("ticker", "company_name", text="widget"), {"negate_words": True}),
    "contract": ("type:contract agency:medium amount:<=90k action:O,F", "event_type = 'contract' AND contains(lower(agency), 'medium') AND cents <= 9000000 AND action IN ('O', 'F')", {}),
    "sanction": ("type:sanction program:ASIA,EUROPE -country:NATION_4", "event_type = 'sanction' AND program IN ('ASIA', 'EUROPE') AND NOT country = 'NATION_4'", {}),
    "donation": ("type:donation amount:>=100 sort:amount", "event_type = 'donation' AND cents >= 10000", {"order": "amount_mid DESC NULLS LAST, "}),
    "lobbying": ("type:lobbying registrant:#00000001 since:1995-01-15", "event_type = 'lobbying' AND contains(lower(registrant), '#00000001') AND occurred_at >= TIMESTAMP '1995-01-15'", {}),
    "insider": ("type:insider action:sell subsector:group market-cap:mid limit:25", "event_type = 'insider' AND action IN ('sale_full', 'sale_partial') AND contains(subsector, 'group') AND market_cap = 'mid'", {"limit": 25}),
    "court": ('type:court filing:"kind 3","kind 4"', "event_type = 'court' AND filing_type IN ('kind 3', 'kind 4')", {}),
    "warn": ("type:warn workers:>50", "event_type = 'warn' AND workers_affected > 50", {}),
    "warn_state": ("type:warn state:NATION_1,NATION_2 workers:10..90 -market-cap:small limit:40", "event_type = 'warn' AND state IN ('NATION_1', 'NATION_2') AND workers_affected BETWEEN 10 AND 90 AND NOT market_cap = 'small'", {"limit": 40}),
    "tariff": ("type:tariff country:NATION_3,NATION_11 limit:30", "event_type = 'tariff' AND nation IN ('NATION_3', 'NATION_11')", {"limit": 30}),
    "persons": ('by:"Customer#00000002" branch:senate committee:BUILDING,MACHINERY owner:O', "event_type = 'trade' AND contains(lower(person_name), 'customer#00000002') AND role = 'senator' AND committee IN ('BUILDING', 'MACHINERY') AND owner = 'O'", {}),
    "slug": ("by:customer#000000007", "event_type = 'trade' AND person_slug = 'customer#000000007'", {}),
    "inapplicable": ("party:D since:2001 workers:>1000000 agency:urgent type:trade,warn,contract", "event_type = 'trade' AND person_party = 'D' AND occurred_at >= TIMESTAMP '2001-01-01'", {}),
    "all_types": ("since:1999 before:2000-02-02 subsector:2 limit:200", "occurred_at >= TIMESTAMP '1999-01-01' AND occurred_at < TIMESTAMP '2000-02-02' AND (event_type = 'tariff' AND contains(lower(subsector), '2') OR event_type <> 'tariff' AND contains(lower(subsector), '2'))", {"limit": 200}),
    "score": ("type:trade,tariff,warn score:>=50 sort:score limit:40", "event_type IN ('trade', 'warn') AND composite >= 50 OR event_type = 'tariff'", {"order": "composite DESC NULLS LAST, ", "limit": 40, "score": True}),
    "score_parts": ("type:insider market-score:20..60 policy-score:<90 -insider-score:>40", "event_type = 'insider' AND market BETWEEN 20 AND 60 AND policy < 90 AND NOT insider > 40", {"score": True}),
    "signal": ("type:trade signal:swarm since:2000-06 limit:25", "event_type = 'trade' AND ticker IN (SELECT ticker FROM sw WHERE reps >= 6) AND occurred_at >= TIMESTAMP '2000-06-01'", {"limit": 25, "signal": True}),
    "no_signal": ("type:court signal:nosuch", "event_type = 'court'", {}),
    "no_type": ("type:nosuch", "false", {}),
    "no_delta": ("type:sanction score-delta:>1", "event_type = 'sanction'", {}),
    "cursor": ("type:trade limit:30", "event_type = 'trade' AND (occurred_at < TIMESTAMP '2000-01-05' OR (occurred_at = TIMESTAMP '2000-01-05' AND event_id <= 500))", {"limit": 30, "after": fql.write_cursor("recent", {"occurred_at": "2000-01-05T00:00:00", "event_id": 500}, 0)}),
    "cursor_amount": ("type:trade,court sort:amount limit:30", "event_type IN ('trade', 'court') AND (amount_mid < 90000 OR amount_mid IS NULL)", {"order": "amount_mid DESC NULLS LAST, ", "limit": 30, "after": fql.write_cursor("amount", {"amount_mid": 90000, "occurred_at": "1000-01-01T00:00:00", "event_id": 0}, 0)}),
}
for _group in _GROUPS:
    CASES[f"group_{_group}"] = (f"group:{_group} since:1999 limit:60", "occurred_at >= TIMESTAMP '1999-01-01'", {"limit": 60, "group": _group})


def register(add, swarms_sql: str) -> None:
    for name, (text, where, more) in CASES.items():
        more = dict(more)
        own = {k: more.pop(k) for k in ("after", "signal", "negate_words") if k in more}
        tables = [FQ, *([SC, LATEST] if more.get("score") else []), *([swarms_sql] if own.get("signal") else [])]
        add(f"fql_{name}", sql_of(where, **more), build(text, **own), *tables)
