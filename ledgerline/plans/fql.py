"""A search-style filter language, parsed in Python and planned as one DataFrame.

``type:trade party:R amount:>50k since:2000-01 -ticker:X sort:amount limit:20``. Clauses are ANDed, comma lists are ORed, ``-`` negates, ranges are ``lo..hi`` or
``>``, ``<``, ``>=``, ``<=``; bare words search ticker, company and name. Modifiers: sort (recent, score, amount), group (type, company, person, sector, week, month), limit.

Nine kinds of rows (``BRANCHES``) have one projection of 27 columns. Filters are put on every branch before the union, where Catalyst pushes them into its scans. A filter on
persons or tickers that a branch can't have empties it, with a warning; any other one that it can't have is ignored for it.

``plan`` is lazy. ``newest`` runs: it makes a page of newest rows from the newest days alone, if they fill it, so that older rows meet no join.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
import time
import uuid
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import week_of

TEXT_KEYS = {
    "type", "ticker", "sector", "subsector", "market-cap", "by", "party", "branch", "committee", "since", "before", "signal", "action",
    "owner", "agency", "country", "program", "state", "registrant", "filing",
}
NUMBER_KEYS = {"amount", "score", "market-score", "policy-score", "insider-score", "score-delta", "workers"}
MODIFIERS = {"sort": {"recent", "score", "amount", "score-delta"}, "group": {"type", "company", "person", "sector", "week", "month"}}
SINGLE = {"since", "before", "sector", "subsector"}
SCORES = {"score": "composite", "market-score": "market", "policy-score": "policy", "insider-score": "insider"}
ACTIONS = {"buy": ("purchase",), "sell": ("sale_full", "sale_partial")}
ROLES = {"senate": "senator", "house": "representative"}
SIGNALS = {"swarms": "swarm", "first-movers": "first-mover", "round-trips": "round-trip", "partisan-consensus": "partisan", "partisan-contrarian": "partisan"}
MAX_CLAUSES = MAX_VALUES = 20
MAX_COMPLEXITY = 6
#: ``newest`` looks for a page among days that hold so many times its rows; the newest days it counts, and the rows that a second look may take (few enough for a broadcast).
TIMES, DAYS, SECOND = 20, 10_000, 100_000
CANONICAL = {
    "event_type": "string", "event_id": "bigint", "occurred_at": "timestamp", "person_slug": "string", "person_name": "string", "person_party": "string", "person_branch": "string",
    "ticker": "string", "company_name": "string", "sector": "string", "action": "string", "owner": "string", "amount_mid": "bigint", "agency": "string", "program": "string",
    "country": "string", "state": "string", "workers_affected": "bigint", "entity_name": "string", "description": "string", "registrant": "string", "filing_type": "string",
    "filer_name": "string", "filer_title": "string", "shares": "bigint", "filed_at": "timestamp", "score": "double",
}
#: What filters look at besides.
HIDDEN = {"subsector": "string", "market_cap": "string", "role": "string", "committees": "array<string>", "countries": "array<string>"}


@dataclass(frozen=True)
class Branch:
    """A kind of rows: whether it has companies and persons, whether its amounts are cents, and the columns that its own filters look at."""

    company: bool = True
    person: bool = False
    amount: bool = False
    cents: bool = False
    filters: dict[str, str] = field(default_factory=dict)
    scored: bool = True


BRANCHES = {
    "trade": Branch(person=True, amount=True, filters={"action": "action", "owner": "owner"}),
    "contract": Branch(amount=True, cents=True, filters={"action": "action", "agency": "agency"}),
    "sanction": Branch(filters={"country": "country", "program": "program"}),
    "donation": Branch(amount=True, cents=True),
    "lobbying": Branch(amount=True, cents=True, filters={"registrant": "registrant"}),
    "insider": Branch(amount=True, cents=True, filters={"action": "action"}),
    "court": Branch(filters={"filing": "filing_type"}),
    "warn": Branch(filters={"state": "state", "workers": "workers_affected"}),
    "tariff": Branch(filters={"country": "countries"}, scored=False),
}


class FqlError(ValueError):
    """What is wrong with a query: a code, and the status that a service would answer with."""

    def __init__(self, message: str, code: str = "PARSE_ERROR", status: int = 400):
        super().__init__(message)
        self.code, self.status = code, status


@dataclass(frozen=True)
class Clause:
    key: str
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False
    negated: bool = False


@dataclass
class Query:
    clauses: list[Clause] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    not_words: list[str] = field(default_factory=list)
    sort: str = "recent"
    group: str | None = None
    limit: int = 50
    warnings: list[str] = field(default_factory=list)
    text: str = ""

    def has(self, *keys: str) -> bool:
        return any(c.key in keys for c in self.clauses)


def tokens(text: str) -> list[str]:
    """Split at spaces outside double quotes."""
    if text.count('"') % 2:
        raise FqlError("unterminated quote")
    return [t.replace('"', "") for t in re.findall(r'(?:[^\s"]|"[^"]*")+', text)]


def number(text: str) -> float:
    found = re.fullmatch(r"(-?\d+(?:\.\d+)?)([kmb]?)", text.strip().lower())
    if not found:
        raise FqlError(f"not a number: {text}")
    return float(found[1]) * {"": 1, "k": 1e3, "m": 1e6, "b": 1e9}[found[2]]


def _numbers(key: str, text: str, negated: bool) -> Clause:
    if ".." in text:
        low, high = text.split("..", 1)
        return Clause(key, low=number(low), high=number(high), negated=negated)
    found = re.fullmatch(r"(>=|<=|>|<)?(.+)", text)
    if not found:
        raise FqlError(f"{key}: no value")
    sign, value = found[1] or ">=", number(found[2])
    if sign[0] == ">":
        return Clause(key, low=value, low_open=sign == ">", negated=negated)
    return Clause(key, high=value, high_open=sign == "<", negated=negated)


def parse(text: str, negate_words: bool = False) -> Query:
    """``negate_words``: a dash before bare text excludes it; without, the dash is dropped and the text is still required."""
    query = Query(text=text)
    for token in tokens(text):
        negated = token.startswith("-") and len(token) > 1
        key, colon, value = token.lstrip("-" if negated else "").partition(":")
        key = key.lower()
        if not colon:
            (query.not_words if negated and negate_words else query.words).append(token.lstrip("-"))
            continue
        if key in ("sort", "group", "limit"):
            if negated:
                raise FqlError(f"{key} can't be negated")
            if key == "limit":
                if not value.isdigit() or not 1 <= int(value) <= 200:
                    raise FqlError("limit is 1 to 200")
                query.limit = int(value)
            elif value not in MODIFIERS[key]:
                raise FqlError(f"unknown {key}: {value}")
            else:
                setattr(query, key, value)
            continue
        if query.has(key):
            query.warnings.append(f"{key} is repeated: all have to hold")
        if key in NUMBER_KEYS:
            query.clauses.append(_numbers(key, value, negated))
        elif key in TEXT_KEYS:
            values = tuple(v.strip() for v in value.split(",") if v.strip())
            if not values or len(values) > MAX_VALUES:
                raise FqlError(f"{key}: 1 to {MAX_VALUES} values")
            if key in SINGLE and len(values) > 1:
                raise FqlError(f"{key} takes one value")
            query.clauses.append(Clause(key, values, negated=negated))
        else:
            raise FqlError(f"unknown key: {key}")
    if len(query.clauses) > MAX_CLAUSES:
        raise FqlError(f"more than {MAX_CLAUSES} clauses")
    if query.sort == "score-delta":
        raise FqlError("sort:score-delta is not supported")
    return query


def resolve_date(text: str, as_of: dt.date) -> dt.date:
    """A day from YYYY[-MM[-DD]], today, ytd, last-week, last-month, last-quarter, or N{d,w,m,y} ago; month ends are clamped."""

    def months_back(n: int) -> dt.date:
        y, m = divmod(as_of.year * 12 + as_of.month - 1 - n, 12)
        last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
        return dt.date(y, m + 1, min(as_of.day, last))

    named = {"today": as_of, "ytd": dt.date(as_of.year, 1, 1), "last-week": as_of - dt.timedelta(days=7), "last-month": months_back(1), "last-quarter": months_back(3)}
    if text in named:
        return named[text]
    if found := re.fullmatch(r"(\d+)([dwmy])", text):
        n = int(found[1])
        return {"d": lambda: as_of - dt.timedelta(days=n), "w": lambda: as_of - dt.timedelta(weeks=n), "m": lambda: months_back(n), "y": lambda: months_back(12 * n)}[found[2]]()
    if found := re.fullmatch(r"(\d{4})(?:-(\d\d))?(?:-(\d\d))?", text):
        try:
            return dt.date(int(found[1]), int(found[2] or 1), int(found[3] or 1))
        except ValueError as e:
            raise FqlError(f"not a date: {text}") from e
    raise FqlError(f"not a date: {text}")


def complexity(query: Query, no_signal: bool = False) -> int:
    """What the query costs by its shape: 3 for all types, 2 without a date, up to 4 for a group, 3 for a signal without a list, 2 for nothing that narrows."""
    dated, typed = query.has("since", "before"), query.has("type")
    narrow = typed or dated or query.has("ticker", "by") or bool(query.words)
    grouped = (2 + 2 * (not dated)) * (query.group is not None)
    return 3 * (not typed) + 2 * (not dated) + grouped + 3 * (no_signal and query.has("signal")) + 2 * (not narrow)


Builders = dict[str, Callable[[], DataFrame]]


def canonical(df: DataFrame, kind: str) -> DataFrame:
    """The common columns and the hidden ones; what a branch lacks is null."""
    have = set(df.columns)

    def column(name: str, of: str) -> Column:
        return (F.lit(kind) if name == "event_type" else F.col(name) if name in have else F.lit(None)).cast(of).alias(name)

    return df.select(*[column(c, t) for c, t in (CANONICAL | HIDDEN).items()])


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _contains(column: str, text: str) -> Column:
    return F.lower(column).contains(text.lower())


def _range(column: Column, clause: Clause, times: int = 1) -> Column:
    out = F.lit(True)
    if clause.low is not None:
        out = out & (column > clause.low * times if clause.low_open else column >= clause.low * times)
    if clause.high is not None:
        out = out & (column < clause.high * times if clause.high_open else column <= clause.high * times)
    return out


def _condition(clause: Clause, kind: str, branch: Branch, as_of: dt.date, warn: Callable[[str], None]) -> Column | None:
    """What a clause says of the rows of a branch; None where it says nothing."""
    key, values = clause.key, clause.values
    if key in ("since", "before"):
        if clause.negated:
            warn(f"-{key} is not supported and ignored")
            return None
        at = F.lit(resolve_date(values[0], as_of).isoformat()).cast("timestamp")
        return F.col("occurred_at") >= at if key == "since" else F.col("occurred_at") < at
    if key in ("by", "party", "branch", "committee") and not branch.person or key == "ticker" and not branch.company:
        warn(f"{key} does not apply to {kind}, which gives no rows")
        return F.lit(bool(clause.negated))  # negated below
    if key == "ticker":
        return F.col("ticker").isin(*values)
    if key in ("sector", "subsector"):
        return _contains(key, values[0]) if branch.company else None
    if key == "market-cap":
        return F.col("market_cap") == values[0] if branch.company else None
    if key == "by":
        return F.col("person_slug").isin(*values) | _any([_contains("person_name", v) for v in values])
    if key == "party":
        return F.col("person_party").isin(*values)
    if key == "branch":
        return F.col("role").isin(*[ROLES.get(v, v) for v in values])
    if key == "committee":
        return F.arrays_overlap("committees", F.array(*map(F.lit, values)))
    if key in SCORES:
        if not branch.scored:
            warn(f"{key} does not apply to {kind} and is ignored for it")
            return None
        return _range(F.col(f"__{SCORES[key]}"), clause)
    if key == "score-delta":
        warn("score-delta is not supported and ignored")
        return None
    if key == "amount":
        return _range(F.col("__amount"), clause, 100 if branch.cents else 1) if branch.amount else None
    column = branch.filters.get(key)
    if column is None:
        return None
    if key == "workers":
        return _range(F.col(column), clause)
    if key in ("agency", "registrant"):
        return _contains(column, values[0])
    if key == "action":
        return F.col(column).isin(*[x for v in values for x in ACTIONS.get(v.lower(), (v,))])
    if column == "countries":
        return F.arrays_overlap(column, F.array(*map(F.lit, values)))
    return F.col(column).isin(*values)


@dataclass
class Result:
    """A planned query: ``rows`` is lazy. ``page`` runs it: at most ``limit`` rows come to the driver."""

    query: Query
    rows: DataFrame
    warnings: list[str]
    complexity: int
    data_as_of: str = ""
    after: dict | None = None

    def page(self) -> dict:
        began = time.time()
        rows = [r.asDict() for r in self.rows.collect()]
        more = self.query.group is None and len(rows) == self.query.limit
        meta = {
            "query": self.query.text, "query_ms": round(1000 * (time.time() - began)), "result_count": len(rows), "has_more": more,
            "next_cursor": self._next(rows) if more else None, "data_as_of": self.data_as_of, "grouped": self.query.group is not None,
        }
        return {"results": rows, "meta": meta, "warnings": self.warnings}

    def _next(self, rows: list[dict]) -> str:
        names = _order_names(self.query)
        last = [rows[-1][c] for c in names]
        same = 0
        while same < len(rows) and [rows[-1 - same][c] for c in names] == last:
            same += 1
        key = {c: x.isoformat() if isinstance(x, dt.datetime) else x for c, x in zip(names, last, strict=True)}
        if same == len(rows) and self.after and self.after["key"] == key:
            same += self.after["skip"]
        return write_cursor(self.query.sort, key, same, self.data_as_of)


def write_cursor(sort: str, key: dict, skip: int, data_as_of: str = "") -> str:
    """The place after a page: the last row's sort values, and how many rows with the same ones were given already."""
    return base64.urlsafe_b64encode(json.dumps({"sort": sort, "key": key, "skip": skip, "data_as_of": data_as_of}).encode()).decode()


def read_cursor(text: str, sort: str = "recent", data_as_of: str = "") -> dict:
    try:
        found = json.loads(base64.urlsafe_b64decode(text))
        found = {"sort": str(found["sort"]), "key": dict(found["key"]), "skip": int(found["skip"]), "data_as_of": str(found["data_as_of"])}
    except (ValueError, KeyError, TypeError) as e:
        raise FqlError("bad cursor") from e
    if found["sort"] != sort or not set(found["key"]) <= {"score", "amount_mid", "occurred_at", "event_id"}:
        raise FqlError(f"the cursor is of sort:{found['sort']}", "CURSOR_SORT_ERROR")
    if data_as_of and found["data_as_of"] != data_as_of:
        raise FqlError("the data has changed since this cursor was made", "CURSOR_STALE", 409)
    return found


def _order_names(query: Query) -> list[str]:
    return [*{"amount": ["amount_mid"], "score": ["score"]}.get(query.sort, []), "occurred_at", "event_id"]


def _from_cursor(key: dict) -> Column:
    """Rows at the cursor's place or after it, in descending order with nulls last."""
    out, equal = None, F.lit(True)
    for name, value in key.items():
        column = F.col(name)
        if value is None:
            here, below = column.isNull(), F.lit(False)
        else:
            at = F.lit(value).cast(CANONICAL[name])
            here, below = column.eqNullSafe(at), (column < at) | column.isNull()
        out = equal & below if out is None else out | (equal & below)
        equal = equal & here
    return out | equal


def plan(
    query: Query,
    builders: Builders,
    as_of: dt.date,
    scores: Callable[[], DataFrame] | None = None,
    signals: dict[str, DataFrame] | None = None,
    cap: int | None = None,
    after: str | None = None,
    max_complexity: int | None = None,
    data_as_of: str = "",
    floor: str | None = None,
) -> Result:
    """The rows that the query asks for. ``scores``: ticker, market, policy, insider, composite, the latest of each ticker, read only if the query needs them. ``floor``: a day before which no row is looked at."""
    warnings = list(query.warnings)

    def warn(text: str) -> None:
        if text not in warnings:
            warnings.append(text)

    lists: list[DataFrame] = []
    for clause in query.clauses:
        if clause.key == "signal":
            named = {SIGNALS.get(v, v) for v in clause.values}
            lists = [df for k, df in (signals or {}).items() if SIGNALS.get(k, k) in named]
            if not lists:
                warn("there is no list of this signal; the filter is ignored")
    cost = complexity(query, no_signal=not lists)
    _guard(query, cost, max_complexity)
    since, before = ([resolve_date(c.values[0], as_of) for c in query.clauses if c.key == k and not c.negated] for k in ("since", "before"))
    if since and before and max(since) >= min(before):
        warn(f"no date is since {max(since)} and before {min(before)}")
    chosen = [b for b in BRANCHES if b in builders]
    for clause in query.clauses:
        if clause.key == "type":
            for unknown in set(clause.values) - set(BRANCHES):
                warn(f"there is no type {unknown}")
    chosen = _chosen(query, chosen)
    if cap and len(chosen) > cap:
        warn(f"only the first {cap} types are searched; left out: {', '.join(chosen[cap:])}")
        chosen = chosen[:cap]
    if not chosen:
        warn("no type is left to search")
    scored = query.sort == "score" or query.has(*SCORES)
    if scored and scores is None:
        warn("there are no scores here: filters on them are ignored")
        scored = False
    rows = None
    for kind in chosen or list(builders)[:1]:
        own = _branch(builders[kind](), kind, query, as_of, scores() if scored and BRANCHES[kind].scored else None, lists, warn, floor)
        rows = own if rows is None else rows.unionByName(own)
    if not chosen:
        rows = rows.filter(F.lit(False))
    if query.group:
        key = {
            "type": F.col("event_type"), "company": F.col("ticker"), "person": F.col("person_slug"), "sector": F.col("sector"),
            "week": week_of(F.col("occurred_at")).cast("string"), "month": F.date_format("occurred_at", "yyyy-MM"),
        }[query.group]
        grouped = rows.groupBy(key.alias("group_key")).agg(
            F.count("*").alias("count"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.sum("amount_mid").alias("total_amount")
        )
        out = grouped.orderBy(F.desc("count"), "group_key").limit(query.limit)
        return Result(query, out.select("group_key", F.lit(query.group).alias("group_by"), "count", "first_seen", "last_seen", "total_amount"), warnings, cost, data_as_of)
    place = read_cursor(after, query.sort, data_as_of) if after else None
    if place:
        rows = rows.filter(_from_cursor(place["key"]))
    rows = _ordered(rows, query)
    if place and place["skip"]:
        rows = rows.offset(place["skip"])
    return Result(query, rows.limit(query.limit), warnings, cost, data_as_of, place)


def _guard(query: Query, cost: int, most: int | None) -> None:
    if most is not None and cost > most and (query.clauses or query.words or query.group):
        raise FqlError(f"the query's complexity is {cost}, over {most}: narrow it by type or date", "COMPLEXITY_LIMIT")


def _chosen(query: Query, kinds: list[str]) -> list[str]:
    for clause in query.clauses:
        if clause.key == "type":
            kinds = [k for k in kinds if (k in clause.values) != clause.negated]
    return [k for k in kinds if BRANCHES[k].person or not query.has("by")]


def _ordered(rows: DataFrame, query: Query) -> DataFrame:
    names = _order_names(query)
    return rows.orderBy(*[F.desc_nulls_last(c) for c in names], *[c for c in CANONICAL if c not in names])


def newest(
    query: Query, planned: Callable[[str | None], Result], dates: Builders, as_of: dt.date, root: str, after: str | None = None, max_complexity: int | None = None, data_as_of: str = ""
) -> Result:
    """The plan of a query, whose page of newest rows is made, below ``root``, from the newest days alone if they fill it: no older row can be on it then.

    ``planned`` plans the query from a day on, or over all rows; ``dates`` has when the rows of a branch occurred, before any join. They only tell where to look: a page that
    isn't full is looked for once more, over as many rows as the first look's share asks for, and then among all rows. Scores and signals cost more than the joins, so that
    queries with them are planned whole, as are those in another order.
    """
    kinds, place = _chosen(query, list(dates)), read_cursor(after, query.sort, data_as_of) if after else None
    if not kinds or query.sort != "recent" or query.group or query.has("signal", *SCORES) or place and not place["key"].get("occurred_at"):
        return planned(None)
    _guard(query, complexity(query), max_complexity)
    counted = _days(query, [dates[k]() for k in kinds], as_of, place["key"]["occurred_at"] if place else None)
    reached = list(accumulate(n for _, n in counted))
    page = query.limit + (place["skip"] if place else 0)
    wanted = TIMES * page
    for first in (True, False):
        at = bisect_left(reached, wanted)
        if at == len(reached) or reached[at] > (max(SECOND, reached[-1] // 4) if first else SECOND):
            break
        result, path = planned(counted[at][0]), f"{root}/newest-{uuid.uuid4().hex}"
        result.rows.write.parquet(path)
        found = result.rows.sparkSession.read.schema(result.rows.schema).parquet(path)
        full = found.count()
        if full == query.limit:
            return replace(result, rows=_ordered(found, query).limit(query.limit))
        if not full:
            break
        wanted = 2 * reached[at] * page // full
    return planned(None)


def _days(query: Query, dates: list[DataFrame], as_of: dt.date, until: str | None) -> list[tuple[str, int]]:
    """The newest days that the query lets pass, and how many rows occurred on each."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col("occurred_at").cast("timestamp")) for df in dates])
    for clause in query.clauses:
        if clause.key in ("since", "before") and not clause.negated:
            rows = rows.filter(_condition(clause, "", Branch(), as_of, lambda _: None))
    if until:
        rows = rows.filter(F.col("occurred_at") <= F.lit(until).cast("timestamp"))
    days = rows.filter("occurred_at is not null").groupBy(F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("rows")).orderBy(F.desc("day")).limit(DAYS)
    return [tuple(r) for r in days.select(F.col("day").cast("string"), "rows").collect()]


def _branch(df: DataFrame, kind: str, query: Query, as_of: dt.date, scores: DataFrame | None, lists: list[DataFrame], warn: Callable[[str], None], floor: str | None) -> DataFrame:
    branch = BRANCHES[kind]
    rows = canonical(df, kind)
    if floor:
        rows = rows.filter(F.col("occurred_at") >= F.lit(floor).cast("timestamp"))
    if branch.amount:  # builders give amounts in the branch's own unit
        rows = rows.withColumn("__amount", F.col("amount_mid"))
        if branch.cents:
            rows = rows.withColumn("amount_mid", F.expr("amount_mid div 100"))
    if scores is not None:
        latest = scores.select("ticker", *[F.col(c).alias(f"__{c}") for c in SCORES.values()])
        rows = rows.join(latest, "ticker", "left").withColumn("score", F.col("__composite"))
    for clause in query.clauses:
        if clause.key == "type" or clause.key in SCORES and scores is None and branch.scored:
            continue
        if clause.key == "signal":
            if lists and branch.company:
                tickers = reduce(lambda a, b: a.unionByName(b), [x.select("ticker") for x in lists]).distinct()
                rows = rows.join(tickers, "ticker", "left_anti" if clause.negated else "left_semi")
            continue
        condition = _condition(clause, kind, branch, as_of, warn)
        if condition is not None:
            rows = rows.filter(~condition if clause.negated else condition)
    searched = (["ticker", "company_name"] if branch.company else []) + (["person_name"] if branch.person else [])
    for word in query.words + query.not_words:
        found = _any([F.coalesce(_contains(c, word), F.lit(False)) for c in searched])
        rows = rows.filter(found if word in query.words else ~found)
    return rows.select(*CANONICAL)
