"""The domain's tables over the tables at hand: Spark plans, and the same in SQL.

A trade is a line item: the customer is the person, the brand the ticker, the part type the sector, the return flag the trade type, the supplier the
corporate insider, order and ship dates are traded and filed. Prices are daily maxima per ticker, scores are monthly per ticker. The other kinds of rows: contracts are orders by
their first line, sanctions are suppliers, lobbying records are customers, tariffs are nations, and donations, court filings and layoffs are events by type.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.exprs import midpoint
from ..operators.backfill import score_history

AS_OF = "2001-08-01"
YEARS_BACK = 24  # events lie so many years after the trades
FEW = 100_000  # orders that are broadcast
ROWS_A_COMPANY = 1_000
_TRADE = (
    "person_id", "name", "party", "state", "committee", "ticker", "sector", "company", "part_id", "trade_type",
    "low", "high", "est", "traded_at", "filed_at", "insider_id", "order_id", "line",
)


def _days_on(days: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit("1995-01-01").cast("timestamp")) + days * 86400)


class Catalog:
    """Lazy tables of one directory."""

    written = False  # whether trades are a table of their own
    cut = True  # whether a company may have so many trades that joins in time must cut it into buckets

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def nations(self) -> DataFrame:
        region = F.broadcast(self.read("region"))  # five rows
        return self.read("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region"))

    @cached_property
    def persons(self) -> DataFrame:
        nation = F.broadcast(self.read("nation").select("n_nationkey", F.col("n_name").alias("state")))  # one row per country
        return self.read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*self._person(), "state")

    def _person(self) -> list[Column]:
        key = F.col("c_custkey")
        party = F.when(key % 3 == 0, "R").when(key % 3 == 1, "D").otherwise("I")
        role = F.when(key % 2 == 0, "senator").otherwise("representative")
        return [
            key.alias("person_id"), F.col("c_name").alias("name"), F.lower("c_name").alias("slug"), party.alias("party"), role.alias("role"), F.lit("legislative").alias("person_branch"),
            (key % 4 + 1).cast("int").alias("tier"), F.col("c_mktsegment").alias("committee"),
        ]

    @cached_property
    def companies(self) -> DataFrame:
        cap = F.when(F.col("p_size") >= 34, "large").when(F.col("p_size") >= 17, "mid").otherwise("small")
        return self.read("part").select(
            F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("ticker"), F.col("p_type").alias("sector"), F.col("p_name").alias("company"),
            F.concat(F.lit("group "), F.expr("p_size div 10")).alias("subsector"), cap.alias("market_cap"), (F.col("p_size") % 25).alias("hs_code"),
        )

    def orders(self, since: str | None = None) -> DataFrame:
        """Orders, all or from a day on; if those are few (they are counted for it), their lines meet them by a broadcast."""
        rows = self.read("orders")
        if since is None:
            return rows
        rows = rows.filter(F.col("o_orderdate") >= F.lit(since).cast("timestamp"))
        return F.broadcast(rows) if rows.count() <= FEW else rows

    def facts(self, company: bool = True, person: bool = True, state: bool = False, order: bool = True, orders: DataFrame | None = None) -> DataFrame:
        """Trades (of the given orders or of all) with the dimensions that a query needs, and no other join. Without ``order`` a trade has no person and no date of its own but the filing's."""
        kind = F.when(F.col("l_returnflag") == "A", "purchase").when(F.col("l_returnflag") == "R", "sale_full").otherwise("sale_partial")
        low = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long")
        high = F.floor("l_extendedprice").cast("long")
        columns = [
            kind.alias("trade_type"), low.alias("low"), high.alias("high"), midpoint(low, high).alias("est"), F.col("l_shipdate").alias("filed_at"),
            F.col("l_suppkey").alias("insider_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"), F.col("l_linestatus").alias("owner"),
        ]
        rows = self.read("lineitem")
        persons = (self.persons if state else self.read("customer").select(*self._person())) if person or state else None
        met = persons is None
        if order:
            own = self.orders() if orders is None else orders
            if orders is None and not met:  # orders are fewer than their lines: persons meet those, and a line moves for its company and its order alone
                own, met = own.join(persons, F.col("o_custkey") == F.col("person_id")).drop("person_id"), True
                columns += [c for c in persons.columns if c != "person_id"]
            columns += [F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("traded_at")]
        if company:
            rows = rows.join(self.companies, F.col("l_partkey") == F.col("part_id")).drop("part_id")
            columns += [c for c in self.companies.columns if c != "part_id"]
        if order:
            rows = rows.join(own, F.col("l_orderkey") == F.col("o_orderkey"))
        rows = rows.select(*columns)
        return rows if met else rows.join(persons, "person_id")

    @cached_property
    def trades(self) -> DataFrame:
        return self.facts(state=True).select(*_TRADE)

    @cached_property
    def prices(self) -> DataFrame:
        daily = self.facts(person=False).groupBy("ticker", F.col("traded_at").alias("at"))
        return daily.agg((F.max("high") * 100).alias("price_cents"), F.count("*").alias("volume"))

    def once(self, root: str) -> Catalog:
        """This catalog with its trades written to a table by year, and daily prices made of them: for plans that use them many times."""
        rows = self.facts(state=True).withColumn("year", F.year("traded_at"))
        rows.write.partitionBy("year").parquet(f"{root}/trades")  # not dealt anew: a row stays with its order
        written = self.spark.read.schema(rows.schema).parquet(f"{root}/trades").drop("year")
        return self._over(written, root)

    def by_company(self, root: str, columns: tuple[str, ...]) -> tuple[Catalog, DataFrame]:
        """This catalog over these columns of its trades, kept on the executors' disks with a company's rows together, and that table, for its user to unpersist. Plans that group or join by ``part_id`` don't
        shuffle it. Where no company has more than ``ROWS_A_COMPANY`` trades joins in time need no buckets (``cut``)."""
        own = list(dict.fromkeys((*columns, "part_id", "ticker", "traded_at", "high")))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if self.written:
            rows = self.facts().select(*own).repartition(n, "part_id")
        else:
            of = self.companies.select("part_id", *[x for x in own if x in self.companies.columns and x != "part_id"])
            rows = self.facts(company=False)
            rows = rows.select(*[x for x in own if x in rows.columns]).repartition(n, "part_id").join(of, "part_id").select(*own)
        rows = rows.persist(StorageLevel.DISK_ONLY)
        most = rows.groupBy("part_id").count().agg(F.max("count")).first()[0] or 0
        other = self._over(rows, root)
        other.cut = most > ROWS_A_COMPANY
        return other, rows

    def _over(self, rows: DataFrame, root: str) -> Catalog:
        other = Catalog(self.spark, self.directory)
        other.written, other.facts = True, lambda **_: rows
        other.trades = rows.select(*[x for x in _TRADE if x in rows.columns])
        daily = other.trades.groupBy("ticker", F.col("traded_at").alias("at")).agg((F.max("high") * 100).alias("price_cents"), F.count("*").alias("volume"))
        daily.write.parquet(f"{root}/prices")
        other.prices = self.spark.read.schema(daily.schema).parquet(f"{root}/prices")
        return other

    @cached_property
    def scores(self) -> DataFrame:
        """Scores of every ticker at the start of every month: insiders' line items, trades, sanctions, contracts and donations."""
        of = self.branches()

        def dated(kind: str, *more: Column) -> DataFrame:
            return of[kind]().select("ticker", F.col("occurred_at").alias("at"), *more)

        cents = F.col("amount_mid").alias("cents")
        congress = self.facts(person=False).select("ticker", F.col("traded_at").alias("at"))
        form4 = self.facts(person=False, order=False).select("ticker", F.col("filed_at").alias("at"))
        return score_history(self.prices, {"form4": form4, "congress": congress, "sanction": dated("sanction"), "contract": dated("contract", cents), "donation": dated("donation", cents)})

    @cached_property
    def happenings(self) -> DataFrame:
        """Events of companies, in the years of the trades."""
        at = F.expr(f"ts - make_interval({YEARS_BACK})")
        return self.read("events").select("event_id", F.col("user_id").alias("part_id"), at.alias("at"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Edges (a, b, relationship) between customers, orders and parts, and the nodes' labels (node, label); pending orders have none."""
        orders, items = self.read("orders"), self.read("lineitem")
        edges = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"), F.lit("placed").alias("relationship"))
        edges = edges.unionByName(items.select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), F.col("l_returnflag").alias("relationship")))
        labels = self.read("customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_name").alias("label"))
        labels = labels.unionByName(self.read("part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_name").alias("label")))
        settled = orders.filter("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.concat(F.lit("order "), "o_orderkey").alias("label"))
        return edges, labels.unionByName(settled)

    @cached_property
    def source_meta(self) -> DataFrame:
        """Kinds of events as sources that are polled every so many hours."""
        meta = self.read("events").groupBy(F.col("event_type").alias("source_name")).agg(F.max("ts").alias("last_success"), (F.count("*") % 7 * 3600 + 60).alias("poll_interval_seconds"))
        return meta.withColumn("status", F.when(F.col("source_name") == "view", "degraded").otherwise("healthy"))

    def dates(self) -> dict:
        """When the rows of each branch occurred, before any join: an order stands for its lines, a tariff for its companies."""

        def of(name: str, at: Column) -> Callable[[], DataFrame]:
            return lambda: self.read(name).select(at.alias("occurred_at"))

        def happened(kind: str) -> Callable[[], DataFrame]:
            return lambda: self.happenings.filter(F.col("event_type") == kind).select(F.col("at").alias("occurred_at"))

        ordered = of("orders", F.col("o_orderdate"))
        return {
            "trade": ordered, "contract": ordered, "sanction": of("supplier", _days_on(F.col("s_suppkey") * 7 % 2400)), "donation": happened("purchase"), "lobbying": of("customer", _days_on(F.col("c_custkey") % 2400)),
            "insider": of("lineitem", F.col("l_shipdate")), "court": happened("error"), "warn": happened("signup"), "tariff": of("nation", _days_on(F.col("n_nationkey").cast("long") * 90)),
        }

    def branches(self, since: str | None = None) -> dict:
        """The nine kinds of rows of the filter language; amounts are in the branch's own unit. ``since``: the day from which on rows are asked for."""
        dims = [F.col("company").alias("company_name"), "ticker", "sector", "subsector", "market_cap"]
        orders = cache(lambda: self.orders(since))

        def cents(x: Column | str) -> Column:
            return F.round(F.col(x) * 100 if isinstance(x, str) else x * 100).cast("long")

        def trade() -> DataFrame:
            return self.facts(orders=orders()).select(
                F.col("order_id").alias("event_id"), F.col("traded_at").alias("occurred_at"), F.col("slug").alias("person_slug"), F.col("name").alias("person_name"), F.col("party").alias("person_party"),
                "person_branch", "role", F.array("committee").alias("committees"), *dims, F.col("trade_type").alias("action"), "owner", F.col("est").alias("amount_mid"), "filed_at",
            )

        def contract() -> DataFrame:
            first = self.read("lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part_id"))
            return first.join(orders(), "o_orderkey").join(self.companies, "part_id", "left").select(
                F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("occurred_at"), *dims, F.col("o_orderstatus").alias("action"), cents("o_totalprice").alias("amount_mid"),
                F.col("o_orderpriority").alias("agency"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("description"),
            )

        def sanction() -> DataFrame:
            suppliers = self.read("supplier").join(F.broadcast(self.nations), F.col("s_nationkey") == F.col("n_nationkey"))  # one row per country
            return suppliers.join(self.companies, F.col("s_suppkey") == F.col("part_id"), "left").select(
                F.col("s_suppkey").alias("event_id"), _days_on(F.col("s_suppkey") * 7 % 2400).alias("occurred_at"), *dims, F.col("region").alias("program"), F.col("state").alias("country"), F.col("s_name").alias("entity_name")
            )

        def happened(kind: str) -> DataFrame:
            return self.happenings.filter(F.col("event_type") == kind).join(self.companies, "part_id", "left")

        def donation() -> DataFrame:
            return happened("purchase").select("event_id", F.col("at").alias("occurred_at"), *dims, cents("value").alias("amount_mid"))

        def lobbying() -> DataFrame:
            return self.read("customer").join(self.companies, F.col("c_custkey") == F.col("part_id"), "left").select(
                F.col("c_custkey").alias("event_id"), _days_on(F.col("c_custkey") % 2400).alias("occurred_at"), *dims, cents("c_acctbal").alias("amount_mid"), F.col("c_name").alias("registrant")
            )

        def insider() -> DataFrame:
            supplier = self.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("filer_name"))
            rows = self.read("lineitem").join(supplier, "l_suppkey").withColumnRenamed("l_partkey", "part_id").join(self.companies, "part_id", "left")
            kind = F.when(F.col("l_returnflag") == "A", "purchase").when(F.col("l_returnflag") == "R", "sale_full").otherwise("sale_partial")
            shares = F.col("l_quantity").cast("long")
            return rows.select(
                F.col("l_orderkey").alias("event_id"), F.col("l_shipdate").alias("occurred_at"), *dims, kind.alias("action"), (shares * F.floor("l_extendedprice")).cast("long").alias("amount_mid"),
                "filer_name", F.col("l_linestatus").alias("filer_title"), shares.alias("shares"), F.col("l_shipdate").alias("filed_at"),
            )

        def court() -> DataFrame:
            return happened("error").select("event_id", F.col("at").alias("occurred_at"), *dims, F.concat(F.lit("kind "), F.col("k") % 5).alias("filing_type"))

        def warn() -> DataFrame:
            nation = F.broadcast(self.read("nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("state")))  # one row per country
            rows = happened("signup").withColumn("n", (F.col("part_id") % 25).cast("int")).join(nation, "n", "left")
            return rows.select("event_id", F.col("at").alias("occurred_at"), *dims, "state", F.floor("value").cast("long").alias("workers_affected"), F.col("at").alias("filed_at"))

        def tariff() -> DataFrame:
            """A tariff reaches companies through its codes and theirs, in two hops."""
            codes = self.companies.select("hs_code", "ticker", F.col("company").alias("company_name"), "sector")
            rows = self.nations.withColumn("hs", F.explode(F.array("n_nationkey")))
            return rows.join(codes, F.col("hs") == F.col("hs_code"), "left").select(
                F.col("n_nationkey").cast("long").alias("event_id"), _days_on(F.col("n_nationkey").cast("long") * 90).alias("occurred_at"), "ticker", "company_name", "sector", F.array("state").alias("countries")
            )

        return {f.__name__: f for f in (trade, contract, sanction, donation, lobbying, insider, court, warn, tariff)}


#: The same tables as common table expressions.
T = """t AS (SELECT c_custkey AS person_id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'D' ELSE 'I' END AS party, n_name AS state,
 c_mktsegment AS committee, p_brand AS ticker, p_type AS sector, p_name AS company, p_partkey AS part_id,
 CASE l_returnflag WHEN 'A' THEN 'purchase' WHEN 'R' THEN 'sale_full' ELSE 'sale_partial' END AS trade_type,
 CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS low, CAST(floor(l_extendedprice) AS BIGINT) AS high,
 (CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) + CAST(floor(l_extendedprice) AS BIGINT)) // 2 AS est,
 o_orderdate AS traded_at, l_shipdate AS filed_at, l_suppkey AS insider_id, l_orderkey AS order_id, l_linenumber AS line
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey)"""
PX = "px AS (SELECT ticker, traded_at AS at, max(high) * 100 AS price_cents, count(*) AS volume FROM t GROUP BY ALL)"
_LADDER = "CASE WHEN {n} = 0 THEN {0} WHEN {n} <= {a} THEN {1} WHEN {n} <= {b} THEN {2} ELSE {3} END"
SC = f"""qx AS (SELECT ticker, CAST(traded_at AS TIMESTAMP) AS at, max(high) * 100 AS price_cents, count(*) AS volume FROM t GROUP BY ALL),
fx AS (SELECT p_brand AS ticker, CAST(l_shipdate AS TIMESTAMP) AS at, 'form4' AS kind, 0::BIGINT AS cents FROM lineitem JOIN part ON l_partkey = p_partkey
 UNION ALL SELECT ticker, CAST(traded_at AS TIMESTAMP), 'congress', 0 FROM t
 UNION ALL SELECT p_brand, TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 7 % 2400 AS INT)), 'sanction', 0 FROM supplier JOIN part ON p_partkey = s_suppkey
 UNION ALL SELECT p_brand, CAST(o_orderdate AS TIMESTAMP), 'contract', CAST(round(o_totalprice * 100) AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part ON l_partkey = p_partkey
 UNION ALL SELECT p_brand, CAST(ts AS TIMESTAMP) - INTERVAL {YEARS_BACK} YEAR, 'donation', CAST(round(value * 100) AS BIGINT) FROM events JOIN part ON p_partkey = user_id WHERE event_type = 'purchase'),
sn AS (SELECT ticker, unnest(generate_series(date_trunc('month', min(at))::TIMESTAMP + INTERVAL 1 MONTH, date_trunc('month', max(at))::TIMESTAMP + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS at
 FROM (SELECT ticker, at FROM fx UNION ALL SELECT ticker, at FROM qx) GROUP BY 1),
sf AS (SELECT sn.ticker, sn.at, count(*) FILTER (kind = 'form4' AND fx.at >= sn.at - INTERVAL 30 DAY) AS form4_month, count(*) FILTER (kind = 'form4') AS form4, count(*) FILTER (kind = 'congress') AS congress,
 count(*) FILTER (kind = 'sanction') AS sanctions, coalesce(sum(cents) FILTER (kind = 'contract'), 0)::DOUBLE AS contract_cents, count(*) FILTER (kind = 'donation') AS donations, coalesce(sum(cents) FILTER (kind = 'donation'), 0)::DOUBLE AS donation_cents
 FROM sn LEFT JOIN fx ON fx.ticker = sn.ticker AND fx.at BETWEEN sn.at - INTERVAL 90 DAY AND sn.at GROUP BY 1, 2),
sp AS (SELECT sn.ticker, sn.at, list(price_cents ORDER BY qx.at)[-5:] AS recent, arg_max(volume, qx.at)::DOUBLE AS latest, avg(volume) AS usual
 FROM sn JOIN qx ON qx.ticker = sn.ticker AND qx.at BETWEEN sn.at - INTERVAL 30 DAY AND sn.at GROUP BY 1, 2),
ss AS (SELECT ticker, at, CASE WHEN recent IS NULL AND form4_month = 0 THEN 50.0::DOUBLE ELSE
 0.30::DOUBLE * CASE WHEN coalesce(len(recent), 0) < 2 OR recent[1] = 0 THEN 50.0::DOUBLE ELSE greatest(0, least(100, ((recent[-1] - recent[1])::DOUBLE / recent[1] + 0.1::DOUBLE) / 0.2::DOUBLE * 100)) END
 + 0.30::DOUBLE * CASE WHEN usual > 0 THEN greatest(0, least(100, (latest / usual - 0.5::DOUBLE) / 1.5::DOUBLE * 100)) ELSE 50.0::DOUBLE END + 0.40::DOUBLE * {_LADDER.format(50, 60, 75, 90, n="form4_month", a=2, b=5)} END AS market,
 0.40::DOUBLE * {_LADDER.format(50, 70, 85, 95, n="sanctions", a=2, b=5)} + 0.35::DOUBLE * CASE WHEN contract_cents = 0 THEN 50.0::DOUBLE WHEN contract_cents < 1e10 THEN 50 + 25 * contract_cents / 1e10 ELSE 90 END
 + 0.25::DOUBLE * {_LADDER.format(50, 60, 70, 80, n="donations", a=5, b=20)} AS policy,
 coalesce(((form4 > 0)::INT * 0.30::DOUBLE * {_LADDER.format(50, 65, 80, 90, n="form4", a=3, b=10)} + (congress > 0)::INT * 0.50::DOUBLE * CASE WHEN congress <= 2 THEN 60 WHEN congress <= 5 THEN 70 WHEN congress <= 10 THEN 80 ELSE 90 END
 + (donations > 0)::INT * 0.20::DOUBLE * CASE WHEN donation_cents = 0 THEN 50 WHEN donation_cents < 1000000 THEN 60 WHEN donation_cents < 10000000 THEN 75 ELSE 90 END)
 / nullif((form4 > 0)::INT * 0.30::DOUBLE + (congress > 0)::INT * 0.50::DOUBLE + (donations > 0)::INT * 0.20::DOUBLE, 0), 50.0::DOUBLE) AS insider FROM sf LEFT JOIN sp USING (ticker, at)),
sc AS (SELECT ticker, at AS computed_at, round(market, 4) AS market, round(policy, 4) AS policy, round(insider, 4) AS insider, round(0.35::DOUBLE * market + 0.40::DOUBLE * policy + 0.25::DOUBLE * insider, 4) AS composite FROM ss)"""

_COLUMNS = (
    "event_type", "event_id", "occurred_at", "person_slug", "person_name", "person_party", "person_branch", "ticker", "company_name", "sector", "action", "owner", "amount_mid", "agency", "program",
    "country", "state", "workers_affected", "entity_name", "description", "registrant", "filing_type", "filer_name", "filer_title", "shares", "filed_at", "subsector", "market_cap", "role", "committee", "nation", "cents",
)
_KINDS = {"event_id": "BIGINT", "cents": "BIGINT", "occurred_at": "TIMESTAMP", "filed_at": "TIMESTAMP", "amount_mid": "BIGINT", "workers_affected": "BIGINT", "shares": "BIGINT"}


def _sql_branch(kind: str, rows: str, company: bool = True, **columns: str) -> str:
    own = {"event_type": f"'{kind}'"} | columns
    if "amount_mid" in columns and columns["amount_mid"].endswith(" // 100"):
        own["cents"] = columns["amount_mid"].removesuffix(" // 100")
    if company:
        own |= {"ticker": "p_brand", "company_name": "p_name", "sector": "p_type"}
        if kind != "tariff":
            own |= {"subsector": "'group ' || (p_size // 10)", "market_cap": "CASE WHEN p_size >= 34 THEN 'large' WHEN p_size >= 17 THEN 'mid' WHEN p_size IS NOT NULL THEN 'small' END"}
    return "SELECT " + ", ".join(f"CAST({own.get(c, 'NULL')} AS {_KINDS.get(c, 'VARCHAR')}) AS {c}" for c in _COLUMNS) + f" FROM {rows}"


_TYPE = "CASE l_returnflag WHEN 'A' THEN 'purchase' WHEN 'R' THEN 'sale_full' ELSE 'sale_partial' END"
_EVENT = "(SELECT *, ts - INTERVAL 24 YEAR AS moved FROM events WHERE event_type = '{}') e LEFT JOIN part ON p_partkey = user_id"
#: The nine kinds of rows in one table, with the columns that filters look at besides.
FQ = "fq AS (" + " UNION ALL ".join((
    _sql_branch("trade", "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey", event_id="l_orderkey", occurred_at="o_orderdate",
                person_slug="lower(c_name)", person_name="c_name", person_party="CASE c_custkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'D' ELSE 'I' END", person_branch="'legislative'",
                role="CASE c_custkey % 2 WHEN 0 THEN 'senator' ELSE 'representative' END", committee="c_mktsegment", action=_TYPE, owner="l_linestatus", filed_at="l_shipdate",
                amount_mid="(CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) + CAST(floor(l_extendedprice) AS BIGINT)) // 2"),
    _sql_branch("contract", "lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = 1 LEFT JOIN part ON l_partkey = p_partkey", event_id="o_orderkey", occurred_at="o_orderdate", action="o_orderstatus",
                amount_mid="CAST(round(o_totalprice * 100) AS BIGINT) // 100", agency="o_orderpriority", description="o_orderstatus || ' ' || o_orderpriority"),
    _sql_branch("sanction", "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON p_partkey = s_suppkey", event_id="s_suppkey",
                occurred_at="TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 7 % 2400 AS INT))", program="r_name", country="n_name", entity_name="s_name"),
    _sql_branch("donation", _EVENT.format("purchase"), event_id="event_id", occurred_at="moved", amount_mid="CAST(round(value * 100) AS BIGINT) // 100"),
    _sql_branch("lobbying", "customer LEFT JOIN part ON p_partkey = c_custkey", event_id="c_custkey", occurred_at="TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2400 AS INT))",
                amount_mid="CAST(round(c_acctbal * 100) AS BIGINT) // 100", registrant="c_name"),
    _sql_branch("insider", "lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey", event_id="l_orderkey", occurred_at="l_shipdate", action=_TYPE, filer_name="s_name", filer_title="l_linestatus",
                shares="CAST(trunc(l_quantity) AS BIGINT)", amount_mid="CAST(trunc(l_quantity) AS BIGINT) * CAST(floor(l_extendedprice) AS BIGINT) // 100", filed_at="l_shipdate"),
    _sql_branch("court", _EVENT.format("error"), event_id="event_id", occurred_at="moved", filing_type="'kind ' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5)"),
    _sql_branch("warn", _EVENT.format("signup") + " LEFT JOIN nation ON n_nationkey = user_id % 25", event_id="event_id", occurred_at="moved", state="n_name", workers_affected="CAST(floor(value) AS BIGINT)", filed_at="moved"),
    _sql_branch("tariff", "nation LEFT JOIN part ON p_size % 25 = n_nationkey", event_id="n_nationkey", occurred_at="TIMESTAMP '1995-01-01' + to_days(CAST(n_nationkey * 90 AS INT))", nation="n_name"),
)) + ")"
