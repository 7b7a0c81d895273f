"""Feeds: the tables' rows as the payloads that sources send, parsed and turned into typed facts, each with its SQL.

A payload holds the rows of a bounded range of keys. What comes back is compared with what the tables hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import payloads, typed
from .mapping import Catalog

#: What a line item is told apart by.
LINE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice))"
LINE_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT)"
#: Keys of a payload.
KEYS = 50
NAME = "concat('Company ', p_brand)"
LETTERS = "concat('Q', translate(substring(p_brand, 7), '0123456789', 'ABCDEFGHIJ'))"
LETTERS_SQL = "'Q' || translate(substr(p_brand, 7), '0123456789', 'ABCDEFGHIJ')"
CO = f"co AS (SELECT p_brand AS brand, {LETTERS_SQL} AS ticker, min(p_partkey) AS company_id, 'Company ' || p_brand AS company FROM part GROUP BY 1, 2)"
#: Line items with order, customer and company.
LI = "li AS (SELECT l.*, o.*, c_name, co.company_id, co.ticker, co.company FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN co ON co.brand = p_brand)"
KIND_SQL = "CASE l_returnflag WHEN 'A' THEN 'purchase' WHEN 'R' THEN 'sale_full' ELSE 'sale_partial' END"


def raw(rows: DataFrame, key: str, record: Column, before: str, after: str, keys: int = KEYS) -> DataFrame:
    """body, ingest_ts: the records of so many keys each, between a beginning and an end."""
    own = rows.select((F.expr(f"{key} div {keys}") if keys > 1 else F.col(key)).alias("g"), record.alias("r"))
    packed = own.groupBy("g").agg(F.array_join(F.collect_list("r"), "" if before.startswith("<") else ",").alias("r"))
    return packed.select(F.concat(F.lit(before), "r", F.lit(after)).alias("body"), F.lit("2024-01-01").cast("timestamp").alias("ingest_ts"))


def json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()]))


def companies(c: Catalog) -> DataFrame:
    return c.read("part").groupBy(F.expr(LETTERS).alias("ticker"), F.expr(NAME).alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "ticker", "name")


def known(c: Catalog) -> tuple[DataFrame, DataFrame]:
    return companies(c), c.spark.createDataFrame([], "entity_id long, alias string")


def lines(c: Catalog) -> DataFrame:
    """Line items with order, customer and company. Lines meet orders by the range of keys of a payload, so that they needn't move again for their payload; within it the difference tells orders apart, since
    an equal key would be hashed too."""
    sold = c.read("lineitem").join(c.read("part"), F.col("l_partkey") == F.col("p_partkey"))
    placed = c.read("orders").join(c.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = sold.join(placed, (F.expr(f"l_orderkey div {KEYS}") == F.expr(f"o_orderkey div {KEYS}")) & (F.col("l_orderkey") - F.col("o_orderkey") == 0))
    return own.withColumns({"ticker": F.expr(LETTERS), "company": F.expr(NAME), "kind": F.expr("CASE l_returnflag WHEN 'A' THEN 'Purchase' WHEN 'R' THEN 'Sale (Full)' ELSE 'Sale (Partial)' END"), "day": F.date_format("o_orderdate", "yyyy-MM-dd")})


def moved(c: Catalog, kind: str) -> DataFrame:
    own = c.read("events").filter(F.col("event_type") == kind).join(c.read("part"), F.col("user_id") == F.col("p_partkey"))
    return own.withColumns({"ticker": F.expr(LETTERS), "company": F.expr(NAME), "day": F.date_format("ts", "yyyy-MM-dd")})


def _daily(c: Catalog) -> DataFrame:
    own = lines(c).groupBy("ticker", F.to_date("o_orderdate").alias("on")).agg(F.floor(F.max("l_extendedprice")).cast("long").alias("top"), F.count("*").alias("v"))
    return own.withColumn("days", F.unix_date("on"))


def market(c: Catalog) -> DataFrame:
    """Daily prices as one source sends them."""
    record = json(T="ticker", o="cast(top as double) - 1", c="cast(top as double)", v="cast(v as double)", t="cast(days as bigint) * 86400000")
    events = payloads.parse_json(raw(_daily(c), "days", record, '{"results":[', "]}"), "polygon")
    facts = typed.market_data(events, *known(c))
    return facts.select("company_id", "data_type", "price_cents", "volume", F.to_date("recorded_at").alias("day"), "change_pct")


def ticks(c: Catalog) -> DataFrame:
    """The same prices as ticks of a stream; every other payload is a ping."""
    record = json(s="ticker", p="cast(top as double)", v="cast(v as double)", t="cast(days as bigint) * 86400000")
    feed = raw(_daily(c), "days", record, '{"type":"trade","data":[', "]}")
    feed = feed.unionByName(feed.select(F.lit('{"type":"ping"}').alias("body"), "ingest_ts"))
    facts = typed.market_data(payloads.parse_json(feed, "finnhub"), *known(c))
    return facts.select("company_id", "data_type", "price_cents", "volume", F.to_date("recorded_at").alias("day"))


def donated(c: Catalog) -> DataFrame:
    """Purchases as contributions by employees; those of view users are retired."""
    employer = F.expr("CASE WHEN event_id % 9 = 0 THEN 'Retired' ELSE lower(company) END")
    record = json(sub_id="cast(event_id as string)", contributor_name="concat('=Donor ', user_id)", contribution_receipt_amount="value", contribution_receipt_date="day", committee_name="'Some Committee'", contributor_employer=employer)
    facts = typed.donations(payloads.parse_json(raw(moved(c, "purchase"), "event_id", record, '{"results":[', "]}"), "fec"), *known(c))
    return facts.select("company_id", "donor_name", "donor_employer", "recipient", "amount_cents", F.to_date("donated_at").alias("day"))


def awarded(c: Catalog) -> DataFrame:
    own = lines(c).filter("l_linenumber = 1")
    record = F.to_json(F.struct(
        F.expr(LINE).alias("Award ID"), F.upper("company").alias("Recipient Name"), F.col("o_totalprice").cast("double").alias("Award Amount"), F.col("o_orderstatus").alias("Award Type"),
        F.col("day").alias("Start Date"), F.col("o_orderpriority").alias("Awarding Agency"),
    ))
    facts = typed.contracts(payloads.parse_json(raw(own, "o_orderkey", record, '{"results":[', "]}"), "usaspending"), *known(c))
    return facts.select("company_id", "agency", "amount_cents", "action_type", "description", F.to_date("awarded_at").alias("day"))


def form4(c: Catalog) -> DataFrame:
    record = F.concat(F.lit('{"_source":'), json(adsh=LINE, display_names="array(concat('Supplier ', l_suppkey, ' (CIK 1)'), concat(company, ' (CIK 2)'))", file_date="date_format(l_shipdate, 'yyyy-MM-dd')"), F.lit("}"))
    facts = typed.insider_trades(payloads.parse_json(raw(lines(c), "l_orderkey", record, '{"hits":{"hits":[', "]}}"), "edgar_form4"), *known(c))
    return facts.select("company_id", "filer_name", "trade_type", F.to_date("filed_at").alias("day")).groupBy("company_id", "filer_name", "trade_type", "day").agg(F.count("*").alias("n"))


def _suppliers(c: Catalog) -> DataFrame:
    own = c.read("supplier").join(c.nations, F.col("s_nationkey") == F.col("n_nationkey")).join(c.read("part"), F.col("s_suppkey") == F.col("p_partkey"), "left")
    return own.withColumn("person", F.col("s_suppkey") % 3 == 0)


def sanctioned(c: Catalog) -> DataFrame:
    record = json(uid="s_suppkey", firstName="CASE WHEN person THEN 'Jan' END", lastName=f"CASE WHEN person THEN s_name ELSE coalesce({NAME}, s_name) END", sdnType="CASE WHEN person THEN 'Individual' ELSE 'Entity' END", programs="array(region, 'OTHER')", dateAdded="'2024-02-03'")
    facts = typed.sanctions(payloads.parse_json(raw(_suppliers(c), "s_suppkey", record, '{"sdnList":[', "]}"), "ofac_sdn"), *known(c))
    return facts.select("source_id", "company_id", "entity_name", "entity_type", "program")


def sanctioned_xml(c: Catalog) -> DataFrame:
    record = F.expr(f"concat('<sdnEntry><uid>', s_suppkey, '</uid><lastName>', coalesce({NAME}, s_name), '</lastName><sdnType>Entity</sdnType><programList><program>', region, '</program><program>OTHER</program></programList></sdnEntry>')")
    facts = typed.sanctions(payloads.parse_ofac_xml(raw(_suppliers(c), "s_suppkey", record, "<sdnList>", "</sdnList>")), *known(c))
    return facts.select("source_id", "company_id", "entity_name", "entity_type", "program")


def duties(c: Catalog) -> DataFrame:
    record = json(
        document_number="state", title="concat('Duty on ', state)", type="CASE n_nationkey % 3 WHEN 0 THEN 'Rule' WHEN 1 THEN 'Proposed Rule' ELSE 'Notice' END", effective_on="'2024-05-01'",
        cfr_references="array(named_struct('title', CASE WHEN n_nationkey % 5 = 0 THEN 40 ELSE 19 END, 'part', CASE WHEN n_nationkey % 2 = 0 THEN '12' ELSE '13' END))",
    )
    facts = typed.tariffs(payloads.parse_json(raw(c.nations, "n_nationkey", record, '{"results":[', "]}"), "federal_register"))
    return facts.select("action_type", F.to_date("effective_at").alias("day"))


#: Sources of persons' trades: what a record has, how it is wrapped, and whether a record has an id of its own.
TRADES = {
    "house_clerk_ptr": ({"ticker": "ticker", "representative": "concat('Hon. ', c_name)", "transaction_date": "day", "type": "kind", "amount": "amount", "ptr_link": LINE, "disclosure_date": "filed"}, "[", "]", True),
    "senate_stock_watcher": ({"ticker": "ticker", "senator": "concat('Sen. ', c_name)", "transaction_date": "day", "type": "kind", "amount": "amount", "ptr_link": LINE}, "[", "]", True),
    "lambda_congress": ({"symbol": "ticker", "representative": "c_name", "transactionDate": "day", "disclosureDate": "filed", "type": "kind", "amount": "amount"}, '{"trades":[', "]}", False),
    "fmp_congress": ({"symbol": "ticker", "firstName": "'Ann'", "lastName": "c_name", "transactionDate": "day", "disclosureDate": "filed", "type": "kind", "amount": "amount"}, "[", "]", False),
    "finnhub_congress": ({"symbol": "ticker", "name": "c_name", "transactionDate": "day", "filingDate": "filed", "transactionType": "kind", "amountFrom": "1001D", "amountTo": "15000D"}, '{"data":[', "]}", False),
}


def persons_trades(c: Catalog, source: str) -> DataFrame:
    fields, before, after, own_id = TRADES[source]
    rows = lines(c).withColumns({"amount": F.expr("concat('$', format_number(floor(l_extendedprice * (1 - l_discount)), 0), ' - $', format_number(floor(l_extendedprice), 0))"), "filed": F.date_format("l_shipdate", "yyyy-MM-dd")})
    facts = typed.congressional_trades(payloads.parse_json(raw(rows, "l_orderkey", json(**fields), before, after), source), *known(c))
    kept = ["company_id", "person_slug", "ticker", "trade_type", F.to_date("traded_at").alias("day")]
    return facts.select(*kept, "amount_range_low", "amount_range_high") if own_id else facts.select(*kept)


def judged(c: Catalog) -> DataFrame:
    """Orders as disclosures, their lines as investments: returned lines are redacted, and those still open are mere holdings."""
    own = lines(c).groupBy(F.expr(f"l_orderkey div {KEYS}").alias("page"), "o_orderkey", "o_custkey").agg(F.collect_list(F.struct(
        F.xxhash64(F.expr(LINE)).alias("id"), F.concat("company", F.lit(" ("), "ticker", F.lit(") - Stock")).alias("description"), (F.col("l_returnflag") == "R").alias("redacted"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN '' ELSE kind END").alias("transaction_during_reporting_period"), F.col("day").alias("transaction_date"), F.lit("K").alias("transaction_value_code"),
    )).alias("investments"))
    record = json(id="o_orderkey", person="concat('https://x/people/', o_custkey, '/')", year="2020", investments="investments")
    facts = typed.congressional_trades(payloads.parse_json(raw(own, "page", record, '{"results":[', "]}", 1), "courtlistener"), *known(c))
    return facts.select("company_id", "person_slug", "ticker", "trade_type", "amount_range_low", "amount_range_high", F.to_date("traded_at").alias("day"))


def litigated(c: Catalog) -> DataFrame:
    record = F.expr("concat('<item><title>SEC Charges Nobody ', event_id, ' and ', company, ' for Fraud &amp; Theft</title><link>http://x/', event_id, '</link><pubDate>', date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT</pubDate><dc:creator>LR-', event_id, '</dc:creator></item>')")
    facts = typed.court_filings(payloads.parse_litigation(raw(moved(c, "error"), "event_id", record, "<rss><channel>", "</channel></rss>")), *known(c))
    return facts.select("company_id", "case_number", "court", "filing_type", "parties", F.to_date("filed_at").alias("day"))


def laid_off(c: Catalog) -> DataFrame:
    record = F.expr("concat('<tr><td>CA</td><td>', date_format(ts, 'MM/dd/yyyy'), '</td><td>03/05/2024</td><td><b>', company, '</b></td><td>', cast(floor(value) as int), '</td><td>City ', event_id, '</td></tr>')")
    columns = ("state", "notice_date", "effective_date", "company", "employees_affected", "city")
    events = payloads.parse_html_rows(raw(moved(c, "signup"), "event_id", record, "<table><tr><th>a</th></tr>", "</table>"), "warn", "warn_filing", columns, ("state", "company", "notice_date", "city"), "notice_date")
    return typed.warn_filings(events, *known(c)).select("company_id", "state", "city", "workers_affected", F.to_date("filed_at").alias("day"))


def disclosed(c: Catalog) -> DataFrame:
    """Customers as paper disclosures in XML: bronze events only, with the slug that such filers have."""
    record = F.expr("concat('<filing><report_id>', c_custkey, '</report_id><first_name>Ann B</first_name><last_name>', c_name, '</last_name><filing_date>01/02/2024</filing_date></filing>')")
    feed = raw(c.read("customer"), "c_custkey", record, "<filings>", "</filings>")
    events = payloads.parse_xml(feed, "efds_senate", "congressional_disclosure", "filing", "report_id string, first_name string, last_name string, filing_date string", "report_id", "filing_date")
    return events.select("source", "source_id", "event_type", F.to_date("occurred_at").alias("day"), typed.filing_slug(typed.get("first_name"), typed.get("last_name")).alias("slug"))


def executive(c: Catalog) -> DataFrame:
    record = json(name="c_name", agency="c_mktsegment", title="'Chief'", type="'Annual'", docDate="'2024-03-04'", link="concat('<a href=\"http://x/', c_custkey, '.pdf\">pdf</a>')")
    events = payloads.parse_json(raw(c.read("customer"), "c_custkey", record, '{"data":[', "]}"), "oge")
    return events.select("source", "source_id", "event_type", F.to_date("occurred_at").alias("day"), typed.get("pdf_url").alias("url"))


def lobbied(c: Catalog) -> DataFrame:
    """Customers as registrants whose client is the company of the part with their number."""
    own = c.read("customer").join(c.read("part"), F.col("c_custkey") == F.col("p_partkey"), "left")
    record = json(filing_id="cast(c_custkey as string)", registrant="c_name", client=f"upper({NAME})", specific_issues="c_mktsegment", amount="cast(c_acctbal as double)", period_start="'2024-01-01'", period_end="'03/31/2024'", filed_at="'2024-04-20'")
    facts = typed.lobbying(payloads.parse_json(raw(own, "c_custkey", record, '{"results":[', "]}"), "lobbying"), *known(c))
    return facts.select("client_company_id", "registrant", "client", "specific_issues", "amount_cents", F.to_date("period_end").alias("period_end"), F.to_date("filed_at").alias("day"))


def seeds(c: Catalog) -> DataFrame:
    """Companies of a list; where it names one by its ticker alone, reference data have the name."""
    own = c.read("part").groupBy(F.expr(LETTERS).alias("ticker"), F.expr(NAME).alias("name")).agg(F.min("p_partkey").alias("k"))
    record = json(ticker="ticker", name="CASE WHEN k % 2 = 0 THEN ticker ELSE name END", sector="'Technology'")
    return payloads.with_names(payloads.seed_companies(raw(own, "k", record, "[", "]").select("body")), own.select("ticker", "name"))


def register(add) -> None:
    def feed(name: str, sql: str, build, *tables: str) -> None:
        add(f"feed_{name}", sql, build, CO, *tables)

    daily = "dy AS (SELECT company_id, ticker, o_orderdate::DATE AS day, floor(max(l_extendedprice))::BIGINT AS top, count(*) AS volume FROM li GROUP BY 1, 2, 3)"
    feed("market_data", "SELECT company_id, 'daily' AS data_type, top * 100 AS price_cents, volume, day, round(1.0::DOUBLE / nullif(CASE WHEN top > 1 THEN top - 1 END, 0) * 100, 6) AS change_pct FROM dy", market, LI, daily)
    feed("ticks", "SELECT company_id, 'trade' AS data_type, top * 100 AS price_cents, volume, day FROM dy", ticks, LI, daily)
    event = "FROM events JOIN part ON user_id = p_partkey JOIN co ON co.brand = p_brand WHERE event_type = '{}'"
    feed("donations", "SELECT company_id, 'Donor ' || user_id AS donor_name, lower(company) AS donor_employer, 'Some Committee' AS recipient, round(value * 100)::BIGINT AS amount_cents, ts::DATE AS day " + event.format("purchase") + " AND event_id % 9 <> 0", donated)
    feed("contracts", f"SELECT DISTINCT company_id, o_orderpriority AS agency, round(o_totalprice * 100)::BIGINT AS amount_cents, o_orderstatus AS action_type, {LINE_SQL} AS description, o_orderdate::DATE AS day FROM li WHERE l_linenumber = 1", awarded, LI)
    feed("insider_trades", f"SELECT company_id, 'Supplier ' || l_suppkey AS filer_name, 'form4' AS trade_type, l_shipdate::DATE AS day, count(DISTINCT {LINE_SQL}) AS n FROM li GROUP BY 1, 2, 3, 4", form4, LI)
    sup = "sp AS (SELECT s_suppkey, s_name, r_name, s_suppkey % 3 = 0 AS person, company, company_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON p_partkey = s_suppkey LEFT JOIN co ON co.brand = p_brand)"
    feed("sanctions", "SELECT sha256(s_suppkey::VARCHAR) AS source_id, CASE WHEN NOT person THEN company_id END AS company_id, CASE WHEN person THEN 'Jan ' || s_name ELSE coalesce(company, s_name) END AS entity_name, CASE WHEN person THEN 'individual' ELSE 'entity' END AS entity_type, r_name AS program FROM sp", sanctioned, sup)
    feed("sanctions_xml", "SELECT sha256(s_suppkey::VARCHAR) AS source_id, company_id, coalesce(company, s_name) AS entity_name, 'entity' AS entity_type, r_name AS program FROM sp", sanctioned_xml, sup)
    feed("tariffs", "SELECT 'Duty on ' || n_name AS action_type, DATE '2024-05-01' AS day FROM nation WHERE n_nationkey % 3 < 2 AND n_nationkey % 5 <> 0 AND n_nationkey % 2 = 0", duties)
    for source, (fields, *_, own_id) in TRADES.items():
        who = "'ann-' || " if source == "fmp_congress" else ""
        slug = f"{who}regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g')"
        if own_id:
            sql = f"SELECT * EXCLUDE (line) FROM (SELECT DISTINCT {LINE_SQL} AS line, company_id, {slug} AS person_slug, ticker, {KIND_SQL} AS trade_type, o_orderdate::DATE AS day, floor(l_extendedprice * (1 - l_discount))::BIGINT AS amount_range_low, floor(l_extendedprice)::BIGINT AS amount_range_high FROM li)"
        else:
            sql = f"SELECT DISTINCT company_id, {slug} AS person_slug, ticker, {KIND_SQL} AS trade_type, o_orderdate::DATE AS day FROM li"
        feed(source, sql, lambda c, s=source: persons_trades(c, s), LI)
    feed("judicial_trades", f"SELECT * EXCLUDE (line) FROM (SELECT DISTINCT {LINE_SQL} AS line, company_id, 'judge-cl-' || o_custkey AS person_slug, ticker, {KIND_SQL} AS trade_type, 50001::BIGINT AS amount_range_low, 100000::BIGINT AS amount_range_high, o_orderdate::DATE AS day FROM li WHERE l_linestatus <> 'O' AND l_returnflag <> 'R')", judged, LI)
    feed("litigation", "SELECT company_id, 'LR-' || event_id AS case_number, 'SEC' AS court, 'sec_litigation' AS filing_type, 'Nobody ' || event_id || '; ' || company AS parties, ts::DATE AS day " + event.format("error"), litigated)
    feed("warn_filings", "SELECT company_id, 'CA' AS state, 'City ' || event_id AS city, floor(value)::INT AS workers_affected, ts::DATE AS day " + event.format("signup"), laid_off)
    feed("paper_disclosures", "SELECT 'efds_senate' AS source, sha256(c_custkey::VARCHAR) AS source_id, 'congressional_disclosure' AS event_type, DATE '2024-01-02' AS day, 'ann-b-' || lower(c_name) AS slug FROM customer", disclosed)
    feed("executive_disclosures", "SELECT 'oge' AS source, sha256(c_name || '|2024-03-04|Annual') AS source_id, 'executive_disclosure' AS event_type, DATE '2024-03-04' AS day, 'http://x/' || c_custkey || '.pdf' AS url FROM customer", executive)
    feed("seed_companies", "SELECT ticker, company AS name, 'Technology' AS sector FROM co", seeds)
    feed("lobbying", "SELECT company_id AS client_company_id, c_name AS registrant, upper(company) AS client, c_mktsegment AS specific_issues, round(c_acctbal * 100)::BIGINT AS amount_cents, DATE '2024-03-31' AS period_end, DATE '2024-04-20' AS day FROM customer LEFT JOIN part ON p_partkey = c_custkey LEFT JOIN co ON co.brand = p_brand", lobbied)
