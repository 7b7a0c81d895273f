"""Payloads of every source to typed facts, held against rows worked out by hand."""

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import lookups
from ledgerline.plans import feed_queries
from ledgerline.plans.mapping import Catalog
from ledgerline.sources import payloads, sinks, typed
from ledgerline.streaming.loads import settings

#: source, payload, kind of facts, columns, rows: what comes of the payload, worked out by hand.
INGESTED = {
    "market_data": ("polygon", '{"results":[{"T":"AAPL","o":100.0,"h":111.0,"l":99.0,"c":110.255,"v":5000.0,"t":1704153600000},{"T":"NONE","o":1.0,"c":1.0,"v":1.0,"t":1704153600000}]}',
                    "company_id, data_type, price_cents, volume, change_pct", [(1, "daily", 11026, 5000, 10.255)]),
    "donations": ("fec", '{"results":[{"sub_id":"1","contributor_name":"=Ann Lee","contribution_receipt_amount":250.5,"contribution_receipt_date":"2024-02-03","committee_name":"Some Committee","contributor_employer":"acme widgets"},{"sub_id":"2","contributor_employer":"Retired","contribution_receipt_amount":9.0},{"sub_id":"3","contributor_name":"Bo","contributor_employer":"Widget Works","contribution_receipt_amount":7.0}]}',
                  "company_id, donor_name, donor_employer, recipient, amount_cents", [(2, "Ann Lee", "acme widgets", "Some Committee", 25050), (2, "Bo", "Widget Works", None, 700)]),
    "contracts": ("usaspending", '{"results":[{"Award ID":"W1","Recipient Name":"LOCKHEED MARTIN CORPORATION","Award Amount":1234567.89,"Award Type":"DEFINITIVE","Start Date":"2024-03-01","Awarding Agency":"Department of Defense"},{"Award ID":"W2","Recipient Name":"Nobody Known","Award Amount":5.0}]}',
                  "company_id, agency, amount_cents, action_type, description", [(3, "Department of Defense", 123456789, "DEFINITIVE", "W1")]),
    "sanctions": ("ofac_sdn", '{"sdnList":[{"uid":5,"firstName":"Jan","lastName":"Doe","sdnType":"Individual","programs":["SDGT","IRAN"]},{"uid":6,"lastName":"Acme Widgets","sdnType":"Entity","programs":["CUBA"]},{"uid":7,"lastName":"Other Ltd","sdnType":"Entity"}]}',
                  "company_id, entity_name, entity_type, program", [(None, "Jan Doe", "individual", "SDGT"), (2, "Acme Widgets", "entity", "CUBA"), (None, "Other Ltd", "entity", None)]),
    "tariffs": ("federal_register", '{"results":[{"document_number":"d1","title":"Duties","type":"Rule","effective_on":"2024-05-01","cfr_references":[{"title":19,"part":"12"}]},{"document_number":"d2","title":"Other","type":"Rule","cfr_references":[{"title":40,"part":"12"}]},{"document_number":"d3","title":"Notice","type":"Notice","cfr_references":[{"title":19,"part":"12"}]}]}',
                "action_type", [("Duties",)]),
    "judicial_trades": ("courtlistener", '{"results":[{"id":9,"person":"https://x/people/1234/","year":2020,"investments":[{"id":1,"description":"Apple Inc (AAPL) - Stock","redacted":false,"transaction_during_reporting_period":"Sale","transaction_date":"2020-05-06","transaction_value_code":"K"},{"id":2,"description":"Held (AAPL)","redacted":false,"transaction_during_reporting_period":""},{"id":3,"description":"Secret","redacted":true,"transaction_during_reporting_period":"Buy"},{"id":4,"description":"Apple (AAPL)","redacted":false,"transaction_during_reporting_period":"Buy","gross_value_code":"P3"}]}]}',
                        "company_id, person_slug, ticker, trade_type, amount_range_low, amount_range_high", [(1, "judge-cl-1234", "AAPL", "sale_full", 50001, 100000), (1, "judge-cl-1234", "AAPL", "purchase", 50000001, None)]),
    "senate_trades": ("senate_stock_watcher", '[{"ticker":"AAPL","senator":"Hon. Ann B. Lee","transaction_date":"05/06/2024","type":"Sale (Partial)","amount":"$1,001 - $15,000","ptr_link":"p"},{"ticker":"AAPL","senator":"Hon. Ann B. Lee","transaction_date":"05/06/2024","type":"Sale (Partial)","amount":"$1,001 - $15,000","ptr_link":"p"},{"ticker":"--","senator":"X","transaction_date":"05/06/2024","type":"Purchase","ptr_link":"q"}]',
                      "company_id, person_slug, ticker, trade_type, amount_range_low, amount_range_high", [(1, "ann-b-lee", "AAPL", "sale_partial", 1001, 15000)]),
    "litigation": ("sec_edgar_lit", "<rss><channel><item><title>SEC Charges Acme Widgets and John Doe for Fraud &amp; Theft</title><link>http://x/1</link><pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate><dc:creator>LR-26531</dc:creator></item></channel></rss>",
                   "company_id, case_number, court, filing_type, parties", [(2, "LR-26531", "SEC", "sec_litigation", "Acme Widgets; John Doe")]),
    "warn_filings": ("warn", "<table><tr><th>County</th><th>Notice</th></tr><tr><td>CA</td><td>01/05/2024</td><td>03/05/2024</td><td>Apple Inc.</td><td>120</td><td>Cupertino</td></tr></table>",
                     "company_id, state, city, workers_affected", [(1, "CA", "Cupertino", 120)]),
}
FACT_OF = {"judicial_trades": "congressional_trades", "senate_trades": "congressional_trades", "litigation": "court_filings"}


def raw(spark, body):
    return spark.createDataFrame([(body, dt.datetime(2024, 1, 1))], "body string, ingest_ts timestamp")


@pytest.fixture(scope="module")
def known(spark):
    companies = [(1, "AAPL", "Apple Inc."), (2, "ACM", "Acme Widgets Corporation"), (3, "LMT", "Lockheed Martin Corp")]
    return spark.createDataFrame(companies, "id long, ticker string, name string"), spark.createDataFrame([(2, "WIDGET WORKS")], "entity_id long, alias string")


def parsed(spark, source, body):
    if source == "sec_edgar_lit":
        return payloads.parse_litigation(raw(spark, body))
    if source == "warn":
        return payloads.parse_html_rows(raw(spark, body), "warn", "warn_filing", ("state", "notice_date", "effective_date", "company", "employees_affected", "city"), ("state", "company", "notice_date"), "notice_date")
    return payloads.parse_json(raw(spark, body), source)


@pytest.mark.parametrize("name", list(INGESTED))
def test_payloads_become_facts(spark, known, name):
    source, body, columns, rows = INGESTED[name]
    got = typed.FACTS[FACT_OF.get(name, name)](parsed(spark, source, body), *known).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_payloads_that_are_too_large_or_too_deep(spark):
    df = spark.createDataFrame([("a", "[" * 11 + "]" * 11), ("a", '{"x": "[[[[[[[[[[[[ \\" [["}'), ("a", '"' + "x" * 70_000 + '"')], "source string, event_data string")
    assert [tuple(r) for r in payloads.refused(df).collect()] == [("a", 3, 1, 1)]


def test_sanctions_in_xml(spark, known):
    body = "<sdnList><sdnEntry><uid>6</uid><lastName>Acme Widgets</lastName><sdnType>Entity</sdnType><programList><program>CUBA</program><program>IRAN</program></programList></sdnEntry></sdnList>"
    facts = typed.sanctions(payloads.parse_ofac_xml(raw(spark, body)), *known)
    assert [tuple(r) for r in facts.select("company_id", "entity_name", "program").collect()] == [(2, "Acme Widgets", "CUBA")]


def test_names_match_prefixes_either_way(spark, known):
    names = spark.createDataFrame([(1, "Apple"), (2, "Lockheed Martin Corp of Texas"), (3, "app"), (4, "nobody")], "id long, name string")
    assert {tuple(r) for r in lookups.search_names(names, known[0]).select("id", "company_id").collect()} == {(1, 1), (2, 3), (3, 1)}


def test_parties_keep_their_digits(spark):
    """Only white space around a party goes."""
    titles = spark.createDataFrame([("SEC Charges Nobody 10 and Company 21 and Fund 2  for Fraud",)], "title string")
    assert titles.select(typed.parties_of(F.col("title")).alias("p")).first()["p"] == ["Nobody 10", "Company 21", "Fund 2"]


def test_a_common_name_is_resolved_once(spark, known):
    """Many events of one name come to one row before names are resolved."""
    rows = [("fec", str(i), f'{{"contributor_employer":"acme widgets","contribution_receipt_amount":{i}}}', dt.datetime(2024, 1, 1)) for i in range(300)]
    events = spark.createDataFrame(rows, "source string, source_id string, event_data string, occurred_at timestamp")
    facts = typed.donations(events, *known)
    assert facts.filter("company_id = 2").count() == 300


def test_names_are_read_once_however_many_keys_they_have(spark):
    """Each reading of the names costs another pass over all events."""
    names = spark.range(3, 8).selectExpr("id", "'T' || id AS ticker", "'Name ' || id AS name")
    companies, aliases = spark.createDataFrame([(1, "T3", "Name")], "id long, ticker string, name string"), spark.createDataFrame([], "entity_id long, alias string")
    found = sinks.hits(names, companies, aliases)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (3, 8") == 1
    assert {tuple(r) for r in found.collect()} == {(i, 1) for i in range(3, 8)}


def test_companies_meet_facts_without_payloads(spark, known):
    events = payloads.parse_json(raw(spark, INGESTED["senate_trades"][1]), "senate_stock_watcher")
    plan = typed.congressional_trades(events, *known).select("company_id", "ticker")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_data" not in plan.split("Join LeftOuter")[1].split("\n")[1]


def _exchanges(df):
    """The keys that shuffles of a plan deal rows by, all joins being joins by shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*), \d+\), ", plan)


def test_a_line_moves_once_for_its_order_and_payload(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        of = feed_queries.persons_trades(Catalog(spark, "/root/testdata/sf0.001"), "house_clerk_ptr")
        keys = [re.sub(r"#\d+L?", "", k) for k in _exchanges(of)]
    assert "(l_orderkey div 50)" in keys and "l_orderkey" not in keys and "g" not in keys  # before: by order, by customer and by payload


def test_lines_of_repeated_orders_stay(spark, tmp_path):
    for name in ("lineitem", "orders", "part", "customer"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (rows.unionByName(rows.filter("o_orderkey < 10")) if name == "orders" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    c = Catalog(spark, str(tmp_path))
    plain = c.read("lineitem").join(c.read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.read("part"), F.col("l_partkey") == F.col("p_partkey")).join(c.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "p_brand", "c_name"]
    assert sorted(map(tuple, feed_queries.lines(c).select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_ids_are_hashed_after_the_shuffle(spark):
    body = '[{"ticker":"AAPL","senator":"Ann","transaction_date":"2024-05-06","type":"Purchase","amount":"$1 - $2","ptr_link":"p"}]'
    events = payloads.parse_json(raw(spark, body), "senate_stock_watcher")
    assert events.columns == ["source", "source_id", "event_type", "occurred_at", "event_data"]
    assert events.first()["source_id"] == hashlib.sha256(b"p|AAPL|2024-05-06|Purchase").hexdigest()
    below = events._jdf.queryExecution().executedPlan().toString().partition("Exchange")[2]
    assert below and "sha2" not in below  # before, 64 letters that can't be packed went with every row
