"""Source payloads to bronze events: source, source_id, event_type, occurred_at, event_data.

A JSON source is described by its schema, the path of its records, the parts of its id and its date; one plan parses them all. ``raw`` has one row per response:
body, ingest_ts (the date of a record whose own can't be read).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hashed, id_text, parse_time
from .store import last_of

MAX_PAYLOAD = 64 * 1024
MAX_DEPTH = 10


@dataclass(frozen=True)
class JsonSource:
    name: str
    event_type: str
    schema: str  # of the response
    records: str  # path of the array
    id_parts: tuple[str, ...]  # SQL over a record r
    date: str


SOURCES = {
    s.name: s
    for s in (
        JsonSource("polygon", "market_daily", "results array<struct<symbol:string,o:double,h:double,l:double,c:double,v:double,t:bigint>>", "results", ("r.symbol", "date_format(timestamp_millis(r.t), 'yyyy-MM-dd')"), "date_format(timestamp_millis(r.t), 'yyyy-MM-dd')"),
        JsonSource("fec", "political_contribution", "results array<struct<sub_id:string,contributor_name:string,contribution_receipt_amount:double,contribution_receipt_date:string,committee_name:string,contributor_employer:string,contributor_occupation:string>>", "results", ("r.sub_id",), "r.contribution_receipt_date"),
        JsonSource("usaspending", "government_contract", "results array<struct<`Award ID`:string,`Recipient Name`:string,`Award Amount`:double,`Award Type`:string,`Start Date`:string,`Awarding Agency`:string>>", "results", ("r.`Award ID`",), "r.`Start Date`"),
        JsonSource("federal_register", "regulatory_action", "results array<struct<document_number:string,title:string,type:string,abstract:string,publication_date:string,effective_on:string,cfr_references:array<struct<title:int,part:string>>>>", "results", ("r.document_number",), "r.publication_date"),
        JsonSource("edgar_form4", "insider_trade", "hits struct<hits:array<struct<_source:struct<adsh:string,file_num:string,display_names:array<string>,form_type:string,file_date:string,period_of_report:string,entity_name:string>>>>", "hits.hits._source", ("coalesce(r.adsh, r.file_num)",), "coalesce(r.file_date, r.period_of_report)"),
        JsonSource("ofac_sdn", "sanction_designation", "sdnList array<struct<uid:bigint,firstName:string,lastName:string,sdnType:string,programs:array<string>,dateAdded:string>>", "sdnList", ("r.uid",), "r.dateAdded"),
        JsonSource("lambda_congress", "congressional_trade", "trades array<struct<symbol:string,representative:string,transactionDate:string,disclosureDate:string,type:string,amount:string,chamber:string,party:string,state:string,owner:string>>", "trades", ("r.representative", "r.symbol", "r.transactionDate", "r.type"), "r.transactionDate"),
        JsonSource("finnhub_congress", "congressional_trade", "data array<struct<amountFrom:double,amountTo:double,assetName:string,filingDate:string,name:string,ownerType:string,symbol:string,transactionDate:string,transactionType:string>>", "data", ("r.name", "r.symbol", "r.transactionDate", "r.transactionType"), "r.transactionDate"),
        JsonSource("finnhub", "market_trade", "type string, data array<struct<s:string,p:double,v:double,t:bigint>>", "data", ("r.s", "r.t"), "date_format(timestamp_millis(r.t), \"yyyy-MM-dd'T'HH:mm:ss\")"),
        JsonSource("courtlistener", "judicial_disclosure", "results array<struct<id:bigint,person:string,year:int,investments:array<struct<id:bigint,description:string,redacted:boolean,gross_value_code:string,transaction_during_reporting_period:string,transaction_date:string,transaction_value_code:string>>>>", "results", ("r.disclosure_id", "r.investment_id"), "r.transaction_date"),
        JsonSource("lobbying", "lobbying_disclosure", "results array<struct<filing_id:string,registrant:string,client:string,specific_issues:string,amount:double,period_start:string,period_end:string,filed_at:string>>", "results", ("r.filing_id",), "r.filed_at"),
        JsonSource("oge", "executive_disclosure", "data array<struct<name:string,agency:string,title:string,type:string,docDate:string,link:string>>", "data", ("r.name", "r.docDate", "r.type"), "r.docDate"),
    )
}
#: Sources whose response is the array itself.
ARRAYS = {
    s.name: s
    for s in (
        JsonSource("fmp_congress", "congressional_trade", "array<struct<symbol:string,disclosureDate:string,transactionDate:string,firstName:string,lastName:string,owner:string,type:string,amount:string>>", "", ("concat_ws(' ', r.firstName, r.lastName)", "r.symbol", "r.transactionDate", "r.type"), "r.transactionDate"),
        JsonSource("house_clerk_ptr", "congressional_trade", "array<struct<disclosure_date:string,transaction_date:string,owner:string,ticker:string,type:string,amount:string,representative:string,ptr_link:string,party:string,state:string>>", "", ("r.ptr_link", "r.ticker", "r.transaction_date", "r.type"), "r.transaction_date"),
        JsonSource("senate_stock_watcher", "congressional_trade", "array<struct<transaction_date:string,owner:string,ticker:string,type:string,amount:string,senator:string,ptr_link:string>>", "", ("r.ptr_link", "r.ticker", "r.transaction_date", "r.type"), "r.transaction_date"),
    )
}


def depth(json: Column) -> Column:
    """How deep objects and arrays of a JSON text are nested: the largest excess of opening over closing brackets, outside strings."""
    bare = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.when(c.isin("{", "["), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda acc, x: F.struct((acc["now"] + x).alias("now"), F.greatest(acc["most"], acc["now"] + x).alias("most")), lambda acc: acc["most"])


def fine(json: Column) -> Column:
    """Whether a payload is small and flat enough to keep."""
    opened = F.length(json) - F.length(F.translate(json, "[{", ""))  # no text is deeper than it has opening brackets
    return (F.octet_length(json) <= MAX_PAYLOAD) & ((opened <= MAX_DEPTH) | (depth(json) <= MAX_DEPTH))


def refused(events: DataFrame) -> DataFrame:
    """How many payloads of every source are too large or too deep."""
    large, deep = F.octet_length("event_data") > MAX_PAYLOAD, depth(F.col("event_data")) > MAX_DEPTH
    return events.groupBy("source").agg(F.count("*").alias("events"), F.count_if(large).alias("too_large"), F.count_if(~large & deep).alias("too_deep"))


def unformula(text: Column) -> Column:
    """A field that no spreadsheet takes for a formula."""
    return F.ltrim(text, F.lit("=+-@"))


def _events(records: DataFrame, name: str, kind: str, id_parts: tuple[Column, ...], date: Column, data: Column, checked: bool = True) -> DataFrame:
    # what an id is made of is in the payload too and packs well beside it, its hash doesn't: ids are hashed, and constants added, after the shuffle
    out = records.select(
        id_text(*id_parts).alias("__id"), F.coalesce(parse_time(date), F.col("ingest_ts")).alias("occurred_at"), F.to_json(data).alias("event_data"), F.col("ingest_ts").alias("__ingest"), F.col("pos").alias("__pos"),
    )
    out = out.filter(fine(F.col("event_data"))) if checked else out
    last = last_of(out, ["__id"], "__ingest", "__pos")
    return last.select(F.lit(name).alias("source"), hashed(F.col("__id")).alias("source_id"), F.lit(kind).alias("event_type"), "occurred_at", "event_data")


def _shaped(records: DataFrame, source: str) -> DataFrame:
    """Records as their source's payloads have them, where those differ from what it sends."""
    r = F.col("r")
    if source == "fec":
        clean = {c: unformula(r[c]) for c in ("contributor_name", "committee_name", "contributor_employer", "contributor_occupation")}
        for name, c in clean.items():
            records = records.withColumn("r", F.col("r").withField(name, c))
    elif source == "oge":
        link = F.regexp_extract(F.coalesce(r["link"], F.lit("")), r'''href=["']([^"']+)["']''', 1)
        records = records.withColumn("r", r.withField("pdf_url", link))
    elif source == "edgar_form4":  # a scalar or an array of them
        number = F.coalesce(F.get_json_object(r["file_num"], "$[0]"), r["file_num"])
        records = records.withColumn("r", r.withField("file_num", number))
    elif source == "courtlistener":  # a record for each transaction: not for mere holdings, nor for what is redacted
        each = records.select("ingest_ts", F.col("pos").alias("outer"), "r.id", "r.person", "r.year", F.posexplode("r.investments").alias("inner", "i"))
        each = each.filter((F.coalesce("i.transaction_during_reporting_period", F.lit("")) != "") & ~F.coalesce("i.redacted", F.lit(False)))
        records = each.select("ingest_ts", F.struct("outer", "inner").alias("pos"), F.struct(F.col("id").alias("disclosure_id"), F.col("i.id").alias("investment_id"), "person", "year", "i.description", "i.transaction_during_reporting_period",
                                                    "i.transaction_date", "i.transaction_value_code", "i.gross_value_code").alias("r"))
    elif source == "finnhub":  # pings carry nothing
        records = records.filter("r.s is not null and r.s <> ''")
    return records


def parse_json(raw: DataFrame, source: str, checked: bool = True) -> DataFrame:
    """Bronze events of a JSON source; bodies that don't parse give none. ``checked``: without payloads that are too large or too deep, which ``refused`` counts."""
    if source in ARRAYS:
        s = ARRAYS[source]
        records = raw.select("ingest_ts", F.posexplode(F.from_json("body", s.schema)).alias("pos", "r"))
    else:
        s = SOURCES[source]
        if source == "polygon":  # its records have fields T and t, and names don't tell case apart
            raw = raw.withColumn("body", F.regexp_replace("body", r'"T"(\s*:)', '"symbol"$1'))
        path = F.from_json("body", s.schema).getField(s.records) if "." not in s.records else F.expr(f"from_json(body, '{s.schema}').{s.records}")
        records = raw.select("ingest_ts", F.posexplode(path).alias("pos", "r"))
    return _events(_shaped(records, source), s.name, s.event_type, tuple(F.expr(p) for p in s.id_parts), F.expr(s.date), F.col("r"), checked)


def parse_litigation(raw: DataFrame) -> DataFrame:
    """Litigation releases of an RSS feed; the release number is the creator, or title and date where there is none."""
    pieces = F.regexp_extract_all("body", F.lit(r"(?s)<item[ >].*?</item>"), F.lit(0))
    items = raw.select("ingest_ts", F.posexplode(pieces).alias("pos", "x"))

    def tag(name: str) -> Column:
        inner = F.regexp_extract("x", rf"(?s)<{name}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1)
        for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            inner = F.replace(inner, F.lit(entity), F.lit(c))
        return F.trim(inner)

    own = items.select("ingest_ts", "pos", tag("title").alias("title"), tag("link").alias("url"), tag("pubDate").alias("at"), tag("dc:creator").alias("creator"))
    name = F.when(F.col("creator") != "", F.col("creator")).otherwise(F.concat_ws("|", "title", "at"))
    own = own.withColumn("id", name).withColumn("date", F.date_format(F.coalesce(parse_time(F.col("at")), F.col("ingest_ts")), "yyyy-MM-dd"))
    return _events(own, "sec_edgar_lit", "sec_litigation", (F.lit("sec_edgar_lit"), F.col("id")), F.col("at"), F.struct("id", "date", "title", "url"))


def parse_ofac_xml(raw: DataFrame) -> DataFrame:
    """The XML form of the sanctions list, with the payload that the JSON form gives."""
    schema = "uid bigint, firstName string, lastName string, sdnType string, programList struct<program:array<string>>, dateAdded string"
    pieces = F.regexp_extract_all("body", F.lit(r"(?s)<sdnEntry[ >].*?</sdnEntry>"), F.lit(0))
    r = raw.select("ingest_ts", F.posexplode(pieces).alias("pos", "x")).select("ingest_ts", "pos", F.from_xml("x", schema).alias("x"))
    r = r.select("ingest_ts", "pos", F.struct("x.uid", "x.firstName", "x.lastName", "x.sdnType", F.col("x.programList.program").alias("programs"), "x.dateAdded").alias("r"))
    return _events(r, "ofac_sdn", "sanction_designation", (F.col("r.uid"),), F.col("r.dateAdded"), F.col("r"))


def seed_companies(raw: DataFrame) -> DataFrame:
    """Companies of a JSON list (ticker, name, sector), each ticker once: the last of a list counts."""
    rows = raw.select(F.posexplode(F.from_json("body", "array<struct<ticker:string,name:string,sector:string>>")).alias("pos", "r")).select("pos", "r.*").filter("ticker is not null")
    return last_of(rows, ["ticker"], "pos").drop("pos")


def with_names(companies: DataFrame, reference: DataFrame) -> DataFrame:
    """Companies whose name is only their ticker get the name of the reference data (ticker, name), if it has one."""
    known = reference.filter("name is not null").groupBy("ticker").agg(F.min("name").alias("__name"))
    name = F.when(F.coalesce("name", F.lit("")).isin("") | (F.col("name") == F.col("ticker")), F.coalesce("__name", "name")).otherwise(F.col("name"))
    return companies.join(known, "ticker", "left").withColumn("name", name).drop("__name")


def parse_xml(raw: DataFrame, source: str, event_type: str, tag: str, schema: str, id_field: str, date_field: str) -> DataFrame:
    """Bronze events of an XML source whose records are the elements ``tag`` (no nesting of the same tag)."""
    pieces = F.regexp_extract_all("body", F.lit(rf"(?s)(<{tag}[ >].*?</{tag}>)"), F.lit(1))
    records = raw.select("ingest_ts", F.posexplode(pieces).alias("pos", "x")).select("ingest_ts", "pos", F.from_xml("x", schema).alias("r"))
    return _events(records, source, event_type, (F.col(f"r.{id_field}"),), F.col(f"r.{date_field}"), F.col("r"))


def parse_html_rows(raw: DataFrame, source: str, event_type: str, columns: tuple[str, ...], id_columns: tuple[str, ...], date_column: str) -> DataFrame:
    """Bronze events of an HTML table: a row per ``tr`` with as many ``td`` cells; tags and common entities are removed."""
    rows = F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "tr")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), "&amp;", "&"), r"&nbsp;|\s+", " "))
    cells = raw.select("ingest_ts", rows).withColumn("td", F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), clean))
    cells = cells.filter(F.size("td") == len(columns)).select("ingest_ts", "pos", F.struct(*[F.get("td", F.lit(i)).alias(c) for i, c in enumerate(columns)]).alias("r"))
    return _events(cells, source, event_type, tuple(F.col(f"r.{c}") for c in id_columns), F.col(f"r.{date_column}"), F.col("r"))
