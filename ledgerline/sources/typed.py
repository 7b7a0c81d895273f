"""Bronze events to typed facts, one plan for each kind, dispatched by source.

A fact's key is (source, source_id, line), so that an event which is read again replaces its facts. Companies are resolved as in ``sinks.resolve``; what resolves to none keeps a null
company, except where a fact makes no sense without one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import amount_range, parse_time, slugify, trade_kind
from .sinks import hits

#: Employers that name no company.
NO_EMPLOYER = ("SELF-EMPLOYED", "RETIRED", "N/A", "NONE", "NOT EMPLOYED")
#: Parts of title 19 that make a rule a tariff.
TARIFF_TITLE, TARIFF_PARTS = 19, ("12", "134", "159", "163")
#: Codes of disclosed values and their ranges in dollars; the last has no upper bound.
VALUE_CODES = {
    "J": (15001, 50000), "K": (50001, 100000), "L": (100001, 250000), "M": (250001, 500000), "N": (500001, 1000000),
    "O": (1000001, 5000000), "P1": (5000001, 25000000), "P2": (25000001, 50000000), "P3": (50000001, None),
}
#: How titles of litigation releases begin, and what ends the parties.
VERBS = ("Charges ", "Files Action Against ", "Obtains ", "Announces ", "Settles With ", "Orders ", "Sues ")
ENDS = (" for ", " with ", " in ", " Related to ")
KEY = ["source", "source_id"]


def get(path: str) -> Column:
    return F.get_json_object("event_data", f"${path}" if path.startswith("[") else f"$.{path}")


def trimmed(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def cents(c: Column) -> Column:
    return F.round(c.try_cast("double") * 100).cast("long")


def ticker_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\(([A-Z]{1,5})\)", 1), F.lit(""))


def value_range(code: Column) -> tuple[Column, Column]:
    low = high = F.lit(None).cast("long")
    for name, (a, b) in VALUE_CODES.items():
        low, high = F.when(code == name, F.lit(a).cast("long")).otherwise(low), F.when(code == name, F.lit(b).cast("long")).otherwise(high)
    return low, high


def parties_of(title: Column) -> Column:
    """The parties that a release's title names."""
    t = F.regexp_replace(title, r"^SEC ", "")
    t = F.regexp_replace(t, "^(" + "|".join(VERBS) + ")", "")
    cut = t
    for end in reversed(ENDS):  # the first kind of end that occurs counts
        cut = F.when(F.instr(t, end) > 1, F.substring(t, F.lit(1), F.instr(t, end) - 1)).otherwise(cut)
    return F.filter(F.transform(F.split(cut, " and "), lambda p: F.trim(p)), lambda p: p != "")


def filing_slug(first: Column, last: Column) -> Column:
    """The slug of a filer of paper disclosures: only spaces become dashes."""
    return F.replace(F.lower(F.concat(F.trim(first), F.lit("-"), F.trim(last))), F.lit(" "), F.lit("-"))


def cleaned_name(name: Column) -> Column:
    """A person's name without titles, however many it begins with."""
    return F.trim(F.regexp_replace(F.trim(name), r"(?i)^((hon|rep|sen|mr|mrs|ms|dr)\.?\s+|(honorable|representative|senator)\s+)+", ""))


def party_letter(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.startswith("r"), "R").when(t.startswith("d"), "D").when(t.startswith("i"), "I")


def _with_company(events: DataFrame, companies: DataFrame, aliases: DataFrame, ticker: Column | None, name: Column | None, *columns: Column | str) -> DataFrame:
    """``columns`` of the events, ``company_id`` among them. Only distinct pairs of ticker and name are resolved, so that a name which many events have costs no more than any other. The columns are worked
    out before the join with what was found, so that it carries no payloads."""
    none = F.lit(None).cast("string")
    own = events.withColumns({"__ticker": none if ticker is None else ticker, "__name": none if name is None else name})
    names = own.select(F.col("__ticker").alias("ticker"), F.col("__name").alias("name")).distinct().withColumn("id", F.to_json(F.struct("ticker", "name")))
    found = hits(names, companies, aliases).select(F.col("id").alias("__id"), "company_id")
    own = own.select(*[c for c in columns if not (isinstance(c, str) and c == "company_id")], F.to_json(F.struct(F.col("__ticker").alias("ticker"), F.col("__name").alias("name"))).alias("__id"))
    out = own.join(found, "__id", "left")
    kept = iter([c for c in own.columns if c != "__id"])
    return out.select(*["company_id" if isinstance(c, str) and c == "company_id" else next(kept) for c in columns])


def market_data(events: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    daily = F.col("source") == "polygon"
    own = events.filter(F.col("source").isin("polygon", "finnhub"))
    first, last = get("o").cast("double"), get("c").cast("double")
    return _with_company(
        own, companies, aliases, F.when(daily, get("symbol")).otherwise(get("s")), None, *KEY, "company_id", F.when(daily, "daily").otherwise("trade").alias("data_type"), F.when(daily, cents(get("c"))).otherwise(cents(get("p"))).alias("price_cents"),
        get("v").try_cast("double").cast("long").alias("volume"), F.when(daily & (first > 0), F.round((last - first) / first * 100, 6)).alias("change_pct"), F.col("occurred_at").alias("recorded_at"),
    ).filter("company_id is not null")


def donations(events: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    employer = trimmed(get("contributor_employer"))
    own = events.filter((F.col("source") == "fec") & employer.isNotNull() & ~F.upper(employer).isin(*NO_EMPLOYER))
    return _with_company(
        own, companies, aliases, None, employer, *KEY, "company_id", get("contributor_name").alias("donor_name"), F.lit("individual").alias("donor_type"), employer.alias("donor_employer"), get("committee_name").alias("recipient"),
        cents(get("contribution_receipt_amount")).alias("amount_cents"), parse_time(get("contribution_receipt_date")).alias("donated_at"),
    ).filter("company_id is not null")


def contracts(events: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    own = events.filter(F.col("source") == "usaspending")
    return _with_company(
        own, companies, aliases, None, trimmed(get("['Recipient Name']")), *KEY, "company_id", get("['Awarding Agency']").alias("agency"), cents(get("['Award Amount']")).alias("amount_cents"), get("['Award Type']").alias("action_type"),
        get("['Award ID']").alias("description"), parse_time(get("['Start Date']")).alias("awarded_at"),
    ).filter("company_id is not null")


def sanctions(events: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """Of individuals the whole name and no company; of entities the name that may be a company's. The first program counts."""
    person = F.lower(F.coalesce(get("sdnType"), F.lit(""))) == "individual"
    own = events.filter(F.col("source") == "ofac_sdn")
    whole = F.concat_ws(" ", trimmed(get("firstName")), trimmed(get("lastName")))
    return _with_company(
        own, companies, aliases, None, F.when(~person, trimmed(get("lastName"))), *KEY, "company_id", F.when(person, whole).otherwise(F.trim(get("lastName"))).alias("entity_name"), F.when(person, "individual").otherwise("entity").alias("entity_type"),
        get("programs[0]").alias("program"), F.col("occurred_at").alias("added_at"),
    )


def warn_filings(events: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    return _with_company(
        events.filter(F.col("source") == "warn"), companies, aliases, None, trimmed(get("company")), *KEY, "company_id", get("state").alias("state"), get("city").alias("city"), get("employees_affected").try_cast("int").alias("workers_affected"),
        parse_time(get("effective_date")).alias("layoff_date"), parse_time(get("notice_date")).alias("filed_at"),
    )


def insider_trades(events: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """The company is the second display name, without its registration number; the filer is the first."""
    name = F.trim(F.regexp_replace(F.coalesce(get("display_names[1]"), get("entity_name"), get("display_names[0]")), r"\s*\(CIK.*$|\s*\([A-Z]{1,5}\).*$", ""))
    own, filer = events.filter(F.col("source") == "edgar_form4"), F.trim(F.regexp_replace(get("display_names[0]"), r"\s*\(CIK.*$", ""))
    return _with_company(own, companies, aliases, ticker_in(get("display_names[1]")), name, *KEY, "company_id", filer.alias("filer_name"), F.lit("form4").alias("trade_type"), F.col("occurred_at").alias("filed_at"))


def court_filings(events: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """The company is that of the first party that resolves to one."""
    own = events.filter(F.col("source") == "sec_edgar_lit").withColumn("parties", parties_of(get("title")))
    each = own.select(*KEY, F.posexplode("parties").alias("at", "party"))
    numbered = each.withColumn("source_id", F.concat_ws("#", "source_id", "at"))
    found = _with_company(numbered, companies, aliases, None, F.col("party"), *KEY, "at", "company_id").filter("company_id is not null")
    first = found.groupBy("source", F.substring_index("source_id", "#", 1).alias("source_id")).agg(F.min_by("company_id", "at").alias("company_id"))
    return own.join(first, KEY, "left").select(
        *KEY, "company_id", get("id").alias("case_number"), F.lit("SEC").alias("court"), F.lit("sec_litigation").alias("filing_type"), F.array_join("parties", "; ").alias("parties"),
        parse_time(get("date")).alias("filed_at"),
    )


def tariffs(events: DataFrame, companies: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    references = F.from_json(get("cfr_references"), "array<struct<title:int,part:string>>")
    named = F.exists(references, lambda r: (r["title"] == TARIFF_TITLE) & r["part"].isin(*TARIFF_PARTS))
    own = events.filter((F.col("source") == "federal_register") & get("type").isin("Rule", "Proposed Rule") & F.coalesce(named, F.lit(False)))
    return own.select(*KEY, get("title").alias("action_type"), parse_time(get("effective_on")).alias("effective_at"))


def congressional_trades(events: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """Trades of all sources that report persons' trades; the person is known by a slug."""
    source = F.col("source")

    def pick(**by: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, c in by.items():
            out = F.when(source == name, c).otherwise(out)
        return out

    judge = F.concat(F.lit("judge-cl-"), F.nullif(F.regexp_extract(get("person"), r"/people/(\d+)/", 1), F.lit("")))
    whole = F.concat_ws(" ", get("firstName"), get("lastName"))
    own = events.filter(source.isin("fmp_congress", "lambda_congress", "finnhub_congress", "courtlistener", "house_clerk_ptr", "senate_stock_watcher"))
    ticker = pick(fmp_congress=get("symbol"), lambda_congress=get("symbol"), finnhub_congress=get("symbol"), courtlistener=ticker_in(get("description")), house_clerk_ptr=get("ticker"), senate_stock_watcher=get("ticker"))
    own = own.withColumn("ticker", trimmed(ticker)).filter("ticker is not null and ticker not in ('--', 'N/A', 'OT')")
    slug = pick(
        fmp_congress=slugify(whole), lambda_congress=slugify(get("representative")), finnhub_congress=slugify(get("name")), courtlistener=judge,
        house_clerk_ptr=slugify(cleaned_name(get("representative"))), senate_stock_watcher=slugify(cleaned_name(get("senator"))),
    )
    kind = pick(fmp_congress=get("type"), lambda_congress=get("type"), finnhub_congress=get("transactionType"), courtlistener=get("transaction_during_reporting_period"), house_clerk_ptr=get("type"), senate_stock_watcher=get("type"))
    text_low, text_high = amount_range(get("amount"))
    code_low, code_high = value_range(F.coalesce(trimmed(get("transaction_value_code")), get("gross_value_code")))
    low = F.when(source == "courtlistener", code_low).when(source == "finnhub_congress", get("amountFrom").try_cast("double").cast("long")).otherwise(text_low)
    high = F.when(source == "courtlistener", code_high).when(source == "finnhub_congress", get("amountTo").try_cast("double").cast("long")).otherwise(text_high)
    filed = pick(fmp_congress=get("disclosureDate"), lambda_congress=get("disclosureDate"), finnhub_congress=get("filingDate"), house_clerk_ptr=get("disclosure_date"))
    return _with_company(
        own, companies, aliases, F.col("ticker"), None, *KEY, "company_id", slug.alias("person_slug"), "ticker", trade_kind(kind).alias("trade_type"), low.alias("amount_range_low"), high.alias("amount_range_high"),
        parse_time(filed).alias("filed_at"), F.col("occurred_at").alias("traded_at"),
    )


def lobbying(events: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lobbying records; the company is the client."""
    client = trimmed(get("client"))
    return _with_company(
        events.filter(F.col("source") == "lobbying"), companies, aliases, None, client, *KEY, "company_id", get("registrant").alias("registrant"), client.alias("client"), get("specific_issues").alias("specific_issues"), cents(get("amount")).alias("amount_cents"),
        parse_time(get("period_start")).alias("period_start"), parse_time(get("period_end")).alias("period_end"), F.col("occurred_at").alias("filed_at"),
    ).withColumnRenamed("company_id", "client_company_id")


FACTS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    f.__name__: f for f in (market_data, donations, contracts, sanctions, warn_filings, insider_trades, court_filings, tariffs, congressional_trades, lobbying)
}


def extract(events: DataFrame, companies: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """All typed facts of a table of events. Sources without typed facts stay in bronze."""
    return {name: make(events, companies, aliases) for name, make in FACTS.items()}
