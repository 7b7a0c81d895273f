"""Detectors that fail or take too long, the proofs of findings, and detectors whose queries find nothing on the given tables."""

import datetime as dt
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import detect, insights, trades
from ledgerline.plans import mapping, registry
from ledgerline.plans.mapping import Catalog
from ledgerline.plans.registry import DETECTORS, RULES
from ledgerline.streaming.loads import settings

DAY = dt.datetime(2024, 1, 1)


def found(spark, n, kind="k"):
    return spark.range(n).selectExpr(f"'{kind}' as kind", "cast(id as string) as subject", "'T' as ticker", f"timestamp'{DAY}' as at", "cast(id as double) as rarity", "'{}' as data")


def test_one_failing_detector_leaves_the_others(spark):
    def fails():
        return found(spark, 5).selectExpr("*", "raise_error('broken data') as boom").withColumn("data", __import__("pyspark.sql.functions", fromlist=["col"]).col("boom").cast("string"))

    def refuses():
        raise ValueError("no such table")

    findings, status = detect.detect(spark, {"a": lambda: found(spark, 3, "a"), "fails": fails, "refuses": refuses, "none": lambda: found(spark, 0), "b": lambda: found(spark, 2, "b")}, 60)
    got = {r["detector"]: (r["ok"], r["findings"]) for r in status.collect()}
    assert got == {"a": (True, 3), "fails": (False, 0), "refuses": (False, 0), "none": (True, 0), "b": (True, 2)}
    errors = {r["detector"]: r["error"] for r in status.collect()}
    assert "no such table" in errors["refuses"] and errors["fails"] and errors["a"] is None
    assert {r["kind"] for r in findings.collect()} == {"a", "b"} and findings.count() == 5


def test_a_slow_detector_is_stopped(spark):
    def slow():
        return spark.range(1 << 40).selectExpr("'slow' as kind", "cast(sum(hash(id)) as string) as subject", "'' as ticker", f"timestamp'{DAY}' as at", "0.0D as rarity", "'' as data").limit(1)

    began = time.time()
    findings, status = detect.detect(spark, {"slow": slow, "quick": lambda: found(spark, 1, "quick")}, 20)
    took = time.time() - began
    got = {r["detector"]: (r["ok"], r["error"]) for r in status.collect()}
    assert took < 120 and got["slow"][0] is False and got["slow"][1].startswith("stopped after 20") and got["quick"] == (True, None)
    assert [r["kind"] for r in findings.collect()] == ["quick"]


def test_findings_of_a_failed_detector_are_no_result(spark):
    def refuses():
        raise ValueError("no such table")

    good = {"a": lambda: found(spark, 3, "a"), "b": lambda: found(spark, 2, "b")}
    assert detect.whole(*detect.detect(spark, good, None)).count() == 5
    with pytest.raises(RuntimeError, match="refuses: ValueError: no such table"):
        detect.whole(*detect.detect(spark, good | {"refuses": refuses}, None))


def test_findings_ranked_and_its_dataset_fail_with_a_detector(spark, monkeypatch):
    def refuses(c):
        raise ValueError("disk is full")

    given = found(spark, 3).withColumn("rarity", F.lit(50.0))
    monkeypatch.setattr(Catalog, "by_company", lambda self, root, columns: (self, given))
    monkeypatch.setattr(registry, "DETECTORS", {"fine": (lambda c: given, "", ()), "lone_wolf": (refuses, "", ())})
    for run in (registry.QUERIES["findings_ranked"], lambda s, d: registry._published(Catalog(s, d))):
        monkeypatch.setattr(registry, "PUBLISHED", {"insights": ("findings_ranked", ())})
        with pytest.raises(RuntimeError, match="lone_wolf: ValueError: disk is full"):
            run(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(registry, "DETECTORS", {"fine": (lambda c: given, "", ())})
    assert registry.QUERIES["findings_ranked"](spark, "/root/testdata/sf0.001").count() == 3


def test_nothing_to_detect(spark):
    findings, status = detect.detect(spark, {})
    assert findings.count() == 0 and status.count() == 0


def test_all_detectors_read_one_table_of_trades(spark, tmp_path):
    """With trades written once, no detector's plan has a scan of line items."""
    shared = Catalog(spark, "/root/testdata/sf0.001").once(str(tmp_path))
    assert shared.trades.count() == Catalog(spark, "/root/testdata/sf0.001").trades.count()
    for name, (build, _, _) in DETECTORS.items():
        plan = build(shared)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan, name


def test_a_company_lies_together_for_detectors(spark, tmp_path):
    """Detectors of companies don't shuffle trades, which before were dealt anew by every one of them."""
    shared, kept = Catalog(spark, "/root/testdata/sf0.001").by_company(str(tmp_path), registry.DETECTED)
    try:
        assert not shared.cut and {"state", "company", "insider_id"}.isdisjoint(kept.columns)  # no detector reads those
        with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
            for name, dealt in (("coordinated", 0), ("bipartisan", 0), ("insider_echo", 0), ("pre_event", 1), ("court_trade", 1), ("committee_insider", 1)):  # events alone
                plan = registry.DETECTORS[name][0](shared)._jdf.queryExecution().executedPlan().toString()
                own = plan.partition("InMemoryRelation")[0].count("Exchange") if dealt == 0 else len(re.findall(r"Exchange hashpartitioning\(part_id#\d+L?, \d+\), ENSURE", plan))
                assert own == dealt, name
        assert shared.by_company(f"{tmp_path}/again", registry.DETECTED)[0].trades.count() == shared.trades.count()
    finally:
        kept.unpersist()


def test_findings_of_a_company_with_many_trades_are_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mapping, "ROWS_A_COMPANY", 1)
    many, kept = Catalog(spark, "/root/testdata/sf0.001").by_company(f"{tmp_path}/many", registry.DETECTED)
    monkeypatch.setattr(mapping, "ROWS_A_COMPANY", 10**9)
    few, other = Catalog(spark, "/root/testdata/sf0.001").by_company(f"{tmp_path}/few", registry.DETECTED)
    assert many.cut and not few.cut
    for name in ("pre_event", "committee_insider", "insider_echo"):
        got = [sorted(map(tuple, registry.DETECTORS[name][0](c).collect())) for c in (many, few, Catalog(spark, "/root/testdata/sf0.001"))]
        assert got[0] == got[1] == got[2] and got[0], name
    kept.unpersist()
    other.unpersist()


def finding(spark, kind, data, subject="7", ticker="T"):
    return spark.createDataFrame([(kind, subject, ticker, DAY + dt.timedelta(days=20), 50.0, data)], detect.FINDING)


@pytest.mark.parametrize(
    ("kind", "data", "steps"),
    [
        ("pre_event", '{"gap":4,"est":12000}', [(21, "trade", "person 7 traded T ($12K)"), (25, "event", "event of T")]),
        ("round_trip", '{"hold_days":9,"est":2500000}', [(12, "trade", "person 7 buy T ($2.5M)"), (21, "trade", "person 7 sell T")]),
        ("coordinated_trades", '{"reps":5,"kinds":1}', [(21, "cluster", "5 persons traded T")]),
        ("committee_relevant", '{"est":1,"committee":"Energy"}', [(21, "trade", "person 7 traded T (committee: Energy)")]),
        ("lone_wolf", '{"est":90,"middle":20,"trade_type":"purchase"}', [(21, "trade", "person 7 outsized purchase T (4.5 times the usual)")]),
        ("something_else", "{}", [(21, "event", "something_else T")]),
    ],
)
def test_proofs(spark, kind, data, steps):
    got = insights.proof_steps(finding(spark, kind, data)).orderBy("place").collect()
    assert [(r["date"].day, r["step"], r["label"]) for r in got] == steps and [r["place"] for r in got] == list(range(1, len(steps) + 1))


def test_solo_tickers_and_sector_rotation_on_a_fixture(spark):
    solo = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B"), (3, "B"), (None, "C"), (4, "D")], "person_id long, ticker string")
    assert {r["ticker"]: (r["person_id"], r["trades"]) for r in trades.solo_tickers(solo, "ticker").collect() if r["ticker"] != "C"} == {"A": (1, 2), "D": (4, 1)}
    at = dt.datetime(2024, 5, 10)
    rows = [("x", "purchase", 800, at), ("y", "purchase", 200, at), ("y", "sale_full", 9999, at)] + [(s, "purchase", 100, at - dt.timedelta(days=40)) for s in "xy"] + [("x", "purchase", 10**6, at - dt.timedelta(days=200)), ("y", "purchase", 10**6, at + dt.timedelta(days=5))]
    df = spark.createDataFrame(rows, "sector string, trade_type string, est long, traded_at timestamp")
    got = {r["ticker"]: (r["rarity"], r["data"]) for r in insights.sector_rotation(df, "2024-05-12").collect()}
    assert {k: v[0] for k, v in got.items()} == {"x": 100.0, "y": 100.0} and '"shift":30.0' in got["x"][1] and '"shift":-30.0' in got["y"][1]


def test_rules_of_the_queries_are_those_of_the_sql():
    assert {part for part, _ in RULES} == {"BUILD", "AUTO", "MACHINE"}
