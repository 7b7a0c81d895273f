"""Merges by key: last writers, partitions that a load doesn't touch, retention."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import payloads, sinks, store

DAY = dt.datetime(2024, 1, 1)
KIND = "source string, source_id string, at timestamp, seq long, data string, company long"


@pytest.fixture
def events(spark, tmp_path):
    return store.EventStore(spark, str(tmp_path / "events"), KIND, ["source", "source_id"], "at", ["seq"], ("company",))


def load(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], KIND)


def files(events):
    return {str(p): p.stat().st_mtime_ns for p in Path(events.root).rglob("*.parquet")}


def test_a_load_rewrites_only_the_days_it_touches(spark, events):
    events.merge(load(spark, *[(f"k{d}-{i}", DAY + dt.timedelta(days=d, hours=i), 1, "old", d) for d in range(6) for i in range(3)]))
    before = files(events)
    counts = events.merge(load(spark, ("k1-0", DAY + dt.timedelta(days=1), 2, "new", None), ("k2-0", DAY + dt.timedelta(days=4), 2, "moved", 7), ("more", DAY + dt.timedelta(days=9), 2, "added", None)))
    assert counts == {"rewritten": 4, "emptied": 0, "untouched": 3}
    kept = {p for p, at in files(events).items() if before.get(p) == at}
    assert {p.split("day=")[1][:10] for p in kept} == {"2024-01-01", "2024-01-04", "2024-01-06"}
    got = {r["source_id"]: (r["at"].day, r["data"], r["company"]) for r in events.rows().collect()}
    assert len(got) == events.rows().count() == 19
    assert got["k1-0"] == (2, "new", 1) and got["k2-0"] == (5, "moved", 7) and got["more"] == (10, "added", None) and got["k2-1"] == (3, "old", 2)


def test_the_last_writer_stays_in_whatever_order_loads_come(spark, events):
    rows = [("a", DAY, 1, "first", 5), ("a", DAY, 3, "last", None), ("a", DAY, 2, "middle", 6), ("b", None, 1, "no time", None)]
    events.merge(load(spark, *rows))
    want = {("s", "a", DAY, 3, "last", 6), ("s", "b", None, 1, "no time", None)}
    assert {tuple(r) for r in events.rows().collect()} == want
    for again in (rows, [("a", DAY + dt.timedelta(days=3), 0, "late comer", 9)], rows[::-1]):
        events.merge(load(spark, *again))
        assert {tuple(r) for r in events.rows().collect()} == want


def test_a_day_whose_rows_all_move_goes(spark, events):
    events.merge(load(spark, ("a", DAY, 1, "x", None), ("b", DAY + dt.timedelta(days=1), 1, "y", None)))
    assert events.merge(load(spark, ("a", DAY + dt.timedelta(days=5), 2, "x", None))) == {"rewritten": 1, "emptied": 1, "untouched": 1}
    assert events.days() == ["2024-01-02", "2024-01-06"] and events.rows().count() == 2
    assert events.merge(load(spark).limit(0)) == {"rewritten": 0, "emptied": 0, "untouched": 2}


def test_retention_drops_days_and_cuts_one(spark, events):
    events.merge(load(spark, *[(f"{d}-{h}", DAY + dt.timedelta(days=d, hours=h), 1, "x", None) for d in range(5) for h in (1, 13)], ("none", None, 1, "x", None)))
    facts = spark.createDataFrame([("s", f"{d}-{h}", d) for d in range(5) for h in (1, 13)], "src string, sid string, amount long")
    before = files(events)
    assert events.retain("2024-01-03 12:00:00") == ["2024-01-01", "2024-01-02"]
    assert {r["source_id"] for r in events.rows().collect()} == {"2-13", "3-1", "3-13", "4-1", "4-13", "none"}
    assert sorted(p.split("day=")[1][:10] for p, at in files(events).items() if before.get(p) == at) == ["2024-01-04", "2024-01-05", "none/part-"]
    assert sorted(r["sid"] for r in events.prune_facts(facts, ["src", "sid"]).collect()) == ["2-13", "3-1", "3-13", "4-1", "4-13"]
    assert events.retain("2024-01-03 23:00:00") == ["2024-01-03"]


def test_upserts_take_the_last_by_order(spark):
    old = spark.createDataFrame([("a", "old", 1)], "k string, data string, company int")
    for rows in ([("a", "early", 7, 1), ("a", "late", None, 2)], [("a", "late", None, 2), ("a", "early", 7, 1)]):
        new = spark.createDataFrame(rows, "k string, data string, company int, at int")
        assert [tuple(r) for r in sinks.upsert(old, new, ["k"], ("company",), ("at",)).collect()] == [("a", "late", 7)]
        assert {tuple(r) for r in sinks.insert_missing(old.limit(0), new, ["k"], ("at",)).collect()} == {("a", "early", 7)}
        assert {tuple(r) for r in sinks.insert_missing(old, new, ["k"], ("at",)).collect()} == {("a", "old", 1)}


def test_the_last_record_of_a_payload_counts(spark):
    body = '{"results":[{"sub_id":"1","contributor_name":"early"},{"sub_id":"2"},{"sub_id":"1","contributor_name":"late"}]}'
    first, second = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    raw = spark.createDataFrame([(body, first), (body.replace("late", "latest"), second), (body.replace("late", "older"), first)], "body string, ingest_ts timestamp").repartition(3)
    got = {r["source_id"]: r["event_data"] for r in payloads.parse_json(raw, "fec").collect()}
    assert len(got) == 2 and sum("latest" in x for x in got.values()) == 1


def test_aliases_and_seeds_are_the_same_in_any_order(spark):
    companies = spark.createDataFrame([(2, "AA", "Same Inc"), (1, "BB", "Same Inc")], "id int, ticker string, name string")
    for df in (companies, companies.orderBy(F.desc("id"))):
        assert {(r["entity_id"], r["alias"]) for r in sinks.generate_aliases(df).collect() if r["alias"] == "same"} == {(1, "same")}
    raw = spark.createDataFrame([('[{"ticker":"A","name":"one"},{"ticker":"A","name":"two"}]',)], "body string")
    assert [r["name"] for r in payloads.seed_companies(raw).collect()] == ["two"]


def test_queries_are_listed_without_a_session():
    """The entry point lists its queries before there is a Spark session."""
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert e.queries() and e.oracle_sql() and SparkContext._active_spark_context is None"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
