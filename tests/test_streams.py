"""Streams of several batches against plain versions."""

import datetime as dt
import random

import pytest

from ledgerline.streaming import debounce, health, late

START = dt.datetime(2024, 1, 1)


def plain_bursts(events, quiet, cooldown):
    out = []
    for subject in {s for s, _ in events if s is not None}:
        times, last = sorted(int((t - START).total_seconds() * 1000) for s, t in events if s == subject and t is not None), None
        while times:
            n = 1
            while n < len(times) and times[n] - times[n - 1] <= quiet:
                n += 1
            due = times[n - 1] + quiet
            able = last is None or due - last >= cooldown
            last = due if able else last
            base = int(START.timestamp() * 1000)
            out.append((subject, base + times[0], base + due, n, able))
            times = times[n:]
    return sorted(out)


@pytest.fixture(scope="module")
def arrivals():
    rng = random.Random(5)
    at = [(rng.choice((1, 1, 1, 2, 3, None)), START + dt.timedelta(seconds=rng.randint(0, 40_000))) for _ in range(400)]
    return [*at, (4, START), (4, START), (None, None), (5, None), (6, START + dt.timedelta(seconds=40_000))]


@pytest.mark.parametrize(("loads", "restart"), [(4, True), (1, False)])
def test_recomputations(spark, arrivals, loads, restart):
    """Repeated, unordered and nameless events, and events without a time; with and without a restart."""
    events = spark.createDataFrame([(s, t, "clash") for s, t in arrivals], "user_id long, ts timestamp, ms string")
    got = debounce.recomputations(spark, events, 300_000, 3_600_000, loads, restart, "10 minutes").collect()
    assert sorted(map(tuple, got)) == plain_bursts(arrivals, 300_000, 3_600_000)


def test_recomputations_of_nothing(spark):
    assert debounce.recomputations(spark, spark.createDataFrame([], "user_id long, ts timestamp"), 1000, 1000, 2).count() == 0


def test_bursts_merge():
    assert debounce.merged([(10, 12, 2), (0, 3, 1), (15, 15, 1), (40, 40, 1)], 3) == [(0, 3, 1), (10, 15, 3), (40, 40, 1)]
    assert debounce.merged([(0, 100, 5), (20, 30, 2)], 3) == [(0, 100, 7)]


def test_budget_of_a_minute(spark):
    rows = [(s, 0, m * 60_000 + s, 1, s % 4 != 0) for m in range(3) for s in range(10)]
    got = debounce.with_budget(spark.createDataFrame(rows, debounce.OUT), 3).filter("granted").collect()
    assert sorted((r["ended_ms"] // 60_000, r["subject"]) for r in got) == [(m, s) for m in range(3) for s in (1, 2, 3)]


@pytest.fixture(scope="module")
def late_loads(spark):
    rng, hour, out = random.Random(6), dt.timedelta(hours=1), []
    for k in range(5):
        own = [(k * 100 + i, rng.choice("ab"), START + (24 * k + rng.randint(0, 23)) * hour) for i in range(20)]
        if k > 1:
            own += [(k * 100 + 50, "a", START + rng.randint(0, 5) * hour), (k * 100 + 51, "b", START + (24 * k - 30) * hour)]
        out.append([*own, own[0], (1000 + k, "a", None), (None, "a", START)])  # a repeated row, and rows without a time or an id
    return [spark.createDataFrame([(*r, "clash") for r in rows], "event_id long, event_type string, ts timestamp, w string") for rows in out], out


def test_late_rows_are_refused_and_kept(spark, late_loads):
    frames, rows = late_loads
    seen = late.admit(spark, frames, "1 day", "1 day")
    accepted, refused = {r["event_id"] for r in seen.accepted.collect()}, {r["event_id"] for r in seen.refused.collect()}
    every = {i for own in rows for i, _, _ in own if i is not None}
    assert accepted | refused == every and not accepted & refused and seen.accepted.count() == len(accepted)
    want = set()
    for k, own in enumerate(rows):
        before = [t for earlier in rows[: max(0, k - 1)] for _, _, t in earlier if t is not None]
        want |= {i for i, _, t in own if i is not None and (t is None or (before and t <= max(before) - dt.timedelta(days=1)))}
    assert refused == want and len(want) > 5
    counts = {}
    for own in rows:
        for i, kind, t in set(own):
            if i in accepted:
                counts[kind, t.replace(hour=0)] = counts.get((kind, t.replace(hour=0)), 0) + 1
    assert {(r["event_type"], r["start"]): r["n"] for r in seen.closed.collect()} == counts
    assert seen.dropped == sum(i in want and t is not None for own in rows for i, _, t in own)


@pytest.mark.parametrize(("fails", "status", "failures"), [(0, "healthy", 0), (2, "healthy", 0), (9, "degraded", 3)])
def test_health_of_sources(spark, fails, status, failures):
    frames = [spark.createDataFrame([(s, START + dt.timedelta(hours=10 * k + len(s))) for s in ("one", "three") for _ in range(k + 1)], "source string, at timestamp") for k in range(4)]
    left = [fails]

    def sink(batch, number):
        batch.count()
        if number == 2 and left[0]:
            left[0] -= 1
            raise RuntimeError("no")

    got = {r["source_name"]: r for r in health.monitored(spark, frames, ["one", "three", "never"], sink)[0].collect()}
    done = 4 if fails < 3 else 2
    assert set(got) == {"one", "three", "never"} and got["one"]["status"] == got["three"]["status"] == status
    assert (got["three"]["failures"], got["three"]["events"]) == (failures, sum(range(1, done + 1))) and (got["three"]["last_error"] is None) == (failures == 0)
    assert got["three"]["last_success"] == START + dt.timedelta(hours=10 * (done - 1) + 5)
    assert got["never"]["events"] == 0 and got["never"]["last_success"] is None


def test_a_source_is_down_after_ten_failures(spark):
    meta = spark.createDataFrame([("a", "degraded", 8, START, "old", 60)], health.META)
    polls = [("a", START + dt.timedelta(hours=k), False, f"e{k}", 0) for k in range(3)]
    assert health.folded(meta, spark.createDataFrame(polls, health.POLLS)).first()["status"] == "down"
    row = health.folded(meta, spark.createDataFrame([("a", START + dt.timedelta(hours=1, minutes=1), True, None, 4), *polls], health.POLLS)).first()
    assert (row["status"], row["failures"], row["last_error"], row["events"]) == ("degraded", 1, "e2", 4)


def test_subjects_share_the_calls_of_their_bucket(spark, monkeypatch):
    """However many subjects there are, a batch has a call for each bucket; large ids keep their digits beside rows without a subject."""
    monkeypatch.setattr(debounce, "BUCKETS", 3)
    rows = [((1 << 60) + s % 50 if s % 7 else None, START + dt.timedelta(seconds=s * 40)) for s in range(600)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp")
    got = debounce.recomputations(spark, events, 300_000, 3_600_000, 3, True, "10 minutes").collect()
    assert sorted(map(tuple, got)) == plain_bursts(rows, 300_000, 3_600_000)
