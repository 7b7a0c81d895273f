"""Recomputations that are due: a stateful, debounced stream with a cooldown for each subject and a budget for all.

A subject's events form bursts, which end after a quiet time. At the end of a burst the subject is recomputed, unless its last recomputation is less than a cooldown ago. Open bursts and the last
recomputation are state, which event-time timers close and clear; nothing is kept of a subject that has been quiet for a cooldown. Rows of a batch may come in any order, and a row may
join two open bursts. Events without a subject only move the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from .loads import ROCKS, Loads, settings, slices

OUT = "subject long, started_ms long, ended_ms long, events long, recomputed boolean"
MINUTE_MS = 60_000


#: Subjects share the state of a bucket, so that a batch costs a call for each bucket rather than for each subject.
BUCKETS = 4096
#: The open bursts of a bucket, and the last recomputations (``at``) of its subjects (``of``).
STATE = "subject array<bigint>, started array<bigint>, last array<bigint>, events array<bigint>, of array<bigint>, at array<bigint>"


def debounce(quiet: int, cooldown: int):
    """Rows (subject, none, ms) of a bucket's subjects to their closed bursts; times are milliseconds. State comes and goes with the rows, once a batch and bucket, and one timer stands for all its bursts: it is
    set for what ends first, and whatever has ended by then is closed."""

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bursts: dict[int, list[tuple[int, int, int]]] = {}
        done: dict[int, int] = {}
        if state.exists:
            subjects, *rest, of, at = state.get
            for subject, burst in zip(subjects, zip(*rest, strict=True), strict=True):
                bursts.setdefault(subject, []).append(burst)
            done = dict(zip(of, at, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                named = frame[~frame["none"]]
                for subject, ms in zip(named["subject"].tolist(), named["ms"].tolist(), strict=True):
                    bursts.setdefault(subject, []).append((ms, ms, 1))
        now, out, left, timers = state.getCurrentWatermarkMs(), [], [], []
        for subject, own in bursts.items():
            for began, end, n in merged(own, quiet):
                due = end + quiet
                if due > now:
                    left.append((subject, began, end, n))
                    timers.append(due)
                    continue
                able = subject not in done or due - done[subject] >= cooldown
                if able:
                    done[subject] = due
                out.append((subject, began, due, n, able))
        done = {subject: at for subject, at in done.items() if at + cooldown > now}  # whatever ends from now on is beyond the cooldown of others
        timers += [at + cooldown for at in done.values()]
        if timers:
            state.update((*([x[i] for x in left] for i in range(4)), list(done), list(done.values())))
            state.setTimeoutTimestamp(max(min(timers) - 1, now + 1, 1))  # a timer runs out once the watermark is beyond it
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return run


def merged(bursts: list[tuple[int, int, int]], quiet: int) -> list[tuple[int, int, int]]:
    """Bursts in order of time; those no more than the quiet time apart are one."""
    out: list[tuple[int, int, int]] = []
    for started, last, events in sorted(bursts):
        if out and started - out[-1][1] <= quiet:
            a, b, n = out[-1]
            out[-1] = (a, max(b, last), n + events)
        else:
            out.append((started, last, events))
    return out


def debounced(events: DataFrame, quiet_ms: int, cooldown_ms: int, late: str = "1 day") -> DataFrame:
    """The closed bursts of a stream (user_id, ts)."""
    subject, at = F.col("user_id").cast("long"), F.col("ts").cast("timestamp")
    bucket = F.pmod(F.xxhash64(subject), F.lit(BUCKETS)).alias("bucket")
    # a null among the subjects would turn the others of its batch into floats
    own = events.select(bucket, F.coalesce(subject, F.lit(0)).alias("subject"), subject.isNull().alias("none"), at.alias("ts"), F.unix_millis(at).alias("ms"))
    own = own.filter("ts is not null").withWatermark("ts", late).groupBy("bucket")
    return own.applyInPandasWithState(debounce(quiet_ms, cooldown_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def with_budget(bursts: DataFrame, budget: int) -> DataFrame:
    """Bursts with ``granted``: whether the recomputation is among the first ``budget`` of its minute, by the end of the burst and then by subject. Each minute has its own budget, so that minutes share no
    task; a recomputation that is refused starts its cooldown all the same, and its subject is due again with a later burst."""
    minute = F.floor(F.col("ended_ms") / MINUTE_MS)
    place = F.row_number().over(Window.partitionBy(minute, "recomputed").orderBy("ended_ms", "subject"))
    return bursts.withColumn("granted", F.col("recomputed") & (place <= budget))


def recomputations(spark: SparkSession, events: DataFrame, quiet_ms: int, cooldown_ms: int, loads: int = 6, restart: bool = True, late: str = "1 day") -> DataFrame:
    """All bursts of the events (user_id, ts), by a stream that takes them in ``loads`` batches, is stopped half way and goes on from its checkpoint. A heartbeat without a subject ends the last bursts."""
    own = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    place = Loads(spark, "debounce")
    parts = slices(own, F.col("ts"), loads)
    end = own.agg(F.lit(None).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"))
    half = len(parts) // 2 if restart else len(parts)
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS):
        for k, part in enumerate(parts[:half]):
            place.arrive(part, k)
        if half:
            place.run(debounced(place.stream(), quiet_ms, cooldown_ms, late), place.table_sink("bursts"))
        for k, part in enumerate([*parts[half:], end], half):
            place.arrive(part, k)
        place.run(debounced(place.stream(), quiet_ms, cooldown_ms, late), place.table_sink("bursts"))
    return place.table("bursts", OUT)
