"""Queries over streams of several batches, each with the SQL of what they have to come to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import EventStore
from ..streaming import debounce, health, late
from ..streaming.loads import shared_root, slices
from .mapping import Catalog

HOUR = 3_600_000
QUIET, COOLDOWN, BUDGET = 2 * HOUR, 12 * HOUR, 1

#: Bursts by gaps, then the cooldown burst by burst.
RECOMPUTATIONS = f"""WITH RECURSIVE g AS (SELECT user_id AS subject, epoch_us(ts) // 1000 AS ms, coalesce(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w, {QUIET} + 1) > {QUIET} AS fresh FROM events
 WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY subject ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM g),
b AS (SELECT subject, k, min(ms) AS started_ms, max(ms) + {QUIET} AS ended_ms, count(*) AS events FROM i GROUP BY 1, 2),
r AS (SELECT subject, k, ended_ms AS last, TRUE AS recomputed FROM b WHERE k = 1 UNION ALL
 SELECT b.subject, b.k, CASE WHEN b.ended_ms - last >= {COOLDOWN} THEN b.ended_ms ELSE last END, b.ended_ms - last >= {COOLDOWN} FROM r JOIN b ON b.subject = r.subject AND b.k = r.k + 1)
SELECT subject, started_ms, ended_ms, events, recomputed, recomputed AND row_number() OVER (PARTITION BY ended_ms // 60000, recomputed ORDER BY ended_ms, subject) <= {BUDGET} AS granted FROM b JOIN r USING (subject, k)"""


def recomputations(c: Catalog) -> DataFrame:
    return debounce.with_budget(debounce.recomputations(c.spark, c.read("events"), QUIET, COOLDOWN), BUDGET)


LOADS = 8
CAME = "ts + CASE WHEN event_id % 97 = 0 THEN INTERVAL '9' DAY WHEN event_id % 31 = 0 THEN INTERVAL '2' DAY ELSE INTERVAL '0' DAY END"
#: A batch is measured against the watermark of the one before it, which the loads before that have set.
LATE = f"""WITH a AS (SELECT event_id, event_type, ts, epoch_us({CAME}) AS came FROM events WHERE ts IS NOT NULL),
k AS (SELECT *, (came - min(came) OVER ()) // ((max(came) OVER () - min(came) OVER ()) // {LOADS} + 1) AS load FROM a),
m AS (SELECT load, max(top) OVER (ORDER BY load RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) // 1000 * 1000 - 86400000000 AS mark FROM (SELECT load, max(epoch_us(ts)) AS top FROM k GROUP BY 1))
SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) FILTER (WHERE mark IS NULL OR epoch_us(ts) > mark) AS accepted, count(*) FILTER (WHERE epoch_us(ts) <= mark) AS refused FROM k JOIN m USING (load) GROUP BY 1, 2"""


def late_rows(c: Catalog) -> DataFrame:
    """Events that come in another order than they happened, some of them too late: by type and day, how many were counted before their window closed and how many were refused."""
    own = c.read("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("came", F.expr(CAME))
    seen = late.admit(c.spark, slices(own, F.col("came"), LOADS))
    refused = seen.refused.groupBy("event_type", F.date_trunc("day", "ts").alias("start")).agg(F.count("*").alias("refused"))
    both = seen.closed.join(refused, ["event_type", "start"], "full")
    return both.select("event_type", "start", F.coalesce("n", F.lit(0)).alias("accepted"), F.coalesce("refused", F.lit(0)).alias("refused"))


HEALTH = """WITH x AS (SELECT 1) SELECT event_type AS source_name, 'healthy' AS status, 0::INT AS failures, max(ts) AS last_success, CAST(NULL AS VARCHAR) AS last_error, 60::BIGINT AS poll_interval_seconds, count(*) AS events
 FROM events GROUP BY event_type"""


def source_health(c: Catalog) -> DataFrame:
    """Types of events as sources of a stream of five loads; one batch fails at first and is tried again."""
    own = c.read("events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("at"))
    sources = [r[0] for r in own.select("source").distinct().orderBy("source").limit(1000).collect()]
    failed = []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.format("noop").mode("overwrite").save()
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("this batch fails once")

    return health.monitored(c.spark, slices(own, F.col("at"), 5), sources, sink)[0]


CUTOFF = "2024-01-09 12:30:00"
KEPT = "event_type string, user_id long, event_id long, ts timestamp, value double, company long"


def replayed(c: Catalog) -> DataFrame:
    """The latest event of each kind and user, with the last company that was known, after three loads and retention: the second third of the time comes last, and one load comes twice."""
    company = F.when(F.col("event_id") % 3 == 0, F.col("user_id"))
    rows = c.read("events").select("event_type", "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value", company.alias("company"))
    store = EventStore(c.spark, f"{shared_root(c.spark)}/events-{uuid.uuid4().hex}", KEPT, ["event_type", "user_id"], "ts", ["ts", "event_id"], ("company",))
    parts = slices(rows, F.col("ts"), 3)
    for k in (0, 2, 1, 0):
        store.merge(parts[k % len(parts)])
    store.retain(CUTOFF)
    return store.rows()


def register(add) -> None:
    add("event_store_replay", f"WITH x AS (SELECT 1) SELECT event_type, user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value, "
        f"arg_max(user_id, (ts, event_id)) FILTER (WHERE event_id % 3 = 0) AS company FROM events GROUP BY 1, 2 HAVING max(ts) >= TIMESTAMP '{CUTOFF}'", replayed)  # fmt: skip
    add("stream_recomputations", RECOMPUTATIONS, recomputations)
    add("stream_late_rows", LATE, late_rows)
    add("stream_source_health", HEALTH, source_health)
