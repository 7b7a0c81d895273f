"""Source health kept by the running queries themselves.

A stream is observed by source: each batch reports how many rows it had of every source and the latest of them, and a listener on the session turns reports and failures into polls, which
``folded`` turns into one row for each source. Nothing is counted twice: a batch that fails has no report, and is reported when it is tried again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.window import Window

from .loads import Loads

POLLS = "source_name string, at timestamp, ok boolean, error string, events long"
META = "source_name string, status string, failures int, last_success timestamp, last_error string, poll_interval_seconds long"
NAME = "source_health"


def watched(stream: DataFrame, source: str, at: str, sources: list[str]) -> DataFrame:
    """The stream with a report on each of the sources (a bounded list: each is two columns of it)."""
    columns = []
    for k, name in enumerate(sources):
        own = F.col(source) == name
        columns += [F.count(F.when(own, 1)).alias(f"n{k}"), F.unix_micros(F.max(F.when(own, F.col(at)))).alias(f"at{k}")]
    return stream.observe(NAME, *columns)


class Health(StreamingQueryListener):
    """Polls of the sources of one query at a time: (source, micros, ok, error, events)."""

    def __init__(self, sources: list[str]):
        self.sources, self.polls, self.latest = sources, [], 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is None:
            return
        for k, name in enumerate(self.sources):
            if row[f"n{k}"]:
                self.latest = max(self.latest, row[f"at{k}"] or 0)
                self.polls.append((name, row[f"at{k}"], True, None, row[f"n{k}"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            first = event.exception.splitlines()[0][:500]
            self.polls += [(name, self.latest + 1, False, first, 0) for name in self.sources]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.polls, "source_name string, us long, ok boolean, error string, events long").select("source_name", F.timestamp_micros("us").alias("at"), "ok", "error", "events")


def folded(meta: DataFrame, polls: DataFrame, down_after: int = 10) -> DataFrame:
    """Health after all polls, in one pass: the failures since the last success decide, as if ``record_health`` had been called for each poll in turn."""
    good = F.max(F.when(F.col("ok"), F.col("at"))).over(Window.partitionBy("source_name"))
    since = polls.withColumn("good", good)
    bad = ~F.col("ok") & (F.col("good").isNull() | (F.col("at") > F.col("good")))
    own = since.groupBy("source_name").agg(
        F.count(F.when(bad, 1)).cast("int").alias("new"), F.max("good").alias("good"), F.max_by("error", F.when(bad, F.col("at"))).alias("error"), F.sum("events").alias("events")
    )
    both = meta.join(own, "source_name", "left")
    failures = (F.when(F.col("good").isNull(), F.col("failures")).otherwise(F.lit(0)) + F.coalesce("new", F.lit(0))).cast("int")
    polled = F.col("new").isNotNull()
    status = F.when(~polled, F.col("status")).when(failures == 0, "healthy").when(failures >= down_after, "down").otherwise("degraded")
    return both.select(
        "source_name", status.alias("status"), failures.alias("failures"), F.coalesce("good", "last_success").alias("last_success"),
        F.when(failures > 0, F.coalesce("error", "last_error")).alias("last_error"), "poll_interval_seconds", F.coalesce("events", F.lit(0)).cast("long").alias("events"),
    )


def monitored(spark: SparkSession, loads: list[DataFrame], sources: list[str], sink: Callable[[DataFrame, int], None], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Runs loads (source, at, ...) through a sink, going on from the checkpoint after a batch that failed, up to ``attempts`` times in all; returns the health of the sources and all polls."""
    place, health = Loads(spark, "health"), Health(sources)
    for k, rows in enumerate(loads):
        place.arrive(rows, k)
    spark.streams.addListener(health)
    try:
        for _ in range(attempts):
            try:
                place.run(watched(place.stream(), "source", "at", sources), sink)
                break
            except Exception:  # noqa: BLE001  the listener has the error; the query goes on from its checkpoint
                continue
            finally:
                spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(health)
    meta = spark.createDataFrame([(name, "healthy", 0, None, None, 60) for name in sources], META)
    return folded(meta, health.table(spark)), health.table(spark)
