"""Event streams: weekly windows, deduplication, debounced recomputation, interval joins.

Each ``*_stream`` function is a transformation of a streaming DataFrame; the others run it over the files there are and return what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, directory: str, table: str = "events") -> DataFrame:
    path = f"{directory}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(parent).withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts per event type and week; weeks begin on Monday (windows count from a Thursday, 1970-01-01, hence 4 days)."""
    week = F.window("ts", "7 days", startTime="4 days")
    return events.withWatermark("ts", late).groupBy("event_type", week.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def dedupe_stream(events: DataFrame, late: str = "10 days") -> DataFrame:
    """Each event once, however often its source sends it within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def debounce_stream(events: DataFrame, quiet: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """One recomputation per subject and burst: a burst ends after a quiet time."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", quiet).alias("burst")).agg(F.count("*").alias("n"))


def limited(due: DataFrame, done: DataFrame, cooldown: str = "5 minutes", budget: int = 100) -> DataFrame:
    """Which subjects (user_id, at) are recomputed now: those whose last time (user_id, last) lies a cooldown back or never was, the longest waiting first, ``budget`` at most."""
    fresh = due.groupBy("user_id").agg(F.min("at").alias("at")).join(done, "user_id", "left")
    able = fresh.filter(F.col("last").isNull() | (F.col("at") >= F.col("last") + F.expr(f"INTERVAL {cooldown}")))
    return able.select("user_id", "at").orderBy("at", "user_id").limit(budget)


def recompute(stream: DataFrame, done_path: str, act: Callable[[DataFrame], None], cooldown: str = "5 minutes", budget: int = 100) -> Callable[[DataFrame, int], None]:
    """A sink for debounced bursts: acts on the subjects that cooldown and budget allow, and keeps what was done as a table per batch, so that a batch tried again replaces its own."""
    spark = stream.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        due = batch.select("user_id", F.col("burst.end").alias("at"))
        earlier = spark.read.schema("user_id long, at timestamp, number int").parquet(done_path) if number else spark.createDataFrame([], "user_id long, at timestamp, number int")
        done = earlier.filter(F.col("number") < number).groupBy("user_id").agg(F.max("at").alias("last"))
        chosen = limited(due, done, cooldown, budget)
        chosen.write.mode("overwrite").parquet(f"{done_path}/number={number}")
        act(spark.read.schema("user_id long, at timestamp").parquet(f"{done_path}/number={number}"))

    return sink


def resolve_stream(events: DataFrame, resolve: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """A sink that resolves every batch of events and keeps it under its number."""

    def sink(batch: DataFrame, number: int) -> None:
        resolve(batch).write.mode("overwrite").parquet(f"{out}/number={number}")

    return sink


def of_ticker(events: DataFrame, ticker: str) -> DataFrame:
    return events.filter(F.col("ticker") == ticker)


def score_changes(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "score_change")


def top_symbols(scores: DataFrame, n: int = 30) -> DataFrame:
    """The symbols that a market stream subscribes to: the best by composite score."""
    return scores.orderBy(F.desc("composite"), "ticker").limit(n).select("ticker")


def interval_join_stream(left: DataFrame, right: DataFrame, key: str, days: int = 14) -> DataFrame:
    """Pairs of left and right rows of a key with right 1 to ``days`` days after left. Watermarks bound the state of both sides."""
    a = left.select(F.col(key).alias("k"), F.col("ts").alias("a")).withWatermark("a", "1 day")
    b = right.select(F.col(key).alias("k2"), F.col("ts").alias("b")).withWatermark("b", "1 day")
    return a.join(b, F.expr(f"k = k2 AND b >= a + INTERVAL 1 DAY AND b <= a + INTERVAL {days} DAYS")).drop("k2")


def finished(spark: SparkSession, stream: DataFrame, mode: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Runs a stream over what is there now, batch by batch into a table, and returns the table; in update mode the last row of a key wins."""
    name = f"stream_{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    place = f"{root}/{name}"
    out = f"{place}/out"

    def sink(batch: DataFrame, number: int) -> None:  # a batch that is tried again replaces its own rows
        batch.write.mode("overwrite").parquet(f"{out}/__batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/state")
    state.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(state, True)
    return shape(spark.read.parquet(out))


def weekly_counts(spark: SparkSession, directory: str) -> DataFrame:
    last = F.max_by(F.struct("n", "value"), "__batch").alias("x")
    return finished(spark, weekly_stream(event_stream(spark, directory)), "update", lambda df: df.groupBy("event_type", F.col("w.start").alias("week")).agg(last).select("event_type", "week", "x.n", F.round("x.value", 4).alias("value")))


def deduplicated(spark: SparkSession, directory: str) -> DataFrame:
    """The events, of which the stream brings each twice."""
    twice = event_stream(spark, directory).unionByName(event_stream(spark, directory))
    return finished(spark, dedupe_stream(twice), "append", lambda df: df.select("event_id", "ts", "user_id", "event_type"))


def pairs_in_time(spark: SparkSession, directory: str, first: str, then: str, days: int = 14) -> DataFrame:
    """Events of one kind and those of another that the same user has 1 to ``days`` days later, by a join of two streams whose state the watermarks bound."""
    left, right = (event_stream(spark, directory).filter(F.col("event_type") == kind) for kind in (first, then))
    return finished(spark, interval_join_stream(left, right, "user_id", days), "append", lambda df: df.select("k", "a", "b"))
