"""What a stream does with rows that come too late: windows that close, state that expires, and a table of the rows that were refused.

Loads are admitted one a batch, so that the watermark moves between them. Deduplication within the watermark lets a row pass once and drops what is older than the watermark; its state goes as
the watermark passes. The windows behind it are emitted once, when they close. Rows that the watermark refused are those that arrived and didn't pass: they are kept in a table of their
own, with the batch in which they came, and can be merged later. The engine's own count of dropped rows has to agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .loads import ROCKS, Loads, settings

PASSED = "event_id long, event_type string, ts timestamp"
WINDOWS = "event_type string, start timestamp, n long"


@dataclass
class Admitted:
    """accepted and refused: event_id, event_type, ts; closed: event_type, start, n of the windows that closed; dropped: rows that the engine counted as late."""

    accepted: DataFrame
    refused: DataFrame
    closed: DataFrame
    dropped: int


def once(events: DataFrame, late: str) -> DataFrame:
    """Each event once, unless it comes later than the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def closed_windows(events: DataFrame, width: str) -> DataFrame:
    """Counts of the windows of a stream with a watermark, each emitted once, as it closes."""
    return events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("event_id").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def admit(spark: SparkSession, loads: list[DataFrame], late: str = "1 day", width: str = "1 day") -> Admitted:
    """Takes loads (event_id, event_type, ts) one after another. Rows without a time are refused, rows without an id are not events; a last heartbeat closes the windows that are still open."""
    place = Loads(spark, "late")
    own = [x.select(F.col("event_id").cast("long"), F.col("event_type").cast("string"), F.col("ts").cast("timestamp")) for x in loads]
    last = None
    for k, rows in enumerate(own):
        place.arrive(rows, k)
        last = rows.select("ts") if last is None else last.union(rows.select("ts"))
    arrived = spark.read.schema(PASSED).option("recursiveFileLookup", "true").parquet(f"{place.root}/loads") if own else spark.createDataFrame([], PASSED)
    arrived = arrived.withColumn("came", F.regexp_extract(F.col("_metadata.file_path"), r"load=(\d+)", 1).cast("int")) if own else arrived.withColumn("came", F.lit(0))
    beat = last.agg(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), (F.max("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"))
    place.arrive(beat, len(own))
    timed = place.stream().filter("ts is not null and (event_id is not null or event_type is null)")
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS):
        place.run(once(timed, late), place.table_sink("passed"), name="once")
        dropped = place.dropped
        place.run(closed_windows(once(timed, late), width), place.table_sink("windows"), name="windows")
    real = F.col("event_id").isNotNull()
    accepted = place.table("passed", PASSED).filter(real)
    # what arrived and is not among the accepted; an event that came twice has passed once
    missing = arrived.filter(real & (F.col("came") < len(own))).join(accepted.select("event_id"), "event_id", "left_anti")
    refused = missing.groupBy("event_id").agg(F.min_by(F.struct("event_type", "ts", "came"), "came").alias("x")).select("event_id", "x.*")
    return Admitted(accepted, refused, place.table("windows", WINDOWS).filter("n > 0"), dropped)
