"""A table as a stream that arrives in several loads, and the running of streams over it.

A load is a folder, written one after another; a stream over them takes one file of them a batch, so that watermarks move, state expires and rows come late as they would from
a live source.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_root(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with these settings (``__`` stands for a dot), and as it was afterwards."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Loads:
    """A folder of loads below the shared folder, a stream over them, and what its sinks have written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.schema, self.dropped = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", None, 0

    def arrive(self, rows: DataFrame, number: int) -> None:
        """One load, as one file: a batch of the stream."""
        self.schema = rows.schema
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/loads/load={number:05d}")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{self.root}/loads")

    def run(self, stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", name: str = "state") -> None:
        """Takes all loads there are, batch by batch; a later call with the same name goes on from its checkpoint."""
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.root}/checkpoint-{name}").foreachBatch(sink).trigger(availableNow=True).start()
        query.awaitTermination()
        progress = [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in query.recentProgress]
        self.dropped = sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in p["stateOperators"][-1:])

    def table_sink(self, name: str) -> Callable[[DataFrame, int], None]:
        """Keeps each batch under its number: one that is tried again replaces its own rows."""

        def sink(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")

        return sink

    def table(self, name: str, schema: str) -> DataFrame:
        """What a sink has written; empty if it never ran."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").select(rows.columns)


def slices(rows: DataFrame, at: Column, n: int) -> list[DataFrame]:
    """The rows in ``n`` runs of equal length in time; those without a time come last."""
    micros = F.unix_micros(at.cast("timestamp"))
    ends = rows.agg(F.min(micros).alias("a"), F.max(micros).alias("b")).first()
    if ends["a"] is None:
        return [rows]
    width = (ends["b"] - ends["a"]) // n + 1
    number = F.coalesce(F.floor((micros - ends["a"]) / width).cast("int"), F.lit(n - 1))
    return [rows.filter(number == k) for k in range(n)]
