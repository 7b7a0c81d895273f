"""Intermediate tables in the folder that the session names in ``spark.checkpoint.dir``.

A table written there cuts the lineage, survives a lost executor and is read back with column pruning and real sizes,
so that the planner's choice between a broadcast and a shuffle rests on the bytes that were written.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; sets one of its own only where the session has none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Has Spark hand long texts to Python in batches of 2 MB rather than 64: that bounds what a worker and the buffers on its executor's side hold at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864b").rstrip("b")) != most:
        spark.conf.set(key, f"{most}b")


class Tables:
    """The intermediate tables of one operator call; ``drop`` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._forget)

    def _forget(self) -> None:
        """Results are plans over these tables, so that they last as long as the driver's process does."""
        with contextlib.suppress(Exception):  # the JVM may be gone
            self.drop("")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_parts(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """A table with a folder for every value of ``by``."""
        df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(f"{self.root}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def keep(self, *names: str) -> None:
        """Drops every table that isn't named."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        found = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
        self.drop(*{x.getPath().getName() for x in found} - {*names})

    def free(self) -> None:
        """Has the context cleaner remove the shuffle files of jobs that are over, which it does once the driver's garbage is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, cast to the given types: extra columns with clashing names stay outside."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


#: Rows of four numbers that are still broadcast, some 30 MB.
BROADCAST_ROWS = 500_000


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """key, key2: 128 bits that stand for a row's id and text."""
    own = F.coalesce(F.col(f"`{doc_id}`").cast("long").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return [F.xxhash64(*own).alias("key"), F.xxhash64(F.lit(2), *own).alias("key2")]


def keep_rows(docs: DataFrame, fate: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that do not stay; ``fate``: key, key2, stays, times. Of a row that stays and is there several times one is left; rows that ``fate`` lacks stay."""
    names = [f"__{c}" for c in ("key", "key2", "stays", "times")]
    fate = fate.filter("not stays or times > 1").select(*[F.col(c).alias(n) for c, n in zip(("key", "key2", "stays", "times"), names, strict=True)])
    if fate.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        fate = F.broadcast(fate)
    own = docs.select("*", *[c.alias(n) for c, n in zip(row_keys(doc_id, text), names, strict=False)]).join(fate, names[:2], "left")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    once = own.filter("__stays is null or (__stays and __times = 1)").select(*kept)
    if fate.filter("__stays and __times > 1").isEmpty():
        return once
    return once.unionByName(own.filter("__stays and __times > 1").dropDuplicates(names[:2]).select(*kept))


def spread(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for so many rows; grows with the rows and is at least the session's own choice of shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // per_task))
