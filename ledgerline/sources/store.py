"""A table of events in partitions by day, merged load by load.

A load rewrites only the days it touches: those of its own rows, and those where the table has its keys. Days are found from the table's key columns alone. The merged days are first written
aside and then put in place of the old ones by a dynamic partition overwrite, so that a job which is tried again, or a load that is merged again, changes nothing. Of a key's rows the last by time stays,
whatever order loads arrive in. Retention drops whole days and rewrites the one that the cutoff falls into.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

DAY = "day"


def last_of(df: DataFrame, keys: list[str], *order: Column | str, first: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the last by ``order`` (or the first); rows that tie are told apart by their other columns. ``keep`` columns are the last that isn't null. Rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not keep and not any(isinstance(df.schema[c].dataType, (MapType, VariantType)) for c in rest):  # the row is its own place: it travels once
        named = [c for c in order if isinstance(c, str)]
        whole = F.struct(*[c if isinstance(c, str) else c.alias(f"__{i}") for i, c in enumerate(order)], *[c for c in rest if c not in named])
        out = df.groupBy(*keys).agg((F.min if first else F.max)(whole).alias("__row"))
        return out.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])
    tie = [F.col(c) for c in rest if not isinstance(df.schema[c].dataType, (MapType, VariantType))]
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], *tie)
    pick = F.min_by if first else F.max_by
    out = df.groupBy(*keys).agg(
        pick(F.struct(*[c for c in rest if c not in keep]), place).alias("__row"), *[pick(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"__{c}") for c in keep]
    )
    return out.select(*[F.col(c) if c in keys else F.col(f"__{c}").alias(c) if c in keep else F.col("__row")[c].alias(c) for c in df.columns])


class EventStore:
    """Rows with a key, a time of occurrence and a time by which a later writer is told from an earlier one."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], at: str, order: list[str], keep: tuple[str, ...] = ()):
        self.spark, self.root, self.keys, self.at, self.order, self.keep = spark, root, keys, at, order, keep
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def days(self) -> list[str]:
        """The days the table has: its folders."""
        fs, root = self._fs(self.root)
        if not fs.exists(root):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(root))
        return sorted(n.partition("=")[2] for n in names if n.startswith(f"{DAY}="))

    def read(self, days: list[str] | None = None) -> DataFrame:
        """The rows; of some days only their folders are listed and read."""
        kinds = self.spark.createDataFrame([], self.schema).withColumn(DAY, F.lit("").cast("string")).schema
        if not self.days() or days == []:
            return self.spark.createDataFrame([], kinds)
        rows = self.spark.read.schema(kinds).parquet(self.root)
        return rows if days is None else rows.filter(F.col(DAY).isin(days))

    def rows(self) -> DataFrame:
        return self.read().select(*self.schema.names)

    def _day(self) -> Column:
        return F.coalesce(F.date_format(F.col(self.at).cast("timestamp"), "yyyy-MM-dd"), F.lit("none"))

    def merge(self, load: DataFrame) -> dict[str, int]:
        """Takes a load in; returns how many days were rewritten, emptied and left as they were."""
        aside = f"{self.root}-aside-{uuid.uuid4().hex}"
        load.select(*self.schema.names).withColumn(DAY, self._day()).write.parquet(f"{aside}/load")
        new = self.spark.read.parquet(f"{aside}/load")
        had = self.days()
        known = self.read().select(DAY, *self.keys).join(new.select(*self.keys).distinct(), self.keys, "left_semi").select(DAY)
        touched = sorted(r[0] for r in new.select(DAY).union(known).distinct().collect())  # days, not rows
        both = self.read([d for d in touched if d in set(had)]).select(*self.schema.names).unionByName(new.select(*self.schema.names))
        last_of(both, self.keys, *self.order, keep=self.keep).withColumn(DAY, self._day()).write.parquet(f"{aside}/merged")
        merged = self.spark.read.parquet(f"{aside}/merged")
        self._put(merged)
        full = {r[0] for r in merged.select(DAY).distinct().collect()}
        emptied = [d for d in touched if d in set(had) and d not in full]
        self._drop(emptied)
        fs, path = self._fs(aside)
        fs.delete(path, True)
        return {"rewritten": len(full), "emptied": len(emptied), "untouched": len(set(had) - set(touched))}

    def _put(self, rows: DataFrame) -> None:
        rows.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.root)

    def _drop(self, days: list[str]) -> None:
        for day in days:
            fs, path = self._fs(f"{self.root}/{DAY}={day}")
            fs.delete(path, True)

    def retain(self, cutoff: str) -> list[str]:
        """Drops what occurred before the cutoff (a timestamp); returns the days that went. Rows without a time stay."""
        own = cutoff[:10]
        gone = [d for d in self.days() if d < own]
        self._drop(gone)
        if own in self.days():
            left = self.read([own]).filter(F.col(self.at) >= F.lit(cutoff).cast("timestamp"))
            aside = f"{self.root}-aside-{uuid.uuid4().hex}"
            left.write.parquet(aside)
            left = self.spark.read.parquet(aside)
            if left.isEmpty():
                self._drop([own])
                gone.append(own)
            else:
                self._put(left)
            fs, path = self._fs(aside)
            fs.delete(path, True)
        return gone

    def prune_facts(self, facts: DataFrame, keys: list[str]) -> DataFrame:
        """The facts (with the events' key columns ``keys``, in the order of the table's) whose event is still there."""
        own = self.read().select(*[F.col(a).alias(b) for a, b in zip(self.keys, keys, strict=True)])
        return facts.join(own, keys, "left_semi")
