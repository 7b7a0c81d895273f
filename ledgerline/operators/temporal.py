"""Joins in time: bands, as-of, next event, latest row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, low: int, high: int, cut: bool = True) -> DataFrame:
    """Pairs with equal keys and ``low <= right_at - left_at <= high`` in days. The sides may share only the key columns.

    Time is cut into buckets as wide as the band; a left row meets the two buckets that its band touches. So a hot key is spread over its
    buckets, and a row meets only rows of nearby days. Without ``cut`` all rows of a key meet, which suits keys of few rows: sides that lie together by the keys aren't shuffled then.
    """
    width = (high - low + 1) * 86400
    micros = 86_400_000_000
    gap = F.unix_micros(F.col(right_at).cast("timestamp")) - F.unix_micros(F.col(left_at).cast("timestamp"))
    if not cut:
        return left.join(right, keys).filter((gap >= low * micros) & (gap <= high * micros))
    start = F.unix_seconds(F.col(left_at).cast("timestamp")) + low * 86400
    first = F.floor(start / width)
    a = left.withColumn("__bucket", F.explode(F.array(first, first + 1)))
    b = right.withColumn("__bucket", F.floor(F.unix_seconds(F.col(right_at).cast("timestamp")) / width))
    return a.join(b, [*keys, "__bucket"]).filter((gap >= low * micros) & (gap <= high * micros)).drop("__bucket")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], forward: bool = False, strict: bool = False, days: int | None = 32) -> DataFrame:
    """Left rows with the ``values`` of the last right row at or before them (``forward``: the first one after), and ``matched_at``.

    Both sides are united and one window carries values along within buckets of a key and ``days`` days; no pair is formed. What a bucket inherits, the last hit of the buckets before it,
    comes from one row for each bucket. So a key with a large share of all rows is spread over its buckets. Without ``days`` a key is one bucket, which is cheaper where keys are fine, such as a person and a ticker. ``strict`` leaves
    equal times out.
    """
    columns = left.columns
    hit = F.struct(F.col(right_at).alias("matched_at"), *values)
    own = left.withColumns({"__at": F.col(left_at), "__hit": F.lit(None).cast(right.select(hit).schema[0].dataType), "__left": F.lit(True)})
    other = right.select(*keys, F.col(right_at).alias("__at"), hit.alias("__hit")).withColumn("__left", F.lit(False))
    rank = F.when(F.col("__left"), F.lit(1)).otherwise(F.lit(2 if strict else 0))
    at = F.col("__at").desc() if forward else F.col("__at")
    carried = Window.unboundedPreceding, Window.currentRow
    if days is None:
        whole = own.unionByName(other, allowMissingColumns=True)
        found = F.last("__hit", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, rank, F.col("__hit")).rowsBetween(*carried))
        return whole.withColumn("__found", found).filter("__left").select(*columns, "__found.*")
    bucket = F.floor(F.unix_seconds(F.col("__at").cast("timestamp")) / (days * 86400)).alias("__bucket")
    united = own.unionByName(other, allowMissingColumns=True).withColumn("__bucket", bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(at, rank, F.col("__hit")).rowsBetween(*carried)
    united = united.withColumn("__found", F.last("__hit", ignorenulls=True).over(inside))
    hits = other.withColumn("__bucket", bucket).groupBy(*keys, "__bucket").agg((F.min if forward else F.max)("__hit").alias("__edge"))
    buckets = united.select(*keys, "__bucket").distinct().join(hits, [*keys, "__bucket"], "left")
    before = Window.partitionBy(*keys).orderBy(F.col("__bucket").desc() if forward else F.col("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    inherited = buckets.withColumn("__inherited", F.last("__edge", ignorenulls=True).over(before)).drop("__edge")
    out = united.filter("__left").join(inherited, [*keys, "__bucket"], "left").withColumn("__found", F.coalesce("__found", "__inherited"))
    return out.select(*columns, "__found.*")


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(window)).filter("__row = 1").drop("__row")


def next_sale(trades: DataFrame, keys: tuple[str, ...] = ("person_id", "ticker")) -> DataFrame:
    """Purchases with ``sold_at``: the first sale of the same keys after them (later, not at the same time). Keys have few rows each, so that they aren't cut into buckets. Trades are read once."""
    at = F.unix_micros(F.col("traded_at").cast("timestamp"))
    later = Window.partitionBy(*keys).orderBy(at.desc()).rangeBetween(Window.unboundedPreceding, -1)
    sold = F.min(F.when(F.col("trade_type").startswith("sale"), F.col("traded_at"))).over(later)
    return trades.withColumn("sold_at", sold).filter("trade_type = 'purchase' and traded_at is not null and sold_at is not null")
