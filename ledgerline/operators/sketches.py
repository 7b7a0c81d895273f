"""Approximate aggregates from sketches that merge.

A sketch row per ticker and week holds the distinct persons (HyperLogLog) and the distribution of amounts (KLL). Rows of any span are merged without a look at the trades, and new weeks are appended without a look at
the old ones. A sketch has a bounded size whatever it stands for, and sketches are combined before they are shuffled, so that a ticker with a large share of all trades costs no more than any other.

Bounds: with 2^12 registers the standard error of a distinct count is 1.04 / 64, 1.6 %; three of them and at least 1 are the bound here. A KLL sketch of k = 400 has a rank error below 1 % with
a probability of 99 %; the bound here is 2 %. Null persons and amounts take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import week_of

LOG_K, KLL_K = 12, 400
DISTINCT_BOUND, RANK_BOUND = 3 * 1.04 / 64, 0.02


def weekly(trades: DataFrame, key: str = "ticker") -> DataFrame:
    """key, week, trades, persons (a sketch), amounts (a sketch)."""
    return trades.groupBy(key, week_of(F.col("traded_at")).alias("week")).agg(
        F.count("*").alias("trades"), F.hll_sketch_agg("person_id", F.lit(LOG_K)).alias("persons"), F.kll_sketch_agg_bigint("est", F.lit(KLL_K)).alias("amounts")
    )


def merged(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Sketches added up by other keys, such as a quarter or nothing."""
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    return sketches.groupBy(*keys).agg(F.sum("trades").alias("trades"), F.hll_union_agg("persons").alias("persons"), F.kll_merge_agg_bigint("amounts").alias("amounts"))


def estimates(sketches: DataFrame, *quantiles: float) -> DataFrame:
    """The sketches as numbers: persons, and an amount for each quantile (q50 for 0.5)."""
    values = [F.kll_sketch_get_quantile_bigint("amounts", F.lit(q)).alias(f"q{round(q * 100)}") for q in quantiles]
    kept = [c for c in sketches.columns if c not in ("persons", "amounts")]
    return sketches.select(*kept, F.hll_sketch_estimate("persons").alias("persons"), *values)


def distinct_within(estimate: Column, exact: Column) -> Column:
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), F.lit(DISTINCT_BOUND) * exact)


#: Trades of one task that counts persons exactly, some 100 bytes each.
TRADES_A_TASK = 500_000


def checked(trades: DataFrame, estimated: DataFrame, by: list[Column], quantiles: tuple[float, ...], rows: int = 0) -> DataFrame:
    """Exact persons beside the estimate, and whether the estimates lie within their bounds; the rank of an estimated quantile is looked up among the trades. ``by`` are named columns of ``estimated``.

    ``rows``: how many trades there are, which the sketches know. Trades are dealt by group and person to as many tasks as that asks for, so that what a task holds doesn't grow with them; the estimates, a row
    of numbers for each group, are broadcast.
    """
    names = [f"q{round(q * 100)}" for q in quantiles]
    own = trades.select(*by, "person_id", "est")
    keys = [c for c in own.columns if c not in ("person_id", "est")]
    tasks = max(int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TRADES_A_TASK))
    own = own.repartition(tasks, *keys, "person_id")
    both = own.join(F.broadcast(estimated.select(*keys, F.col("persons").alias("estimate"), *names)), keys)
    n = F.count("est")
    ranks = [(F.count(F.when(F.col("est") < F.col(c), 1)) / n, F.count(F.when(F.col("est") <= F.col(c), 1)) / n) for c in names]
    inside = F.lit(True)
    for q, (below, upto) in zip(quantiles, ranks, strict=True):
        inside = inside & (below <= q + RANK_BOUND) & (upto >= q - RANK_BOUND)
    out = both.groupBy(*keys).agg(F.count("*").alias("trades"), F.count_distinct("person_id").alias("persons"), F.first("estimate").alias("estimate"), inside.alias("quantiles_within"))
    return out.withColumn("persons_within", distinct_within(F.col("estimate"), F.col("persons")))
