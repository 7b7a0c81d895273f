"""Merges by key, retention, entity resolution, exports. All are plans over whole tables; none is a loop over rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import normalize_name
from .store import last_of


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Old and new rows, the new one where a key has both; ``keep`` columns fall back on the old value if the new one is null. Of new rows that repeat a key the last by ``order`` stays; ``order``
    columns that the old rows lack are dropped. Idempotent."""
    new = last_of(new, keys, *order, keep=keep)
    renamed = old.select(*keys, F.lit(True).alias("__old"), *[F.col(c).alias(f"__{c}") for c in old.columns if c not in keys])
    both = renamed.join(new.withColumn("__new", F.lit(True)), keys, "full")

    def pick(c: str) -> Column:
        mine = F.coalesce(F.col(c), F.col(f"__{c}")) if c in keep else F.col(c)
        return F.when(F.col("__new"), mine).otherwise(F.col(f"__{c}")).alias(c)

    return both.select(*[F.col(c) if c in keys else pick(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """Old rows, and new ones of other keys: of those that repeat a key the first by ``order``."""
    fresh = last_of(new, keys, *order, first=True).join(old, keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def prune_scores(scores: DataFrame, cutoff: Column) -> DataFrame:
    """Drops scores before the cutoff, except the latest of each ticker."""
    window = Window.partitionBy("ticker").orderBy(F.desc("computed_at"))
    return scores.withColumn("__r", F.row_number().over(window)).filter((F.col("computed_at") >= cutoff) | (F.col("__r") == 1)).drop("__r")


def prune_by_events(facts: DataFrame, events: DataFrame, cutoff: Column) -> DataFrame:
    return facts.join(events.filter(F.col("occurred_at") >= cutoff).select(F.col("id").alias("event_id")), "event_id", "left_semi")


def hits(names: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """id and company_id of the names (id, ticker, name) that ``resolve`` finds a company for. Names are read once: each with all the keys it may be known by, which meet the companies' in one join."""
    word = lambda c: F.regexp_extract(c, r"^\S+", 0)
    beginnings = lambda c: F.transform(F.sequence(F.lit(1), F.length(word(c))), lambda i: F.substring(word(c), F.lit(1), i))

    def keyed(df: DataFrame, *keys: tuple[int, Column]) -> DataFrame:
        """A row for each kind of key; keys are texts or arrays of them."""
        def of(kind: int, key: Column) -> Column:
            return F.transform(F.coalesce(key, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("k")))

        whole = F.concat(*[of(*k) for k in keys])
        return df.select("*", F.explode(whole).alias("__e")).select(*df.columns, "__e.kind", "__e.k").filter("k is not null and (k <> '' or kind in (3, 6))")

    n, low, plain = F.lower(F.trim("name")), F.lower("name"), normalize_name(F.col("name"))
    begins = lambda c, k: F.when(c != "", k)
    mine = names.select("id", "ticker", "name", n.alias("n"))
    mine = keyed(mine, (0, F.array(F.upper("ticker"))), (1, F.array(low)), (2, F.array(plain)), (4, F.array(low)), (5, F.array(plain)), (3, begins(n, F.array(word(n)))), (6, begins(n, beginnings(n))))
    own = companies.select(F.col("id").alias("company_id"), "ticker", "name", n.alias("c"), F.length("name").alias("length"))
    own = keyed(own, (0, F.array(F.upper("ticker"))), (1, F.array(low)), (2, F.array(plain)), (3, begins(n, beginnings(n))), (6, begins(n, F.array(word(n)))))
    other = aliases.select(F.col("entity_id").alias("company_id"), F.lit(None).cast("string").alias("ticker"), F.col("alias").alias("name"), F.lit(None).cast("string").alias("c"), F.length("alias").alias("length"))
    other = keyed(other, (4, F.array(low)), (5, F.array(plain)))
    known = own.unionByName(other).select("kind", "k", "company_id", "c", "length")
    nearness = F.when(~F.col("kind").isin(3, 6) | (F.col("n") == F.col("c")), 0).when(F.col("c").startswith(F.col("n")) | F.col("n").startswith(F.col("c")), 1)
    rank = F.when(F.col("kind") == 6, 3).otherwise(F.col("kind"))
    met = mine.select("id", "n", "kind", "k").join(known, ["kind", "k"]).withColumn("nearness", nearness).filter("nearness is not null")
    best = met.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "nearness", "length", "company_id")).alias("hit"))
    return best.select("id", F.col("hit.company_id").alias("company_id"))


def resolve(names: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (id, ticker, name) with company_id: by ticker, exact name, normalised name, prefix either way, alias, normalised alias, in this order; ties to the shortest name, then the smallest id."""
    return names.join(hits(names, companies, aliases), "id", "left").select(*names.columns, "company_id")


def generate_aliases(companies: DataFrame) -> DataFrame:
    kinds = F.array_distinct(F.array(F.col("ticker"), normalize_name(F.col("name")), F.upper("name")))
    return companies.select(F.col("id").alias("entity_id"), F.explode(kinds).alias("alias")).filter("alias is not null and alias <> ''").groupBy("alias").agg(F.min("entity_id").alias("entity_id")).select("entity_id", "alias")


def delete(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key (the columns of ``keys``) is not among those to go."""
    return df.join(keys.distinct(), keys.columns, "left_anti")


def record_health(meta: DataFrame, results: DataFrame, down_after: int = 10) -> DataFrame:
    """source_meta after polls (source_name, at, ok, error): last success or error, consecutive failures, status. The latest poll of a source counts."""
    last = Window.partitionBy("source_name").orderBy(F.desc("at"))
    own = results.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r")
    both = meta.join(own, "source_name", "left")
    failures = F.when(F.col("ok"), 0).when(~F.col("ok"), F.coalesce("failures", F.lit(0)) + 1).otherwise(F.coalesce("failures", F.lit(0)))
    status = F.when(F.col("at").isNull(), F.col("status")).when(failures == 0, "healthy").when(failures >= down_after, "down").otherwise("degraded")
    return both.select(
        "source_name", status.alias("status"), failures.cast("int").alias("failures"), F.when(F.col("ok"), F.col("at")).otherwise(F.col("last_success")).alias("last_success"),
        F.when(F.col("ok"), F.lit(None)).otherwise(F.coalesce("error", "last_error")).alias("last_error"), "poll_interval_seconds",
    )


def signal_lists(**signals: DataFrame) -> DataFrame:
    """signal, ticker: the distinct tickers of every signal, as one table that queries read lists from."""
    out = None
    for name, df in signals.items():
        own = df.select(F.lit(name.replace("_", "-")).alias("signal"), "ticker").filter("ticker is not null").distinct()
        out = own if out is None else out.unionByName(own)
    return out


def export_all(datasets: dict[str, DataFrame], root: str, by: dict[str, tuple[str, ...]] | None = None) -> None:
    """Every dataset as JSON below its name; those in ``by`` in a folder for each value of their columns."""
    for name, df in datasets.items():
        if not re.fullmatch(r"[a-z0-9-]+", name):
            raise ValueError(f"not a name of a dataset: {name}")
        export_json(df, f"{root}/{name}", (by or {}).get(name, ()))


def export_warehouse(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def export_json(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)
