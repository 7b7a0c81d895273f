"""Exact Jaccard join of documents on word n-grams, by signature trees.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents of equal sets (by 128 bits) share one set, with a number of its own. A set's sketch is its size and
its token bitmap of a bit or two a shingle. The join runs in four steps.

1. Partitions. Two sets with a similarity of 0.75 share a shingle among the first quarter of each in any common order. So the trees' first two levels are a shingle and a
   range of sizes: a partition holds the sets that have this shingle in their first quarter and are neighbours in size. The order puts the shingles that most documents
   have last (at most ``COMMON`` of them; every task counts all its shingles, and any it sees twice is added up over all tasks), and the rest by hash. Any common
   order is right; this one keeps passages that many documents share from filling partitions. Partitions of the same sets become one.
2. Trees. In every partition sets are the leaves of a signature tree, whose nodes hold the OR of bitmaps and a range of sizes; dual traversal of the trees gives the candidates: a
   pair of nodes is left out when the largest overlap that bitmaps and sizes allow falls short. A partition of more than 2,048 sets is cut into units, and pairs of units that
   are not connected yet meet in tasks of their own, so that no partition has to fit one task. To spare most of that work, sets which share one of
   their ``LEADS`` least shingles are joined first, by trees too; partitions whose sets are all connected by then hold nothing new.
3. Sets that candidates connect form groups; within a group units have trees again, and what reaches two leaves is compared exactly on its texts. Sets that are connected already
   aren't compared again.
4. The links' components, by a distributed union-find, give each document the smallest id that it reaches.

Texts are read three times (sets, first quarters, texts of grouped documents), in slices of 512 KB, and only texts of documents in a group are shuffled.

Defined results: words are maximal runs without 0x20, 0x09 to 0x0D, after lower-casing A-Z; a text with one to four words has one shingle, all of them; null,
empty and blank texts have an empty set and link with nothing (not even with each other). Rows are told apart by id and text, so that an id may repeat with other texts; a row with
a null id takes part like any other and has the smallest id of its component, or null if there is none; rows that repeat are each returned. Shingles are equal when their 64-bit
hashes are. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U, set_print, shingle_sets, signed, slices
from .links import ENTRIES, close_links, packed_entries, set_links, shared_key_groups, sketch, sketch_links
from .sieve import passes, sieve
from .tables import Tables, keep_rows, only, row_keys, table

WIDTH, PERCENT = 5, 75
COMMON = 1 << 19
#: Values of distinct sets that a task gathers before it counts which of them occur twice.
GATHER = 2_000_000
SLICE = 1 << 19
ENTRIES_A_TASK = 750_000
#: Least shingles of a set that join it with others beforehand.
LEADS = 4
#: A shingle that more sets have (as far as tasks see it twice) forms partitions without its sets meeting in one task.
HOT = 10_000


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for part, texts in slices(batches, "text", SLICE):
            sets = shingle_sets(texts, width)
            prints = [set_print(s) for s in sets]
            for p, s in zip(prints, sets, strict=True):
                if len(s) and p not in gathered:
                    gathered[p] = s
                    size += len(s)
            columns = [[len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints]]
            nothing = pa.nulls(part.num_rows, pa.binary())
            leads = pa.array([signed(s[:LEADS]).tolist() for s in sets], pa.list_(pa.int64()))
            sketches = pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())
            own = (part.column(c) for c in ("doc_id", "key", "key2"))
            yield pa.record_batch([*own, *(pa.array(c, pa.int64()) for c in columns), nothing, nothing, leads, sketches], names=_SETS)
            if size > GATHER:
                yield _often(gathered)
                gathered, size = {}, 0
        if gathered:
            yield _often(gathered)

    return run


_SETS = ["doc_id", "key", "key2", "n", "print", "check", "often", "counts", "leads", "sketch"]


def _often(sets: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    """A row with the values that several of these sets have, and with how many have them."""
    values, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    some = counts > 1
    packed = [pa.array([x[some].astype(k).tobytes()], pa.binary()) for x, k in ((values, U), (counts, np.int64))]
    return pa.record_batch([*(pa.nulls(1, pa.int64()) for _ in range(6)), *packed, pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary())], names=_SETS)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for often, counts in zip(batch.column("often"), batch.column("counts"), strict=True):
            values = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (often, counts)]
            yield pa.record_batch([pa.array(v) for v in values], names=["value", "n"])


def common_values(found: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, rarest first, and how often they were seen: at most ``most`` of them, 16 bytes each."""
    counted = found.filter("often is not null").select("often", "counts").mapInArrow(_unpack, "value long, n long")
    top = counted.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(most)
    top = top.toArrow().sort_by([("n", "ascending"), ("value", "ascending")])
    return top.column("value").to_numpy().astype(np.int64).view(U), top.column("n").to_numpy().astype(np.int64)


class Order:
    """A common order of all values: by hash, with the frequent ones last, rarest of them first."""

    def __init__(self, frequent: np.ndarray):
        at = np.argsort(frequent)
        self.values, self.ranks = frequent[at], at.astype(U)
        self.near = np.zeros(1 << 23, dtype=bool)  # which low bits the frequent values have: a cheap first test
        self.near[(frequent & U((1 << 23) - 1)).astype(np.int64)] = True

    def keys(self, values: np.ndarray) -> np.ndarray:
        out = values >> U(1)
        some = np.flatnonzero(self.near[(values & U((1 << 23) - 1)).astype(np.int64)])
        if len(some):
            at = np.searchsorted(self.values, values[some])
            at[at == len(self.values)] = 0
            hit = self.values[at] == values[some]
            out[some[hit]] = (U(1) << U(63)) | (self.ranks[at[hit]] << U(40))
        return out


def _quarter(n: int, percent: int) -> int:
    """How many first values of a set of n are sure to hold one of any similar set."""
    return n - -(-(percent * n) // 100) + 1


def _first(width: int, percent: int, sent) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The keys of the first quarters of the distinct sets of some texts, with the sets' prints and sizes."""
    order = Order(sent.value[0])

    def first(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distinct = {set_print(s)[0]: s for s in shingle_sets(texts, width) if len(s)}
        keys = [np.sort(order.keys(values))[: _quarter(len(values), percent)] for values in distinct.values()]
        n = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
        names = np.repeat(np.fromiter(distinct, dtype=np.int64, count=len(keys)), n)
        return np.concatenate([np.zeros(0, dtype=U), *keys]), names, np.repeat(np.fromiter(map(len, distinct.values()), dtype=np.int64, count=len(keys)), n)

    return first


def _entries(sent, width: int, percent: int, parts: int):
    """The packed keys; those of hot shingles apart, dealt by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _first(width, percent, sent)
        warm = len(sent.value[1]) - int((sent.value[1] > HOT).sum())
        for _, texts in slices(batches, "text", SLICE):
            keys, names, sizes = first(texts)
            hot = keys >= ((U(1) << U(63)) | (U(warm) << U(40)))  # the keys of frequent values are in order of frequency
            # frequent values lie in the upper half of the keys: the parts are ranges of a hash of the key, not of the key
            keys = _scatter(keys)
            if not hot.all():
                yield packed_entries(keys[~hot], names[~hot], sizes[~hot], parts, percent)
            if hot.any():
                yield packed_entries(keys[hot], names[hot], sizes[hot], parts, 0, _scatter(names[hot].view(U)))

    return run


def _scatter(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys * U(0x9E3779B97F4A7C15)
        return x ^ (x >> U(32))


def _near(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.filter(pa.array(passes(bitmap, batch.column("key").to_numpy(zero_copy_only=False))))
            yield pa.record_batch([near.column("key"), near.column("key2"), near.column("text").cast(pa.binary())], names=["key", "key2", "data"])

    return run


def _classes(docs: DataFrame, tables: Tables, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, key, key2, n, print, check); and print, check, rows, label of the sets: label is null where nothing is linked."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", *row_keys(), "text")
    kinds = "doc_id long, key long, key2 long, n long, print long, check long, often binary, counts binary, leads array<long>, sketch binary"
    found = tables.save(own.mapInArrow(_sets(width), kinds), "found")
    sets = found.filter("n is not null").select("doc_id", "key", "key2", "n", "print", "check")
    # equal sets are one; a row of it stands for its text
    one = F.min(F.struct("key", "key2"))
    reps = found.filter("n > 0").groupBy("print", "check").agg(
        F.max("n").alias("n"), F.count("*").alias("rows"), one.alias("k"), F.first("leads").alias("leads"), F.first("sketch").alias("data")
    )
    reps = tables.save(reps.select(F.monotonically_increasing_id().alias("id"), "print", "check", "n", "rows", "k.key", "k.key2", "leads", "data"), "reps")
    size = reps.agg(F.sum("n").alias("values")).first()["values"] or 0
    parts = max(64, 4 * -(-size // (4 * ENTRIES_A_TASK)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts // 4)
    sent = spark.sparkContext.broadcast(common_values(found))
    members = shared_key_groups(own.select("text").mapInArrow(_entries(sent, width, percent, parts), ENTRIES), tasks)
    members = members.withColumnRenamed("id", "print").join(reps.select("print", "id", "n"), "print").select("group", "id", "n")
    members = tables.save(members, "members")
    tables.free()
    leads = reps.select(F.explode("leads").alias("group"), "id", "n", "data")
    close = tables.save(close_links(leads, percent, tables, "close"), "close")
    labelled = members.join(close.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = labelled.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("group")
    members = tables.save(members.join(mixed, "group", "left_semi"), "mixed")
    # no text travels before its sketch has shown that it may have a partner
    some = reps.select("id", "data").join(members.select("id").distinct(), "id", "left_semi")
    able = sketch_links(members, some, percent, tables, "able", close).withColumnsRenamed({"node": "id", "label": "able"})
    able = tables.save(able.join(reps.select("id", "n", "key", "key2"), "id").select("id", "n", F.col("able").alias("group"), "key", "key2"), "able")
    tables.free()
    again = not found.groupBy("key", "key2").agg(F.count("*").alias("c")).filter("c > 1").isEmpty()

    def read(ids: DataFrame) -> DataFrame:
        wanted = tables.save(able.select("id", "key", "key2").join(ids.select("id").distinct(), "id", "left_semi"), f"wanted-{uuid.uuid4().hex}")
        texts = own.select("key", "key2", "text").mapInArrow(_near(sieve(wanted, "key")), "key long, key2 long, data binary")
        texts = texts.join(wanted, ["key", "key2"])
        return (texts.groupBy("id").agg(F.first("data").alias("data")) if again else texts).select("id", "data")

    labels = tables.save(set_links(able.select("group", "id", "n"), read, partial(shingle_sets, width=width), percent, tables, "links"), "labels")
    return sets, reps.select("id", "print", "check", "rows").join(labels.withColumnRenamed("node", "id"), "id", "left").drop("id")


def _shared(docs: DataFrame, tables: Tables, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows as in ``_classes``; and print, check, component of the sets that several rows have or that are linked: what else there is are documents alone."""
    sets, classes = _classes(docs, tables, width, percent)
    long = F.lit(0).cast("long")
    component = F.struct(F.lit(0).alias("of"), F.col("label").alias("a"), long.alias("b"))
    alone = F.struct(F.lit(1).alias("of"), F.col("print").alias("a"), F.col("check").alias("b"))
    linked = F.when(F.col("label").isNotNull(), component).otherwise(alone)
    return sets, tables.save(classes.filter("rows > 1 or label is not null").select("print", "check", linked.alias("component")), "special")


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    tables = Tables(docs.sparkSession, "ngrams")
    sets, special = _shared(docs, tables, width, percent)
    ids = sets.filter("n > 0").groupBy("print", "check").agg(F.min("doc_id").alias("least")).join(special, ["print", "check"])
    ids = tables.save(ids.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    named = special.join(ids, "component").select("print", "check", "component_id")
    return sets.join(named, ["print", "check"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with all their columns: of each component one row, of its smallest id (a null one only if there is no other)."""
    tables = Tables(docs.sparkSession, "ngrams")
    sets, special = _shared(docs, tables, width, percent)
    rows = sets.filter("n > 0").join(special, ["print", "check"]).groupBy("component", "key", "key2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"))
    rows = tables.save(rows, "rows")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"), F.col("key2"))
    best = rows.groupBy("component").agg(F.min_by(F.struct("key", "key2"), order).alias("best"))
    fate = rows.join(best, "component").select("key", "key2", (F.struct("key", "key2") == F.col("best")).alias("stays"), "times")
    return keep_rows(docs, tables.save(fate, "fate"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"))
