"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is the value of its bytes as a polynomial, in two prime fields. The fingerprint of a concatenation
follows from those of its parts: ``F(xy) = F(x) * B^len(y) + F(y)``. So a text of any length is hashed chunk by chunk, in
any grouping, and the chunk values combine by length-shifted arithmetic. The chunks of a text longer than ``HUGE`` are dealt to all tasks, hashed there in parallel, and
combined by the plan. Texts with equal fingerprints are then compared chunk by chunk on their bytes; a collision splits the group.

Data flow: one pass over the texts makes fingerprints (a few dozen bytes a document). Groups are counted with map-side
combining, so a group of a third of all rows costs no more than any other. Only texts whose fingerprint occurs twice are read
again and cut into chunks; equal chunks combine before they are shuffled. No pair of documents is formed. Rows are told apart by 128 bits of their id and text, never by their id
alone.

Defined results: texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
doc_id stays (rows with a null id only if there is no other); rows that repeat both id and text are each returned, with the same values. ``drop_copies`` keeps one
row of every text. An id may repeat with other texts. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import raw, slices
from .sieve import passes, sieve
from .tables import Tables, keep_rows, only, row_keys, table

CHUNK = 1 << 16
HUGE = 1 << 23
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1812433253 % 2147483629)


@cache
def _powers(field: int, n: int) -> np.ndarray:
    """B^(n-1) ... B^0 in the field."""
    out, value = np.empty(n, dtype=np.uint64), 1
    for i in range(n - 1, -1, -1):
        out[i] = value
        value = value * BASES[field] % PRIMES[field]
    return out


def chunk_print(chunk: bytes) -> tuple[int, int, int]:
    """(length, value, value) of at most ``CHUNK`` bytes."""
    values = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64)
    n = len(values)
    sums = [int(np.dot(values, _powers(f, CHUNK)[CHUNK - n :])) % PRIMES[f] for f in (0, 1)]
    return n, sums[0], sums[1]


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of a concatenation; associative, with (0, 0, 0) as its neutral element."""
    n = right[0]
    a, b = ((left[f + 1] * pow(BASES[f], n, PRIMES[f]) + right[f + 1]) % PRIMES[f] for f in (0, 1))
    return left[0] + n, a, b


def fingerprint(text: bytes) -> tuple[int, int, int]:
    if len(text) <= CHUNK:
        return chunk_print(text)
    total = (0, 0, 0)
    for at in range(0, len(text), CHUNK):
        total = combine(total, chunk_print(text[at : at + CHUNK]))
    return total


def _packed(whole: tuple[int, int, int], weaken: int) -> tuple[int, int]:
    """The fingerprint as two longs; ``weaken`` keeps only so many values of it, to provoke collisions in tests."""
    n, a, b = whole
    if weaken:
        return 0, (a + b + n) % weaken
    return n, a << 31 | b


def _prints(weaken: int, huge: int):
    """size, print (null for a huge text) and SHA-256 of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            lowered = [t.lower() for t in texts]
            prints = [_packed(fingerprint(t), weaken) if len(t) <= huge else (None, None) for t in lowered]
            columns = [*(part.column(c) for c in ("doc_id", "key", "key2")), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1))]
            digests = pa.array([hashlib.sha256(t).hexdigest() for t in lowered], pa.string())
            yield pa.record_batch([*columns, digests], names=["doc_id", "key", "key2", "size", "print", "text_sha256"])

    return run


def _pieces(huge: int):
    """The chunks of huge texts: SHA-256 of the text, number, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for text in raw(batch.column("text")):
                text = text.lower()
                digest = hashlib.sha256(text).hexdigest()
                if digest not in seen:
                    seen.add(digest)
                    for at in range(0, len(text), CHUNK):
                        yield pa.record_batch([pa.array([digest]), pa.array([at // CHUNK], pa.int64()), pa.array([text[at : at + CHUNK]], pa.binary())], names=["text_sha256", "chunk", "bytes"])

    return run


def _piece_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every chunk its value in both fields, and the factor by which it shifts what comes before it."""
    for batch in batches:
        prints = [chunk_print(x) for x in raw(batch.column("bytes"))]
        columns = [[p[0] for p in prints], *([p[f + 1] for p in prints] for f in (0, 1)), *([pow(BASES[f], p[0], PRIMES[f]) for p in prints] for f in (0, 1))]
        yield pa.record_batch([batch.column("text_sha256"), batch.column("chunk"), *(pa.array(c, pa.int64()) for c in columns)], names=["text_sha256", "chunk", "n", "a", "b", "by_a", "by_b"])


def huge_prints(own: DataFrame, huge: int, weaken: int) -> DataFrame:
    """text_sha256, size, print of the texts longer than ``huge`` bytes: chunks are hashed in parallel and combined in their order."""
    pieces = own.filter(F.octet_length("text") > huge).mapInArrow(_pieces(huge), "text_sha256 string, chunk long, bytes binary")
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = pieces.repartition(tasks, "text_sha256", "chunk").mapInArrow(_piece_prints, "text_sha256 string, chunk long, n long, a long, b long, by_a long, by_b long")
    each = hashed.distinct().groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("chunk", "n", "a", "b", "by_a", "by_b"))).alias("parts"))  # 48 bytes for 64 KB
    zero = F.lit(0).cast("long")

    def step(left: Column, right: Column) -> Column:
        values = [((left[f] * right[f"by_{f}"] + right[f]) % PRIMES[k]).alias(f) for k, f in enumerate("ab")]
        return F.struct((left["n"] + right["n"]).alias("n"), *values)

    whole = each.select("text_sha256", F.aggregate("parts", F.struct(zero.alias("n"), zero.alias("a"), zero.alias("b")), step).alias("w")).select("text_sha256", "w.*")
    if weaken:
        return whole.select("text_sha256", zero.alias("size"), ((F.col("a") + F.col("b") + F.col("n")) % weaken).alias("print"))
    return whole.select("text_sha256", F.col("n").alias("size"), F.shiftleft("a", 31).bitwiseOR(F.col("b")).alias("print"))


def _chunks(bitmap: np.ndarray):
    """The chunks of texts that may be in a group, under the name of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            hit = passes(bitmap, part.column("key").to_numpy())
            rows: dict[str, list] = {"text_sha256": [], "chunk": [], "bytes": []}
            for text, near in zip(texts, hit, strict=True):
                if near:
                    text = text.lower()
                    digest = hashlib.sha256(text).hexdigest()
                    for k in range(max(1, -(-len(text) // CHUNK))):
                        for name, x in zip(rows, (digest, k, text[k * CHUNK : (k + 1) * CHUNK]), strict=True):
                            rows[name].append(x)
            kinds = (pa.string(), pa.int64(), pa.binary())
            yield pa.record_batch({name: pa.array(x, kind) for (name, x), kind in zip(rows.items(), kinds, strict=True)})

    return run


def _grouped(docs: DataFrame, doc_id: str, text: str, weaken: int, tables: Tables) -> DataFrame:
    """doc_id, key, key2, text_sha256 of every row; with keep_id and group_size, and ``class``, the name of its text's group, where the group has several rows."""
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).select("doc_id", *row_keys(), "text")
    prints = tables.save(own.mapInArrow(_prints(weaken, HUGE), "doc_id long, key long, key2 long, size long, print long, text_sha256 string"), "prints")
    if not prints.filter("print is null").isEmpty():
        more = tables.save(huge_prints(own, HUGE, weaken).withColumnsRenamed({"size": "__size", "print": "__print"}), "huge")
        prints = prints.join(more, "text_sha256", "left").withColumns({"size": F.coalesce("size", "__size"), "print": F.coalesce("print", "__print")}).drop("__size", "__print")
        prints = tables.save(prints, "all-prints")
    group = ["size", "print"]
    repeated = tables.save(
        prints.groupBy(*group).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("text_sha256").alias("class")).filter("group_size > 1"), "groups"
    )
    members = tables.save(prints.join(repeated.select(*group), group, "left_semi").select(*group, "text_sha256", "key"), "members")
    cut = own.select("key", "text").mapInArrow(_chunks(sieve(members, "key")), "text_sha256 string, chunk long, bytes binary").distinct()
    cut = cut.join(members.select(*group, "text_sha256").distinct(), "text_sha256")
    contents = cut.groupBy(*group, "chunk", "bytes").agg(F.min("text_sha256").alias("class")).groupBy(*group, "chunk").agg(F.count("*").alias("contents"))
    collided = tables.save(contents.filter("contents > 1").select(*group).distinct(), "collided")
    if collided.isEmpty():
        return prints.join(repeated, group, "left")
    # groups whose texts differ in some chunk fall apart by the class of every chunk, which is the least text that has those bytes there
    held = tables.save(cut.join(collided, group, "left_semi"), "held")
    classes = held.groupBy(*group, "chunk", "bytes").agg(F.min("text_sha256").alias("class"))
    path = held.join(classes, [*group, "chunk", "bytes"]).groupBy(*group, "text_sha256").agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct("chunk", "class")))), 256).alias("path"))
    apart = tables.save(prints.join(collided, group, "left_semi").join(path, [*group, "text_sha256"]), "apart")
    split = apart.groupBy(*group, "path").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("text_sha256").alias("class"))
    inside = apart.join(split, [*group, "path"]).drop("path")
    outside = prints.join(collided, group, "left_anti").join(repeated, group, "left")
    return outside.unionByName(inside)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weaken: int = 0) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = _grouped(docs, doc_id, text, weaken, Tables(docs.sparkSession, "exact"))
    keep = F.coalesce("keep_id", "doc_id")
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weaken: int = 0) -> DataFrame:
    """The documents that stay, with all their columns: one row of every text, of the largest id."""
    tables = Tables(docs.sparkSession, "exact")
    found = _grouped(docs, doc_id, text, weaken, tables).filter("group_size > 1")
    rows = tables.save(found.groupBy("class", "key", "key2").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("times")), "rows")
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), F.col("doc_id").isNotNull(), F.col("key"), F.col("key2"))
    best = rows.groupBy("class").agg(F.max_by(F.struct("key", "key2"), order).alias("best"))
    fate = rows.join(best, "class").select("key", "key2", (F.struct("key", "key2") == F.col("best")).alias("stays"), "times")
    return keep_rows(docs, tables.save(fate, "fate"), doc_id, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
