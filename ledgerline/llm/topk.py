"""Exact top-k inner products by columnar branch and bound.

Vectors lie in vertical layout: a block of candidates is a matrix with a row per dimension. Scores accumulate one block of dimensions at a time, the
dimensions with the most query mass first. What the rest of the dimensions can still add is at most the product of the remaining norms
(Cauchy-Schwarz); a candidate that can't reach the k-th best score any more is dropped and the survivors are compacted. The bound starts at the k-th
best score among the queries themselves, which are candidates too, and rises with every block.

Queries are handled in blocks of about ``QUERIES`` vectors, one after another: a block is read to the driver and broadcast (of bounded size, whatever the number of
queries), one scan of the candidates answers it, its answers are written and the broadcast is freed. A partition returns its k best for each query; the last
step ranks those. No vector is shuffled.

Defined results: components become floor(1024 * x). Vectors that are null, or hold null or non-finite components, and rows with a null id take no
part. Vectors of different lengths are compared as if padded with zeros. Rows that repeat a query's id are the query's own; of such rows
one is the query. A score has to fit a long. Ties go to the smaller vec_id; a query with fewer candidates returns all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import Tables, table

QUERIES = 2048
BLOCK = 4096
STEP = 16


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and the integer vector of the rows that take part."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v)
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(v))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 1024.0)).alias("v")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    longest = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), longest), dtype=np.int64)
    out[np.arange(longest)[None, :] < lengths[:, None]] = flat
    return out


def _kind(a: np.ndarray, b: np.ndarray):
    """The fastest number type in which all sums of products are exact."""
    if not a.size or not b.size:
        return np.float64
    top = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    return np.float64 if top < 1 << 53 else object


class Search:
    """The best k of the candidates seen so far, for one block of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.q, self.k, self.bound = ids, q, k, floor.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in ids]
        self.looked = self.total = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        width = max(self.q.shape[1], x.shape[1])
        q = np.pad(self.q, ((0, 0), (0, width - self.q.shape[1])))
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        order = np.argsort(-(q.astype(float) ** 2).sum(axis=0), kind="stable")
        kind = _kind(q, x)
        columns, q = np.ascontiguousarray(x[:, order].T.astype(kind)), q[:, order].astype(kind)
        steps = range(0, width, STEP)
        left_x = [np.sqrt((columns[s + STEP :].astype(float) ** 2).sum(axis=0)) for s in steps]
        left_q = [np.sqrt((q[:, s + STEP :].astype(float) ** 2).sum(axis=1)) for s in steps]
        first = q[:, :STEP] @ columns[:STEP]
        for i, own in enumerate(self.ids):
            alive, score = np.flatnonzero(ids != own), first[i]
            score = score[alive]
            for j, s in enumerate(steps):
                if j:
                    score = score + q[i, s : s + STEP] @ columns[s : s + STEP, alive]
                    self.looked += len(alive)
                slack = left_q[j][i] * left_x[j][alive]
                keep = score.astype(float) + slack * (1 + 1e-9) + 1e-6 >= self.bound[i]
                if not keep.all():
                    alive, score = alive[keep], score[keep]
                if not len(alive):
                    break
            self.total += len(ids) * (len(steps) - 1)
            if len(alive):
                self._merge(i, ids[alive], np.array([int(v) for v in score], dtype=np.int64) if kind is object else score.astype(np.int64))

    def _merge(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate((self.best[i][0], ids)), np.concatenate((self.best[i][1], score))
        order = np.lexsort((ids, -score))[: self.k]
        self.best[i] = ids[order], score[order]
        if len(order) == self.k:
            self.bound[i] = max(self.bound[i], float(self.best[i][1][-1]))


def _floor(ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score among the queries of the block, below every final k-th best score."""
    out = np.full(len(ids), -np.inf)
    kind = _kind(q, q)
    if len(ids) > k and kind is np.float64:
        for at in range(0, len(ids), 256):
            score = q[at : at + 256].astype(kind) @ q.T.astype(kind)
            score[ids[at : at + 256, None] == ids[None, :]] = -np.inf
            out[at : at + 256] = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as ``quantised`` returns them."""
    spark = vectors.sparkSession
    tables = Tables(spark, "topk")
    queries = tables.save(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    if blocks > 1:  # a block is a part of the table, so that reading all of them reads it once
        queries = tables.save_parts(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "dealt", "block")
    found = []
    for block in range(blocks):
        own = queries.filter(F.col("block") == block).select("vec_id", "v") if blocks > 1 else queries
        own = own.toArrow().combine_chunks()
        ids = own.column("vec_id").to_numpy().astype(np.int64)
        column = own.column("v").combine_chunks()
        q = _matrix(column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks), 0) if len(ids) else np.zeros((0, 0), dtype=np.int64)
        sent = spark.sparkContext.broadcast((ids, q, _floor(ids, q, k)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, floor = sent.value
            search = Search(ids, q, k, floor)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    search.add(part.column("vec_id").to_numpy().astype(np.int64), _matrix(part.column("v"), q.shape[1]))
            for i, own_id in enumerate(ids):
                best, score = search.best[i]
                if len(best):
                    yield pa.record_batch(
                        [pa.array(np.full(len(best), own_id)), pa.array(best), pa.array(score)], names=["query_id", "vec_id", "score"]
                    )

        found.append(tables.save(vectors.mapInArrow(run, "query_id long, vec_id long, score long"), f"found/block={block}"))
        sent.destroy()
    best = found[0] if blocks == 1 else tables.read("found", "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM e AS q JOIN e AS c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
