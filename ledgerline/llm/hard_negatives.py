"""Hard negatives for contrastive training, by a full sort of each anchor's scores.

Rows that take part are quantised once and written. Anchors go in blocks of bounded bytes, one after another; a block is broadcast twice. First every task scores its rows, in
blocks of ``BLOCK``, against all anchors of the block, sorts each anchor's scores by score and id, and keeps the first rows of the anchor's own label; the best of all tasks are
the anchor's positives. Then the scores are sorted again, now with the positives at hand: a binary search in the scores of rows with other labels finds where a positive's upper
limit begins, and the next rows are read while they reach the lower limit. A task keeps ``negatives`` rows for each anchor and positive, and a window ranks those of all tasks. So
an anchor's scores are never in one place, no vector is shuffled, and what leaves a task doesn't grow with its rows.

Defined results: components become floor(scale * x). Rows with a null id, a null label or a null vector, or with a null or non-finite component, take no part. Vectors
of different lengths are compared as if padded with zeros. Rows that repeat an anchor's id are the anchor's own: one of them (of the least label and vector) is the anchor, and
none is a positive or a negative of it; other rows that repeat an id each take part, also as positives. Higher scores come first, ties by smaller id. A negative has to lie within
low / 100 and high / 100 of the positive's score, both included, so that a positive with a negative score has none. A score has to fit a long. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import Tables, table
from .topk import _kind, _matrix

BLOCK = 4096
#: Anchors whose scores against a block of rows are held at once.
TOGETHER = 128
#: What a block of anchors may take as 64-bit numbers.
ANCHOR_BYTES = 16 << 20
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256.0


def labelled(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, label and the integer vector of the rows that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(v))
    rows = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * F.lit(scale)).cast("long")).alias("v"))


def mislabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The rows with the label of every so many replaced by the next one: noise that mining has to live with."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


class Sorted:
    """A block of rows against some anchors: integer scores, each anchor's in order of score and id."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        width = max(q.shape[1], x.shape[1])
        q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
        kind = _kind(q, x)
        scores = (q.astype(kind) @ x.astype(kind).T).astype(np.int64)
        order = np.argsort(-scores, axis=1, kind="stable")  # the rows come in order of their ids
        self.scores, self.ids, self.labels = np.take_along_axis(scores, order, axis=1), ids[order], labels[order]


class Best:
    """The first ``k`` rows of every slot seen so far; a slot is an anchor, or one of an anchor's positives."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((slot, score, ids))
        self.size += len(slot)
        if self.size > 1 << 20:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return (np.zeros(0, dtype=np.int64),) * 3
        slot, score, ids = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = place < self.k
        self.held, self.size = [(slot[keep], score[keep], ids[keep])], 0
        return self.held[0]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids = part.column("vec_id").to_numpy().astype(np.int64)
            order = np.argsort(ids, kind="stable")
            yield ids[order], part.column("label").to_numpy().astype(np.int64)[order], _matrix(part.column("v"), width)[order]


def _positives(sent, k: int):
    """Each anchor's first rows of its own label among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label, q = sent.value
        best = Best(k)
        for ids, labels, x in _blocks(batches, q.shape[1]):
            for at in range(0, len(own), TOGETHER):
                to = slice(at, at + TOGETHER)
                rows = Sorted(q[to], ids, labels, x)
                mine = (rows.labels == label[to, None]) & (rows.ids != own[to, None])
                a, b = np.nonzero(mine & (np.cumsum(mine, axis=1) <= k))
                best.add(at + a, rows.scores[a, b], rows.ids[a, b])
        slot, score, ids = best.merge()
        yield pa.record_batch([pa.array(own[slot]), pa.array(ids), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])

    return run


def limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest score of a negative: low * score <= 100 * negative <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(sent, k: int, low: int, high: int):
    """For each positive, the first rows of other labels within its limits among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label, q, begins, positive, score = sent.value
        bounds = np.array([limits(int(s), low, high) for s in score], dtype=np.int64).reshape(-1, 2)
        best = Best(k)
        for ids, labels, x in _blocks(batches, q.shape[1]):
            for at in range(0, len(own), TOGETHER):
                rows = Sorted(q[at : at + TOGETHER], ids, labels, x)
                for i in range(at, min(at + TOGETHER, len(own))):
                    a, b = begins[i], begins[i + 1]
                    others = np.flatnonzero((rows.labels[i - at] != label[i]) & (rows.ids[i - at] != own[i]))
                    if a == b or not len(others):
                        continue
                    down = -rows.scores[i - at, others]
                    first = np.searchsorted(down, -bounds[a:b, 1], side="left")
                    spot = first[:, None] + np.arange(k)[None, :]
                    inside = spot < len(down)
                    spot = np.where(inside, spot, 0)
                    slot, place = np.nonzero(inside & (-down[spot] >= bounds[a:b, :1]))
                    spot = spot[slot, place]
                    best.add(a + slot, -down[spot], rows.ids[i - at, others[spot]])
        slot, found, ids = best.merge()
        anchor = np.repeat(np.arange(len(own)), np.diff(begins))[slot]
        columns = (own[anchor], slot - begins[anchor], positive[slot], ids, score[slot], found)
        yield pa.record_batch([pa.array(c) for c in columns], names=["anchor_id", "place", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def _first(found: DataFrame, k: int, by: list[str], score: str, tie: str) -> DataFrame:
    ranked = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; both inputs as ``labelled`` returns them, anchors from among the rows."""
    spark = rows.sparkSession
    tables = Tables(spark, "negatives")
    rows = tables.save(rows, "rows")
    one = F.min(F.struct("label", "v")).alias("one")
    anchors = tables.save(anchors.groupBy("vec_id").agg(one).select("vec_id", "one.label", "one.v"), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    blocks = max(1, -(-size["n"] * 8 * (size["width"] or 1) // ANCHOR_BYTES))
    anchors = tables.save_parts(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "dealt", "block")
    for block in range(blocks):
        own = anchors.filter(F.col("block") == block).select("vec_id", "label", "v").toArrow().combine_chunks().sort_by("vec_id")
        ids, label = (own.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        column = own.column("v").combine_chunks()
        q = _matrix(column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks), 0) if len(ids) else np.zeros((0, 0), dtype=np.int64)
        sent = spark.sparkContext.broadcast((ids, label, q))
        near = tables.save(rows.mapInArrow(_positives(sent, positives), "anchor_id long, positive_id long, positive_score long"), f"near/block={block}")
        sent.destroy()
        near = _first(near, positives, ["anchor_id"], "positive_score", "positive_id").toArrow().sort_by([("anchor_id", "ascending"), ("rank", "ascending")])
        of, positive, score = (near.column(c).to_numpy().astype(np.int64) for c in ("anchor_id", "positive_id", "positive_score"))
        sent = spark.sparkContext.broadcast((ids, label, q, np.append(np.searchsorted(of, ids), len(of)), positive, score))
        kinds = "anchor_id long, place long, positive_id long, negative_id long, positive_score long, negative_score long"
        tables.save(rows.mapInArrow(_negatives(sent, negatives, low, high), kinds), f"found/block={block}")
        sent.destroy()
    found = _first(tables.read("found", kinds), negatives, ["anchor_id", "place"], "negative_score", "negative_id")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mislabelled(labelled(table(spark, sf_dir, "embeddings")))
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 50 == 0))


SQL = f"""
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: CAST(floor({SCALE:.0f} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS d FROM v),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, any_value(q.label = c.label) AS same, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM e AS q JOIN e AS c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
