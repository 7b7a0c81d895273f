"""Quality by ordinal regression (cumulative links) on graded ratings.

Grades: 0 poor, 1 good but toxic, 2 good and clean. One weight vector over hashed text features is shared by all grades; ordered thresholds turn its
score s into P(grade <= j) = 1 / (1 + exp(s - theta_j)). A document's expected grade and the probability of the top grade follow, and the
latter selects: from a least probability for each language, where the share of rows of lower grades that are kept and the share of those of the top
grade that are not sum to the least, over rows of the sample that the model was not trained on (``FOLDS`` parts, each judged by a model of the others). A language
with fewer than ``ENOUGH`` rows of either kind, or documents without a column ``lang``, go by all languages together, and that by ``LEAST``.

Features of a text: its distinct lower-cased words without ASCII punctuation and their first five bytes, hashed, of which those weigh that the sample
shows to go with a grade (chi-square); and a few hashed descriptions of its shape (shares of capitals, digits, symbols and punctuation among its bytes, share of distinct words, length, words per line, each as a level).

Training reads a bounded sample: the ``SAMPLE`` labelled ids that come first in the order of a hash of the id, one text each, and of those as many as have ``NONZEROS`` features
together, in the same order. Only they are collected, and train on the driver. Every document is scored, over its whole text, in
slices of 1 MB; the broadcast weights have a fixed size.

Defined results: null counts as empty; labels with a null quality or id are skipped and a null ``toxic`` is 0; a label of a missing document is skipped; of several labels of an id
the lowest grade counts, and of several texts of an id the least one trains; if the sample holds fewer than two grades every document is kept, with the top grade. Every row is scored
by its own text, so that repeated rows score alike and rows that share an id, or have none, by their texts. An empty table gives an empty result. Documents keep all
their columns in ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import U, mix, slices, word_hashes
from .tables import Tables, only, table

BITS = 18
SAMPLE = 6000
NONZEROS = 20_000_000
GRADES = 3
LEAST = 0.5  # the least probability of the top grade that selects, where the sample is too small to choose it
FOLDS, ENOUGH = 3, 20
ROUNDS, STEP = 150, 0.6
TELLING = 27.6  # a feature is trained if its chi-square over the grades of the sample is as large; by chance one of millions is
WORD, SHAPE = 0.25, 0.3
HEAD = 5  # bytes of a word's beginning, a feature of its own
DECAY = 2e-5
_PLAIN = bytes(c if not (33 <= c < 127 and not chr(c).isalnum()) else 32 for c in range(256))
_CLASSES = np.zeros((256, 5), dtype=np.float32)  # capitals, digits, symbols, punctuation, line ends
for _c in range(256):
    _CLASSES[_c] = [65 <= _c <= 90, 48 <= _c <= 57, chr(_c) in "#$%&*@^~|<>{}[]\\+=_", chr(_c) in ".,;:!?\"'()-", _c == 10]


def _levels(x: np.ndarray) -> np.ndarray:
    return np.digitize(x, (0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, offsets) of the texts, one run of slots each."""
    plain = [t.translate(_PLAIN) for t in texts]
    words, at = word_hashes(plain)
    heads = word_hashes(plain, HEAD)[0]
    sizes = np.array([len(t) for t in texts])
    shares = np.zeros((len(texts), _CLASSES.shape[1]))
    for i, text in enumerate(texts):
        if text:
            shares[i] = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _CLASSES / len(text)
    counts = np.diff(at)
    slots, values, offsets = [], [], [0]
    distinct = np.zeros(len(texts))
    own_slots = []
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        own = np.unique(words[a:b])
        distinct[i] = len(own) / max(1, b - a)
        own = np.concatenate((own, np.unique(heads[a:b]) ^ U(1)))
        own_slots.append((own & U((1 << BITS) - 1)).astype(np.int64))
    described = np.stack(
        [*(_levels(s) for s in shares.T), _levels(distinct), np.log2(sizes + 1).astype(int), np.log2(counts / (shares[:, 4] * sizes + 1) + 1).astype(int)], axis=1
    )
    names = np.arange(described.shape[1], dtype=U) * U(1000) + U(1_000_003)
    shape = (mix(described.astype(U) + names[None, :]) & U((1 << BITS) - 1)).astype(np.int64)
    for i, own in enumerate(own_slots):
        slots += [own, shape[i]]
        values += [np.full(len(own), WORD), np.full(shape.shape[1], SHAPE)]
        offsets.append(offsets[-1] + len(own) + shape.shape[1])
    return np.concatenate(slots), np.concatenate(values), np.array(offsets)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chi_square(slots: np.ndarray, grades: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each slot how far the grades of the documents that have it are from the grades of all."""
    seen = np.stack([np.bincount(slots[grades == g], minlength=1 << BITS) for g in range(GRADES)]).astype(float)
    share = (sizes / sizes.sum())[:, None]
    expected = seen.sum(axis=0)[None, :] * share
    return ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0) / np.maximum(1e-9, 1 - seen.sum(axis=0) / sizes.sum()).clip(0.05)


def least(top: np.ndarray, grades: np.ndarray, otherwise: float) -> float:
    """The probability from which to keep rows, for the least sum of the shares of lower grades kept and of top grades dropped."""
    good = grades == GRADES - 1
    if min(good.sum(), (~good).sum()) < ENOUGH:
        return otherwise
    at = np.linspace(0.01, 0.99, 99)
    wrong = np.array([(top[~good] >= x).mean() + (top[good] < x).mean() for x in at])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(at[best[len(best) // 2]])


class Ordinal:
    """Weights and ordered thresholds. With no training, everything has the top grade."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS)
        self.theta = np.full(GRADES - 1, -20.0)
        self.least: dict[str, float] = {}
        self.least_of_all = LEAST

    def fit(self, slots: np.ndarray, values: np.ndarray, offsets: np.ndarray, grades: np.ndarray) -> Ordinal:
        """Full-batch Adam on the cumulative-link likelihood; thresholds are kept ordered by positive gaps."""
        if len(np.unique(grades)) < 2:
            return self
        n, rows = len(grades), np.repeat(np.arange(len(grades)), np.diff(offsets))
        telling = chi_square(slots, grades[rows], np.bincount(grades, minlength=GRADES))[slots] >= TELLING
        offsets = np.concatenate(([0], np.cumsum(telling)))[offsets]
        slots, values, rows = slots[telling], values[telling], rows[telling]
        used, local = np.unique(slots, return_inverse=True)
        w = np.zeros(len(used))
        share = np.array([(grades <= j).mean() for j in range(GRADES - 1)]).clip(0.002, 0.998)
        cut = np.log(share / (1 - share))
        params = [w, np.array([cut[0]]), np.log(np.maximum(np.diff(cut), 0.05))]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        one_hot_low = np.arange(GRADES - 1)[None, :] == (grades - 1)[:, None]
        one_hot_high = np.arange(GRADES - 1)[None, :] == grades[:, None]
        for t in range(1, ROUNDS + 1):
            w, first, gaps = params
            theta = first[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
            s = _sums(w[local] * values, offsets)
            p = _sigmoid(theta[None, :] - s[:, None])  # P(grade <= j)
            high = np.where(grades < GRADES - 1, (p * one_hot_high).sum(axis=1), 1.0)
            low = np.where(grades > 0, (p * one_hot_low).sum(axis=1), 0.0)
            inside = np.maximum(high - low, 1e-9)
            slope = p * (1 - p)
            d_high = (slope * one_hot_high).sum(axis=1) / inside
            d_low = (slope * one_hot_low).sum(axis=1) / inside
            d_s = (d_high - d_low) / n  # of the negative log-likelihood
            d_theta = ((-d_high[:, None] * one_hot_high + d_low[:, None] * one_hot_low) / n).sum(axis=0)
            grads = [
                np.bincount(local, weights=d_s[rows] * values, minlength=len(used)) + DECAY * w,
                np.array([d_theta.sum()]),
                np.array([d_theta[j + 1 :].sum() for j in range(GRADES - 2)]) * np.exp(gaps),
            ]
            for i, (p_i, g) in enumerate(zip(params, grads, strict=True)):
                m, v = moments[i]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[i] = p_i - STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights[used] = params[0]
        self.theta = params[1][0] + np.concatenate(([0.0], np.cumsum(np.exp(params[2]))))
        return self

    def learn(self, slots: np.ndarray, values: np.ndarray, offsets: np.ndarray, grades: np.ndarray, langs: list[str]) -> Ordinal:
        """Fits all rows, and chooses the least probabilities on rows that the judging model has not seen."""
        if len(np.unique(grades)) < 2:
            return self
        top, fold, row = np.zeros(len(grades)), np.arange(len(grades)) % FOLDS, np.repeat(np.arange(len(grades)), np.diff(offsets))
        for k in range(FOLDS):
            own = fold[row] != k
            sizes = np.diff(offsets)[fold != k]
            model = Ordinal().fit(slots[own], values[own], np.concatenate(([0], np.cumsum(sizes))), grades[fold != k])
            top[fold == k] = model.top(slots, values, offsets)[fold == k]
        self.least_of_all = least(top, grades, LEAST)
        names = np.array(langs, dtype=object)
        for name in set(langs):
            self.least[name] = least(top[names == name], grades[names == name], self.least_of_all)
        return self.fit(slots, values, offsets, grades)

    def top(self, slots: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 - _sigmoid(self.theta[-1] - _sums(self.weights[slots] * values, offsets))

    def keeps(self, top: np.ndarray, langs: list[str | None] | None = None) -> np.ndarray:
        if langs is None:
            return top >= self.least_of_all
        return top >= np.array([self.least.get(x or "", self.least_of_all) for x in langs])

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and the probability of the top grade."""
        slots, values, offsets = features(texts)
        s = _sums(self.weights[slots] * values, offsets)
        above = 1 - _sigmoid(self.theta[None, :] - s[:, None])  # P(grade > j)
        return above.sum(axis=1), above[:, -1]


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade."""
    toxic = F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    grade = F.when(F.col("quality").cast("int") == 0, 0).when(toxic > 0, 1).otherwise(2)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def language(docs: DataFrame) -> Column:
    return (F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = NONZEROS) -> Ordinal:
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            slots, values, offsets = features(texts)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (slots.astype(np.int32), values.astype(np.float32))]
            yield pa.record_batch([*(part.column(c) for c in ("doc_id", "grade", "lang")), *lists], names=["doc_id", "grade", "lang", "slots", "values"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), language(docs))
    one = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min(F.struct("text", "lang")).alias("of"))  # at most ``sample`` rows
    made = one.select("doc_id", "grade", "of.lang", "of.text").mapInArrow(run, "doc_id long, grade int, lang string, slots array<int>, values array<float>")
    made = Tables(docs.sparkSession, "quality").save(made, "sample")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over the sample
    fits = made.select("doc_id", F.sum(F.size("slots")).over(order).alias("upto")).filter(F.col("upto") <= entries).select("doc_id")
    rows = made.join(F.broadcast(fits), "doc_id").toArrow().sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return Ordinal()
    slots, values = (rows.column(c).combine_chunks() for c in ("slots", "values"))
    slots, values = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (slots, values))
    offsets = slots.offsets.to_numpy().astype(np.int64)
    grades, langs = rows.column("grade").to_numpy().astype(np.int64), [x or "" for x in rows.column("lang").to_pylist()]
    return Ordinal().learn(slots.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float), offsets - offsets[0], grades, langs)


def scores(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_grade, p_top, kept of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            grade, top = sent.value.predict(texts)
            kept = sent.value.keeps(top, part.column("lang").to_pylist())
            yield pa.record_batch([part.column("doc_id"), pa.array(grade), pa.array(top), pa.array(kept)], names=["doc_id", "expected_grade", "p_top", "kept"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), language(docs))
    return own.mapInArrow(run, "doc_id long, expected_grade double, p_top double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose probability of the top grade is the least of their language or more, with all their columns, in one pass over them."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    text, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part, texts in slices(iter((named,)), f"c{text}"):
                langs = part.column(lang).cast(pa.string()).to_pylist() if lang is not None else None
                kept = part.filter(pa.array(model.value.keeps(model.value.predict(texts)[1], langs)))
                yield kept.rename_columns(batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = only(docs, doc_id="long", text="string", **({"lang": "string"} if "lang" in docs.columns else {}))
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
