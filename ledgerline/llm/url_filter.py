"""URL filtering by the ratio of two character language models, below explicit host rules.

Two variable-order Markov models, of accepted and of rejected URLs, give each character a probability from its last 0 to ``ORDER``
characters; an order that has seen little falls back on the next shorter one (Witten-Bell smoothing). A URL's score is the difference of the two
log-likelihoods per character. The threshold is calibrated on labelled URLs of hosts that the models weren't trained on: where the error rates of both
classes sum to the least. Host rules come first; the models judge what no rule fits.

Labels come from two places. What a rule decides is an example of its verdict. Of the others a URL whose host holds one of some terms is a rejected example and the rest are
accepted ones, since nearly all URLs are. The models generalise from there by spelling, and they may overrule a label: a host with a term passes if it is spelt like accepted ones, and
one without is blocked if it is spelt like rejected ones. Every fourth host, by a hash, is left out of the counts for calibration. All other URLs are counted. Statistics are exact up to 64-bit hashes and grow with the input: a distributed table holds every n-gram with its
context and its count in each class, and counts combine before the shuffle. URLs are scored in blocks of at most ``ROWS`` rows: the distinct
n-grams and contexts that a block asks for are joined with the table, and what was found comes to the block. Nothing of the models
reaches the driver.

Defined results: a null URL, or one without ``://``, has an empty host and path; an empty host and path is allowed (nothing speaks against it). With no
rejected or no accepted examples to learn from, the models allow everything. Repeated rows get the same verdict; a null page_id is
returned as it is; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U, mix, signed
from .tables import Tables, only, table

ORDER = 5
ROWS, BYTES = 2000, 1 << 17  # of the URLs of a block; a longer URL is a block of its own
BINS = 2000
TERMS = ("adult", "bets", "casino", "cheap", "pills", "poker", "porn", "spam", "track", "viagra", "xxx")
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = 2, 3


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; empty where there are none."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, shape, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _characters(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all URLs, each after ORDER start marks and before an end mark; and which of them a model predicts."""
    data = b"".join(bytes([_START]) * ORDER + u.encode() + bytes([_END]) for u in urls)
    buf = np.frombuffer(data, dtype=np.uint8)
    lengths = np.array([len(u.encode()) + ORDER + 1 for u in urls])
    begins = np.cumsum(lengths) - lengths
    own = np.ones(len(buf), dtype=bool)
    for j in range(ORDER):
        own[begins + j] = False
    return buf, own


def _grams(buf: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashes of the contexts and of the n-grams of the predicted characters."""
    at = np.flatnonzero(own)
    context = np.zeros(len(at), dtype=U)
    with np.errstate(over="ignore"):
        for order in range(ORDER + 1):
            if order:
                context = mix(context + buf[at - order].astype(U) + U(1))
            yield context, mix(context ^ (buf[at].astype(U) + U(7)) * U(0x9E3779B97F4A7C15))


def _runs(urls: list[str]) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of at most ``ROWS`` URLs and ``BYTES`` bytes, or of one longer URL."""
    begin = size = 0
    for i, url in enumerate(urls):
        own = len(url.encode())
        if i > begin and (i - begin >= ROWS or size + own > BYTES):
            yield begin, i
            begin, size = i, 0
        size += own
    if urls:
        yield begin, len(urls)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, n-gram, occurrences in accepted URLs, in rejected ones), summed over runs of URLs."""
    for batch in batches:
        every, bad = batch.column("url").to_pylist(), batch.column("rejected").to_numpy(zero_copy_only=False)
        for a, b in _runs(every):
            for label in (0, 1):
                some = [u for u, r in zip(every[a:b], bad[a:b], strict=True) if r == label]
                if not some:
                    continue
                context, gram = (np.concatenate(x) for x in zip(*_grams(*_characters(some)), strict=True))
                gram, first, n = np.unique(gram, return_index=True, return_counts=True)
                columns = [signed(context[first]), signed(gram), *((n, 0 * n) if label == 0 else (0 * n, n))]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["context", "gram", "n0", "n1"])


def statistics(grams: DataFrame) -> DataFrame:
    """key, a0, b0, a1, b1: of an n-gram its counts in both classes (a), of a context its total and the number of its kinds (b)."""
    kinds = [F.count_if(F.col(n) > 0).alias(b) for n, b in (("n0", "b0"), ("n1", "b1"))]
    contexts = grams.groupBy(F.col("context").alias("key")).agg(F.sum("n0").alias("a0"), kinds[0], F.sum("n1").alias("a1"), kinds[1])
    none = F.lit(0).cast("long")
    own = grams.select(F.col("gram").alias("key"), F.col("n0").alias("a0"), none.alias("b0"), F.col("n1").alias("a1"), none.alias("b1"))
    return own.unionByName(contexts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their block: of the task, and counted within it."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        urls = [h + p for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        for a, b in _runs(urls):
            part = batch.slice(a, b - a)
            yield pa.record_batch([*part.columns, pa.array(np.full(b - a, block), pa.int64())], names=[*part.schema.names, "block"])
            block += 1


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, hash) of the distinct n-grams and contexts of each block."""
    for batch in batches:
        urls = [h + p for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                keys = np.unique(np.concatenate([x for pair in _grams(*_characters(urls[a:b])) for x in pair]))
                yield pa.record_batch([pa.array(np.full(len(keys), block[a])), pa.array(signed(keys))], names=["block", "key"])


class Found:
    """What the table of statistics has for the n-grams and contexts of a block."""

    def __init__(self, rows: pa.Table):
        key = rows.column("key").to_numpy()
        order = np.argsort(key)
        self.keys = np.append(key[order], 0)  # the last place stands for all that is not there
        self.numbers = np.vstack([np.append(rows.column(c).to_numpy()[order], 0).astype(float) for c in ("a0", "b0", "a1", "b1")])

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        wanted, last = signed(hashes), len(self.keys) - 1
        at = np.searchsorted(self.keys[:last], wanted)
        return np.where((at < last) & (self.keys[at] == wanted), at, last)

    def scores(self, urls: list[str]) -> np.ndarray:
        """Log-likelihood under the rejected model less that under the accepted one, per character."""
        buf, own = _characters(urls)
        p = np.full((2, int(own.sum())), 1 / 256)
        for context, gram in _grams(buf, own):
            at, seen = self._places(context), self.numbers[::2, self._places(gram)]
            total, kinds = self.numbers[::2, at], self.numbers[1::2, at]
            p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1), p)
        difference = np.log(p[1]) - np.log(p[0])
        lengths = np.array([len(u.encode()) + 1 for u in urls])
        begins = np.cumsum(lengths) - lengths
        return np.add.reduceat(difference, begins) / lengths


def _score(rows: pa.Table, found: pa.Table) -> pa.Table:
    urls = [h + p for h, p in zip(rows.column("host").to_pylist(), rows.column("path").to_pylist(), strict=True)]
    scores = Found(found).scores(urls) if urls else np.zeros(0)
    return pa.table([*(rows.column(c) for c in ("page_id", "host", "path")), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "score"])


def scored(parts: DataFrame, grams: DataFrame, tables: Tables) -> DataFrame:
    """page_id, host, path, score of every row, by the counts of ``grams``."""
    blocks = tables.save(parts.mapInArrow(_blocks, "page_id long, host string, path string, block long"), "blocks")
    asked = blocks.mapInArrow(_asked, "block long, key long")
    found = asked.join(statistics(grams), "key").select("block", "a0", "b0", "a1", "b1", "key")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_score, "page_id long, host string, path string, score double")


def held_out(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(4)) == 0


def threshold(held: DataFrame) -> float:
    """Where the share of accepted examples at or above it and of rejected ones below it sum to the least; from a histogram of fixed size."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + 10) * (BINS / 20)))).cast("int")
    hist = np.zeros((2, BINS))
    for row in held.groupBy("rejected", bin_.alias("bin")).count().collect():
        hist[row["rejected"], row["bin"]] += row["count"]
    if not hist.sum(axis=1).all():
        return float("inf")
    share = hist / hist.sum(axis=1, keepdims=True)
    wrong_at = np.concatenate(([0], np.cumsum(share[1]))) + 1 - np.concatenate(([0], np.cumsum(share[0])))
    best = np.flatnonzero(wrong_at <= wrong_at.min() + 1e-12)
    return (best[0] + best[-1]) / 2 / (BINS / 20) - 10


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, terms: Sequence[str] = TERMS) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    tables = Tables(pages.sparkSession, "urls")
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    bad = F.lit(False)
    for term in terms:
        bad = bad | F.col("host").contains(term)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)

    def labelled(rows: DataFrame, held: bool) -> DataFrame:
        url = F.concat("host", "path")
        own = rows.filter((url != "") & (held_out(F.col("host")) == held))
        return own.withColumn("url", url).withColumn("rejected", F.coalesce(verdict == "block", bad).cast("int"))

    counted = labelled(parts, held=False).select("url", "rejected").mapInArrow(_count, "context long, gram long, n0 long, n1 long")
    grams = tables.save(counted.groupBy("context", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    seen = grams.agg(F.max("n0").alias("n0"), F.max("n1").alias("n1")).first()
    trained = bool(seen["n0"]) and bool(seen["n1"])
    judged = tables.save(scored(parts, grams, tables), "scores") if trained else parts.withColumn("score", F.lit(0.0))
    limit = threshold(labelled(judged, held=True).select("rejected", "score")) if trained else float("inf")
    empty = (F.col("host") == "") & (F.col("path") == "")
    own = F.when((F.col("score") >= limit) & ~empty, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(only(table(spark, sf_dir, "pages"), page_id="long", url="string"))
