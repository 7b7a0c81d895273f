"""Phrase collocations by pivot partitioning.

Every n-gram belongs to its rarest word, its pivot; of a word that is there twice, to the first place. Texts are read twice.

1. Words are counted by language. A word's id is a hash of language and word; should any two words share an id, the count is repeated with another seed, so that ids are exact.
2. Words have a common order: the ``COMMON`` most frequent ones by frequency (8 bytes each, sent to all tasks), rarer ones by id. Any order gives right results; this one keeps frequent words from
   being pivots. At every place of a text a fragment is cut: the word as pivot and up to three words on either side, as far as they belong to the same piece, are frequent, and come before the pivot
   in the order. Everything else is blank. Equal fragments of a task are one with a weight. Fragments are routed to their pivot's part. A pivot with more than
   ``SALT`` occurrences is spread over several parts.
3. Each part mines locally: it counts the n-grams of its fragments that have the pivot in them, and emits those that are frequent (of a pivot in several parts all, which are
   then added up). Parts are read one after another, so that a task holds one at a time.
4. Scores, subsumption and ranks are joins of the frequent n-grams with themselves. All parts of a frequent n-gram are frequent, so that nothing else is needed.

The number of parts follows the number of words. Ids whose words are frequent but beyond ``COMMON`` are told from infrequent ones by a bitmap; what it lets pass wrongly is counted and dropped.

Defined results: A-Z are lower-cased; null texts are empty; a null lang is ``und`` (and joined with a lang of that name). Pieces lie between ``.,;:!?`` and 0x0A to 0x0D, words between 0x20 and 0x09.
Rows that repeat count each time; ids and other columns are not read. Scores are exact: they are computed in decimals of 38 digits. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import U, mix, release, slices, span_hashes
from .sieve import passes, sieve
from .tables import Tables, only, spread, table

LONGEST, LEAST, TOP, COVER = 4, 30, 2000, 80
COMMON = 1 << 19
SIDE = LONGEST - 1
SLICE, BLOCK = 1 << 19, 1 << 19
#: Fragments that a task gathers before it combines and emits them.
GATHER = 250_000
#: Occurrences of frequent words for which there is a part.
WORDS_A_PART = 400_000
#: Occurrences of a pivot for which it has a part.
SALT = 1_000_000
#: Added to ids of words beyond the common ones, which makes them come after all ranks.
BEYOND = 1 << 62

_GAP = np.zeros(256, dtype=bool)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP[:] = _BREAK
_GAP[[0x20, 0x09]] = True


class Tokens:
    """The words of a slice: bytes, spans, which text each is of, and whether a piece begins with it."""

    def __init__(self, buf: np.ndarray, begins: np.ndarray, follows: bool):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_GAP[buf], [False])).view(np.int8)))
        self.buf, self.start, self.end = buf, edge[0::2], edge[1::2]
        self.text = np.searchsorted(begins, self.start, side="right") - 1
        breaks = np.cumsum(np.concatenate(([0 if follows else 1], _BREAK[buf])))
        self.fresh = np.diff(breaks[self.start], prepend=0) > 0
        self.open = bool(len(self.start)) and breaks[-1] == breaks[self.start[-1]] or not len(self.start) and follows and breaks[-1] == 0

    def ids(self, salts: np.ndarray) -> np.ndarray:
        """61 bits for a word of a language."""
        return (mix(span_hashes(self.buf, self.start, self.end) ^ salts[self.text]) >> U(3)).astype(np.int64)

    def spelt(self, at: np.ndarray) -> pa.Array:
        start, n = self.start[at], (self.end - self.start)[at]
        offsets = np.concatenate(([0], np.cumsum(n)))
        inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
        data = self.buf[np.repeat(start, n) + inside]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def tokens(texts: list[bytes]) -> Iterator[Tokens]:
    """The words of some texts, in blocks that end between words; a text never goes on after another."""
    data = b"\n".join(texts).lower()
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    buf, at, follows = np.frombuffer(data, dtype=np.uint8), 0, False
    while at < len(buf):
        to = min(len(buf), at + BLOCK)
        while to < len(buf) and not _GAP[buf[to]]:
            to += 1
        found = Tokens(buf[at:to], begins - at, follows)
        yield found
        at, follows = to, found.open


def _salts(langs: list[str], seed: int) -> np.ndarray:
    buf = np.frombuffer(b"".join(x.encode() for x in langs), dtype=np.uint8)
    ends = np.cumsum([len(x.encode()) for x in langs])
    return mix(span_hashes(buf, np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64)) + U(seed))


def _langs(part: pa.RecordBatch) -> list[str]:
    return part.column("lang").to_pylist()


def _counted(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", SLICE):
            langs = _langs(part)
            salts = _salts(langs, seed)
            for found in tokens(texts):
                ids, first, n = np.unique(found.ids(salts), return_index=True, return_counts=True)
                own = pa.array(langs, pa.string()).take(pa.array(found.text[first]))
                yield pa.record_batch([pa.array(ids), own, found.spelt(first), pa.array(n)], names=["id", "lang", "word", "n"])

    return run


def count_words(docs: DataFrame, tables: Tables, seeds: Iterator[int] | None = None) -> tuple[DataFrame, int]:
    """id, lang, word, n of all words, and the seed of their ids."""
    for seed in seeds or count(1):
        found = docs.mapInArrow(_counted(seed), "id long, lang string, word string, n long")
        words = tables.save(found.groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), f"words-{seed}")
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed
        tables.drop(f"words-{seed}")


class Order:
    """Codes of words in the common order: ranks of common words, then ids; -1 for infrequent ones."""

    def __init__(self, common: np.ndarray, rest: np.ndarray | None):
        self.common, self.rest = common, rest
        at = np.argsort(common)
        self.sorted, self.ranks = common[at], at

    def codes(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), -1, dtype=np.int64)
        if len(self.sorted):
            at = np.searchsorted(self.sorted, ids)
            at[at == len(self.sorted)] = 0
            hit = self.sorted[at] == ids
            out[hit] = self.ranks[at[hit]]
        if self.rest is not None:
            other = np.flatnonzero(out < 0)
            other = other[passes(self.rest, ids[other])]
            out[other] = ids[other] + BEYOND
        return out

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """The ids of codes; of blanks -1."""
        out = np.where(codes >= BEYOND, codes - BEYOND, -1)
        known = (codes >= 0) & (codes < BEYOND)
        out[known] = self.common[codes[known]]
        return out


def fragments(codes: np.ndarray, fresh: np.ndarray, begin: int, end: int) -> np.ndarray:
    """A row for every word from ``begin`` to ``end`` that is the pivot of an n-gram: the three words before it, itself, and the three after it; -1 is blank."""
    lo, hi = max(0, begin - SIDE), min(len(codes), end + SIDE)
    codes, fresh, n = codes[lo:hi], fresh[lo:hi], hi - lo
    out = np.full((n, 2 * SIDE + 1), -1, dtype=np.int64)
    out[:, SIDE] = codes
    frequent = codes >= 0
    left = right = frequent
    for k in range(1, LONGEST):
        if n > k:
            # a word before the pivot comes before it in the order; one after it may be the pivot again
            left = left.copy()
            left[:k] = False
            left[k:] &= ~fresh[1 : n - k + 1] & frequent[:-k] & (codes[:-k] < codes[k:])
            out[left, SIDE - k] = codes[np.flatnonzero(left) - k]
            right = right.copy()
            right[n - k :] = False
            right[: n - k] &= ~fresh[k:] & frequent[k:] & (codes[k:] <= codes[: n - k])
            out[right, SIDE + k] = codes[np.flatnonzero(right) + k]
    some = frequent & ((out[:, SIDE - 1] >= 0) | (out[:, SIDE + 1] >= 0))
    some[: begin - lo] = some[end - lo :] = False
    return out[some]


def _combined(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal fragments as one, with the sum of their weights."""
    if not len(rows):
        return rows, weights
    key = _prints(rows)
    order = np.argsort(key, kind="stable")
    rows, weights, key = rows[order], weights[order], key[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[first], np.add.reduceat(weights, first)


def _prints(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.zeros(len(rows), dtype=U)
        for column in rows.T:
            key = (key + column.astype(U)) * U(0x9E3779B97F4A7C15)
            key ^= key >> U(29)
    return mix(key)


def _routed(sent, seed: int, parts: int):
    """Packed fragments: a row for each part that has any, with columns one after another."""

    def emit(held: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows, weights = _combined(rows, np.ones(len(rows), dtype=np.int64))
        pivot = rows[:, SIDE]
        salts = np.ones(len(pivot), dtype=np.int64)
        common = pivot < BEYOND
        salts[common] = -(-counts[pivot[common]] // SALT)
        salt = (_prints(rows) >> U(20)).astype(np.int64) % salts
        part = (mix(pivot.astype(U) + (salt.astype(U) << U(40))) % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rows, weights, part = rows[order], weights[order], part[order]
        cuts = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]))
        data = [np.ascontiguousarray(np.concatenate((rows[a:b].T, weights[None, a:b]))).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.record_batch([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(data, pa.binary())], names=["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts, rest = sent.value
        order = Order(common, rest)
        held, size = [], 0
        for part, texts in slices(batches, "text", SLICE):
            salts = _salts(_langs(part), seed)
            codes, fresh = [], []
            for found in tokens(texts):
                codes.append(order.codes(found.ids(salts)))
                fresh.append(found.fresh)
            if not codes:
                continue
            codes, fresh = np.concatenate(codes), np.concatenate(fresh)
            for at in range(0, len(codes), BLOCK):  # with the neighbours of a block's first and last words
                own = fragments(codes, fresh, at, min(len(codes), at + BLOCK))
                held.append(own)
                size += len(own)
                if size > GATHER:
                    yield emit(held, counts)
                    held, size = [], 0
        if size:
            yield emit(held, counts)
        held.clear()
        release()

    return run


def mined(rows: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams that have their pivot in a fragment, as rows of ``LONGEST`` codes (-1 after the last), and how often each is there."""
    names, local = np.unique(rows, return_inverse=True)
    local = local.reshape(rows.shape).astype(U)
    for n in range(2, LONGEST + 1):
        keys, w = [], []
        for before in range(n):
            a, b = SIDE - before, SIDE - before + n
            if a < 0 or b > 2 * SIDE + 1:
                continue
            full = (rows[:, a:b] >= 0).all(axis=1)
            keys.append(local[full, a:b])
            w.append(weights[full])
        grams, w = np.concatenate(keys), np.concatenate(w)
        if not len(grams):
            continue
        key = grams[:, 0]
        for k in range(1, n):  # a number for each prefix, then for each prefix and word
            key = np.unique((key << U(32)) | grams[:, k], return_inverse=True)[1].astype(U)
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order].astype(np.int64), prepend=-1))
        out = np.full((len(first), LONGEST), -1, dtype=np.int64)
        out[:, :n] = names[grams[order[first]].astype(np.int64)]
        yield out, np.add.reduceat(w[order], first)


def _mine(sent, least: int):
    """The n-grams of each part: of pivots with one part those that are frequent, of others all; as ids."""

    def grams(data: list[bytes], order: Order, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        packed = [np.frombuffer(x, dtype=np.int64).reshape(2 * SIDE + 2, -1) for x in data]
        packed = np.concatenate(packed, axis=1)
        rows, weights = _combined(np.ascontiguousarray(packed[:-1].T), packed[-1])
        for found, n in mined(rows, weights):
            pivot = found.max(axis=1)
            split = np.zeros(len(n), dtype=bool)
            common = pivot < BEYOND
            split[common] = counts[pivot[common]] > SALT
            keep = split | (n >= least)
            columns = [*order.ids(found[keep].T.ravel()).reshape(LONGEST, -1), n[keep]]
            yield pa.record_batch([pa.array(c) for c in columns], names=[*(f"w{k}" for k in range(LONGEST)), "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts, _ = sent.value
        order = Order(common, None)
        held, own = [], None
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if part != own and held:
                    yield from grams(held, order, counts)
                    held = []
                own = part
                held.append(data.as_py())
        if held:
            yield from grams(held, order, counts)
        release()

    return run


def frequent_grams(docs: DataFrame, least: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """gram (an array of word ids), n of the n-grams of 2 to ``LONGEST`` words; and id, lang, word, n of all words."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words, seed = count_words(docs, tables)
    often = words.filter(F.col("n") >= least)
    size = often.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    common = often.select("id", "n").orderBy(F.desc("n"), "id").limit(COMMON).toArrow().sort_by([("n", "descending"), ("id", "ascending")])
    rest = sieve(often, "id") if size["words"] > COMMON else None
    sent = spark.sparkContext.broadcast((common.column("id").to_numpy().astype(np.int64), common.column("n").to_numpy().astype(np.int64), rest))
    parts = max(64, -(-size["n"] // WORDS_A_PART))
    routed = docs.mapInArrow(_routed(sent, seed, parts), "part int, data binary").repartition(spread(spark, parts, 4), "part").sortWithinPartitions("part")
    ids = [f"w{k}" for k in range(LONGEST)]
    found = routed.mapInArrow(_mine(sent, least), ", ".join(f"{c} long" for c in [*ids, "n"]))
    found = found.groupBy(*ids).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return tables.save(found.select(F.filter(F.array(*ids), lambda x: x >= 0).alias("gram"), "n"), "grams"), words


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def score(a: Column, both: Column) -> Column:
    """floor(2000000 a / both), without overflow."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(8,0)") * _exact(a), _exact(both)).cast("long")


def _cuts(grams: DataFrame, known: DataFrame) -> DataFrame:
    """gram, a, l, r, score of the cut with the lowest score."""

    def sides(k: Column) -> Column:
        right = F.slice("gram", k + 1, F.size("gram") - k)
        return F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), F.slice("gram", F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), right.alias("part")))

    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size("gram") - 1), sides))
    asked = grams.select("gram", F.col("n").alias("a"), F.explode(every).alias("x")).select("gram", "a", "x.k", "x.side", "x.part")
    found = asked.join(known.select(F.col("gram").alias("part"), F.col("n").alias("f")), "part")
    at = [(k, side) for k in range(1, LONGEST) for side in (0, 1)]
    wide = found.groupBy("gram", "a").agg(*[F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"f{k}{side}") for k, side in at])
    cuts = []
    for k in range(1, LONGEST):
        left, right = F.col(f"f{k}0"), F.col(f"f{k}1")
        cuts.append(F.when(left.isNotNull(), F.struct(score(F.col("a"), _exact(left) + right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    best = F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull()))
    return wide.select("gram", "a", best.alias("best")).select("gram", "a", "best.l", "best.r", "best.score")


def _covered(grams: DataFrame) -> DataFrame:
    """gram, cover: the most occurrences of a longer phrase that has the phrase inside."""
    n = F.size("gram")
    sizes = F.sequence(F.lit(2), n - 1)
    inside = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda s: F.slice("gram", s, m))))
    return grams.filter(n > 2).select(F.explode(F.array_distinct(inside)).alias("gram"), "n").groupBy("gram").agg(F.max("n").alias("cover"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases of 2 to 4 words; ``docs``: lang, text."""
    tables = Tables(docs.sparkSession, "collocations")
    grams, words = frequent_grams(docs, least, tables)
    often = tables.save(words.filter(F.col("n") >= least), "often")
    known = grams.unionByName(often.select(F.array("id").alias("gram"), "n"))
    left = _cuts(grams, known).join(_covered(grams), "gram", "left").filter(F.coalesce(100 * _exact(F.col("cover")) < cover * _exact(F.col("a")), F.lit(True)))
    left = left.withColumn("id", F.col("gram")[0]).join(often.select("id", "lang"), "id").drop("id", "cover")
    # ties included, so that spelling decides below
    first = left.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top).drop("place")
    first = tables.save(first, "first")
    for k in range(LONGEST):
        first = first.withColumn("id", F.get("gram", F.lit(k))).join(often.select("id", F.col("word").alias(f"w{k}")), "id", "left").drop("id")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    named = first.withColumn("phrase", F.concat_ws(" ", *[f"w{k}" for k in range(LONGEST)])).join(total, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return named.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(only(table(spark, sf_dir, "documents"), lang="string", text="string"))


SQL = f"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM
             (SELECT coalesce(lang, 'und') AS lang,
                     unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
u AS (SELECT lang, r, unnest(w) AS x, unnest(range(len(w))) AS place FROM (SELECT lang, w, row_number() OVER () AS r FROM p WHERE len(w) > 0)),
z AS (SELECT lang, x, lead(x, 1) OVER q AS x1, lead(x, 2) OVER q AS x2, lead(x, 3) OVER q AS x3 FROM u WINDOW q AS (PARTITION BY r ORDER BY place)),
g AS (SELECT lang, 1 AS k, x AS phrase FROM z UNION ALL SELECT lang, 2, x || ' ' || x1 FROM z WHERE x1 IS NOT NULL
      UNION ALL SELECT lang, 3, x || ' ' || x1 || ' ' || x2 FROM z WHERE x2 IS NOT NULL UNION ALL SELECT lang, 4, x || ' ' || x1 || ' ' || x2 || ' ' || x3 FROM z WHERE x3 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, j, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
        FROM c JOIN range(1, {LONGEST}) AS t(j) ON j < c.k
        JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS cover
        FROM c JOIN range(2, {LONGEST}) AS t(m) ON m < k JOIN range(1, {LONGEST}) AS u(s) ON s + m - 1 <= k GROUP BY 1, 2),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best LEFT JOIN sub USING (lang, phrase) JOIN n USING (lang) WHERE cover IS NULL OR 100::HUGEINT * cover < {COVER}::HUGEINT * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
