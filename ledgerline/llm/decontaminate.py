"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions alone.

An item has a window for every ``WIDTH`` consecutive words, or one window if it is shorter; equal windows are one. A window is a set of shingles of ``SHINGLE`` words (all its words if
it has fewer), each with its offset. A text contains a window only if it has all of them, so that any one will find it: the prefix of a set that must be contained whole is one shingle
long. The steps:

1. One pass over the texts hashes the shingles at every word and joins them with the distinct shingles of all windows. What is left are hits (row, place, shingle).
2. Hits are counted by shingle. Each window takes the rarest of its shingles as its prefix; a window with a shingle that never occurs is left out.
3. Hits of prefixes, moved by the shingle's offset, are candidates: a window and the word where it would begin. Candidates that begin before the text or end after it go.
4. The texts with candidates are read again, and the words at each candidate's place are compared with the window's, so that hashes decide nothing.
5. Windows found at a text's places give its hit words by a running maximum of their ends, and its items by way of the classes of equal items.

A side is broadcast only up to ``BROADCAST_ROWS`` counted rows of a few numbers; beyond that, rows are pre-selected by a bitmap and both sides are shuffled. At any place a text has at most one
window of each length, so that what belongs to a text doesn't grow beyond ``WIDTH`` rows a word, however many items share a passage; these rows stream through sorted windows.

Defined results: words are maximal runs of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z. Null and empty texts and items have no words. Rows are told apart by id and
text, so that an id may repeat; rows that repeat are each returned; a null doc_id is an id like any other. Items that repeat an id are one item with the windows of all; the words of an item
with a null id are hit, but it is not among the items. Empty tables give an empty result, or no hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sieve import parted
from .tables import BROADCAST_ROWS, Tables, only, row_keys, table

WIDTH, SHINGLE = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def shingle_hash(hashes: Column, at: Column, width: int) -> Column:
    """The hash of the shingle of ``width`` words that begins at a place (from 0), from the hashes of all words."""
    return F.xxhash64(F.lit(width), *[F.get(hashes, at + k) for k in range(width)])


def places(hashes: Column, widths: list[int]) -> Column:
    """at, hash of all shingles of these widths."""
    n = F.size(hashes)

    def of(width: int) -> Column:
        return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda at: F.struct(at.alias("at"), shingle_hash(hashes, at, width).alias("hash"))))

    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    return F.concat(none, *[F.coalesce(of(w), none) for w in widths])


def windows_of(items: DataFrame, width: int, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """class, item (a class is of items with the same words); window, class; and window, words, n, words joined by blanks. Windows with the same words have one number."""
    own = items.select(F.col("item_id").cast("string").alias("item"), word_list(F.col("text").cast("string")).alias("words")).filter(F.size("words") > 0)
    own = tables.save(own.select("item", "words", F.array_join("words", " ").alias("whole")), "items")
    classes = own.groupBy("whole").agg(F.first("words").alias("words")).select(F.monotonically_increasing_id().alias("class"), "whole", "words")
    classes = tables.save(classes, "classes")
    members = own.filter("item is not null").join(classes.select("class", "whole"), "whole").select("class", "item").distinct()
    begins = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1)))
    cut = classes.select("class", "words", begins.alias("at")).select("class", F.slice("words", F.col("at"), F.lit(width)).alias("words"))
    cut = tables.save(cut.select("class", F.array_join("words", " ").alias("joined"), "words").distinct(), "cut")
    named = cut.groupBy("joined").agg(F.first("words").alias("words")).select(F.monotonically_increasing_id().alias("window"), "joined", "words", F.size("words").alias("n"))
    named = tables.save(named, "windows")
    return tables.save(members, "members"), tables.save(cut.join(named, "joined").select("window", "class"), "owners"), named


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast up to a counted number of rows of numbers."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hits(docs: DataFrame, shingles: DataFrame, widths: list[int], tables: Tables) -> DataFrame:
    """doc_id, key, key2, n, at, hash: a row for every place of a text that has one of the shingles, and one with a null place for the text itself."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", *row_keys(), word_list(F.col("text")).alias("words"))
    own = own.select("doc_id", "key", "key2", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    itself = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("hash")))
    own = own.select("doc_id", "key", "key2", F.size("hashes").cast("long").alias("n"), F.explode(F.concat(itself, places(F.col("hashes"), widths))).alias("place"))
    own = own.select("doc_id", "key", "key2", "n", "place.at", "place.hash")
    if shingles.count() <= BROADCAST_ROWS:
        known = own.join(F.broadcast(shingles.withColumn("known", F.lit(True))), "hash", "left")
        return tables.save(known.filter("known or at is null").select("doc_id", "key", "key2", "n", "at", "hash"), "hits")
    near, _ = parted(own.filter("at is not null"), "hash", shingles, tables, "shingle-bits")
    found = near.join(shingles, "hash").select("doc_id", "key", "key2", "n", "at", "hash")
    return tables.save(found.unionByName(own.filter("at is null")), "hits")


def _candidates(hits: DataFrame, windows: DataFrame, width: int, tables: Tables) -> DataFrame:
    """key, key2, window, at, n: where a window's prefix puts it, within the text."""
    seen = hits.filter("at is not null")
    rarity = tables.save(seen.groupBy("hash").agg(F.count("*").alias("seen")), "rarity")
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    own = windows.select("window", F.col("n").alias("length"), hashes.alias("hashes"))
    sets = None
    for w in range(1, SHINGLE + 1):
        some = own.filter(F.col("length") >= w if w == SHINGLE else F.col("length") == w)
        some = some.select("window", "length", F.explode(places(F.col("hashes"), [w])).alias("place"))
        sets = some if sets is None else sets.unionByName(some)
    sets = sets.select("window", "length", F.col("place.at").alias("offset"), F.col("place.hash").alias("hash")).join(rarity, "hash", "left")
    prefix = sets.groupBy("window", "length").agg(
        F.min_by(F.struct("hash", "offset"), F.struct(F.coalesce("seen", F.lit(0)), "hash", "offset")).alias("first"), F.count("seen").alias("known"), F.count("*").alias("all")
    )
    prefix = tables.save(prefix.filter("known = all").select("window", "length", "first.hash", "first.offset"), "prefix")
    at = F.col("at") - F.col("offset")
    found = seen.join(_bounded(prefix), "hash").select("key", "key2", "window", at.alias("at"), "length", "n")
    return tables.save(found.filter("at >= 0 and at + length <= n").select("key", "key2", "window", "at", "length").distinct(), "candidates")


def _verified(docs: DataFrame, candidates: DataFrame, windows: DataFrame, tables: Tables) -> DataFrame:
    """The candidates at whose place the text has the window's words."""
    wanted = tables.save(candidates.groupBy("key", "key2").agg(F.collect_list(F.struct("window", "at", "length")).alias("places")), "wanted")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(*row_keys(), "text")
    near, _ = parted(own, "key", wanted, tables, "row-bits")
    # rows that repeat are one here
    found = near.dropDuplicates(["key", "key2"]).join(wanted, ["key", "key2"]).select("key", "key2", "places", word_list(F.col("text")).alias("words"))
    spelt = F.transform("places", lambda p: F.struct(p["window"].alias("window"), p["at"].alias("at"), p["length"].alias("length"), F.array_join(F.slice("words", p["at"] + 1, p["length"]), " ").alias("joined")))
    found = found.select("key", "key2", F.explode(spelt).alias("p")).select("key", "key2", "p.*")
    return tables.save(found.join(windows.select("window", "joined"), ["window", "joined"]).select("key", "key2", "window", "at", "length"), "found")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs`` (doc_id, text), against ``items`` (item_id, text)."""
    tables = Tables(docs.sparkSession, "decontaminate")
    members, owners, windows = windows_of(items, width, tables)
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``width``
    widths = sorted({min(SHINGLE, n) for n in lengths})
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    shingles = [windows.filter(F.least("n", F.lit(SHINGLE)) == w).select(F.explode(places(hashes, [w])).alias("place")).select("place.hash") for w in widths]
    none = docs.sparkSession.createDataFrame([], "hash long")
    for more in shingles:
        none = none.unionByName(more)
    hits = _hits(docs, tables.save(none.distinct(), "shingles"), widths, tables)
    found = _verified(docs, _candidates(hits, windows, width, tables), windows, tables)
    before = F.coalesce(F.max(F.col("at") + F.col("length")).over(Window.partitionBy("key", "key2").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("at") + F.col("length") - F.greatest("at", before))
    covered = found.select("key", "key2", fresh.cast("long").alias("fresh")).groupBy("key", "key2").agg(F.sum("fresh").alias("n_hit"))
    classes = found.select("key", "key2", "window").distinct().join(owners, "window").select("key", "key2", "class").distinct()
    named = classes.join(members, "class").groupBy("key", "key2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = covered.join(named, ["key", "key2"], "left").select("key", "key2", "n_hit", F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"), F.array_join("items", ",").alias("joined"))
    result = tables.save(result.withColumn("joined", F.coalesce("joined", F.lit(""))), "result")
    rows = hits.filter("at is null").select("doc_id", "key", "key2", F.col("n").alias("n_words"))
    rows = rows.join(_bounded(result.select("key", "key2", "n_hit", "n_items", F.sha2("joined", 256).alias("items_sha256"))), ["key", "key2"], "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return decontaminate(docs, only(table(spark, sf_dir, "benchmark"), item_id="string", text="string"))


_WORDS = f"list_filter(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {WIDTH}) AS n, array_to_string(w[s:s + {WIDTH - 1}], ' ') AS x
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
place AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d),
dw AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM place, (SELECT DISTINCT n FROM win) WHERE s + n - 1 <= len(w)),
occ AS (SELECT DISTINCT r, s, n, item FROM dw JOIN win USING (x, n)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM occ WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
