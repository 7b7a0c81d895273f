"""Mixing sources to target weights by Poisson replication. [DataFrame operations only]

Every source has a target repetition rate: its target share of the mixture, times the rows wanted, over its rows. A document is repeated a
Poisson number of times with that mean: a hash of the seed, the id and the text is a number in [0, 1), and the Poisson distribution inverted there is the count.
A rate over ``MAX_RATE`` is split into equal parts of at most ``MAX_RATE``, and the count is the sum of a draw for each, from hashes of their own: a sum of independent
Poisson numbers is one of the summed rate. So no rate is cut, and e^-rate stays a normal number. No
state is shared between rows, so a rerun task or another partitioning gives the same mixture. Each document is exploded by its
count and the copies are shuffled globally by a hash of seed, id, text and copy.

Defined results: a null source is a source of its own (the empty name); a null id draws like an empty one, so by the text; a null text counts as empty; a source without target
weight gets the rate 0; an id may repeat with other texts, which draw numbers of their own; rows that repeat both id and text draw the same number, and lie in one partition
only if their copies have the same number; extra columns are kept; an empty table gives an empty mixture. Without
``weights`` the target shares are the square roots of the sources' shares, which lifts small sources and holds back large ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables, only, spread, table

SEED = 20250601
MAX_RATE = 30.0  # of one draw
#: Rows of the mixture for which there is a task, some 70 MB of documents.
ROWS_A_TASK = 20_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 52 bits, the same in every engine."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def draw_name(docs: DataFrame) -> Column:
    """What a row draws by: its id and the MD5 of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in docs.columns else F.lit("")
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, rows_wanted: int | None = None) -> DataFrame:
    """__source, n, rate, parts, cdf: one row per source, of n rows. ``cdf`` is the distribution function of one of the ``parts`` from 0 up to where it ends."""
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.sqrt("n")
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("__source") == name, F.lit(float(weight))).otherwise(share)
    counts = counts.withColumn("share", share)
    whole = counts.agg(F.sum("n").alias("rows"), F.sum("share").alias("shares"))
    wanted = F.col("rows") if rows_wanted is None else F.lit(rows_wanted)
    rate = F.coalesce(wanted * F.col("share") / F.nullif(F.col("shares"), F.lit(0.0)), F.lit(0.0)) / F.col("n")
    steps = F.sequence(F.lit(1), F.ceil(F.col("__part") + 12 * F.sqrt("__part") + 20).cast("int"))
    start = F.struct(F.exp(-F.col("__part")).alias("p"), F.array(F.exp(-F.col("__part"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("__part") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return (
        counts.crossJoin(F.broadcast(whole))  # one row
        .withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rate") / MAX_RATE)))
        .withColumn("__part", F.col("rate") / F.col("parts"))
        .select("__source", "n", "rate", "parts", F.aggregate(steps, start, step, lambda acc: acc["cdf"]).alias("cdf"))
    )


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, rows_wanted: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixture before it is shuffled: the columns of ``docs`` plus __name, __rate, __copies and __copy (from 1)."""
    return _planned(docs, weights, rows_wanted, seed)[0]


def _planned(docs: DataFrame, weights: dict[str, float] | None, rows_wanted: int | None, seed: int) -> tuple[DataFrame, int]:
    """The mixture before it is shuffled, and how many rows it will have on average."""
    tables = Tables(docs.sparkSession, "mix")
    plan = tables.save(rates(docs, weights, rows_wanted), "rates")
    expected = plan.agg(F.sum(F.col("rate") * F.col("n")).alias("rows")).first()["rows"] or 0
    name = F.col("__name")

    def copies(draw: Column) -> Column:
        return F.size(F.filter("__cdf", lambda c: draw >= c)).cast("long")

    more = F.aggregate(
        F.sequence(F.lit(2).cast("long"), F.col("__parts")), F.lit(0).cast("long"), lambda n, k: n + copies(uniform(F.lit(str(seed)), name, k.cast("string")))
    )
    copied = (
        docs.withColumn("__name", draw_name(docs)).withColumn("__source", F.coalesce(F.col("source").cast("string"), F.lit("")))
        .join(plan.select("__source", F.col("rate").alias("__rate"), F.col("cdf").alias("__cdf"), F.col("parts").alias("__parts")), "__source")
        .withColumn("__draw", uniform(F.lit(str(seed)), name))
        .withColumn("__copies", copies(F.col("__draw")) + F.when(F.col("__parts") > 1, more).otherwise(0)).withColumn("__copies", F.col("__copies").cast("int"))
        .drop("__cdf", "__draw", "__parts", "__source")
        .filter("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    )
    return copied, int(expected)


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, rows_wanted: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixture in its global order: the columns of ``docs``, a row for each copy."""
    return _shuffled(*_planned(docs, weights, rows_wanted, seed), seed).select(*[F.col(f"`{c}`") for c in docs.columns])


def _shuffled(copies: DataFrame, rows: int, seed: int) -> DataFrame:
    """Every partition gets a random set of copies, in a random order: partition by one half of a hash, order by the other. There are as many partitions as the expected rows ask for."""
    spot = F.xxhash64(F.lit(seed), "__name", "__copy")
    tasks = spread(copies.sparkSession, rows, ROWS_A_TASK)
    return copies.withColumn("__spot", spot).repartition(tasks, "__spot").sortWithinPartitions(F.xxhash64("__spot"), "doc_id", "__copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copies, copy, rate, text of the mixture of all documents."""
    docs = only(table(spark, sf_dir, "documents"), doc_id="long", source="string", text="string")
    return _shuffled(*_planned(docs, None, None, SEED), SEED).select(
        "doc_id",
        "source",
        F.col("__copies").cast("long").alias("copies"),
        F.col("__copy").cast("long").alias("copy"),
        F.round("__rate", 6).alias("rate"),
        "text",
    )


SQL = f"""
WITH s AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT *, greatest(1, ceil(rate / {MAX_RATE}))::BIGINT AS parts FROM (SELECT s, (sum(n) OVER ())::DOUBLE * sqrt(n) / (sum(sqrt(n)) OVER ()) / n AS rate FROM s)),
q AS (SELECT *, rate / parts AS part FROM r),
k AS (SELECT s, part, k, exp(-part) * part ** k / (CASE WHEN k = 0 THEN 1.0 ELSE exp(lgamma(k + 1)) END) AS p FROM q, range(0, 240) AS t(k)),
c AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS cdf FROM k WHERE k <= ceil(part + 12 * sqrt(part) + 20)),
d AS (SELECT row_number() OVER () AS row, doc_id, source, text, rate, coalesce(source, '') AS s, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS name, unnest(range(1, parts + 1)) AS draw
      FROM documents JOIN q ON q.s = coalesce(source, '')),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || name || CASE WHEN draw = 1 THEN '' ELSE ':' || draw::VARCHAR END), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM d),
n AS (SELECT u.row, any_value(u.doc_id) AS doc_id, any_value(u.source) AS source, any_value(u.text) AS text, any_value(u.rate) AS rate, count(*) FILTER (WHERE u.u >= c.cdf) AS copies FROM u JOIN c USING (s) GROUP BY u.row)
SELECT doc_id, source, copies, unnest(range(1, copies + 1)) AS copy, round(rate, 6) AS rate, text FROM n WHERE copies > 0
"""
