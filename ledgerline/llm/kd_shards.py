"""Sharding by a k-d tree whose cuts are distributed weighted medians. [DataFrame operations only]

A row is a point in a few metadata dimensions, each coded to 0..4095: source, language, length (logarithm) and place in the id range. A cell is
cut in two at the median of its bytes along its widest dimension, until the leaves reach the target. Rows with the same code are
ordered further by a hash of the id, so a source with a third of all rows is cut as finely as any other.

A median is found by a descent through the ordering key, 12 bits at a time: a histogram of bytes (4,096 bins a cell at most, summed before the
shuffle) names the bin that holds the middle; the descent ends once that bin weighs under 1/2,000 of its cell. A window over a cell's bins finds it, so that one row a
cell reaches the driver. The table of cuts has a row for each cell and is broadcast up to ``CELLS`` of them, 24 bytes each. Slots are row numbers: they are counted in small
parts of a shard, and offsets of the parts make them gapless.

Defined results: size is the UTF-8 bytes of the text (none for null) plus 1; the checksum of a null text is that of the empty one; null
metadata is a value of its own. Rows that repeat are rows of their own: the number that each got when the sizes were written breaks ties among them, so that a third of all rows being
equal doesn't fill one shard. Rows with equal texts aren't kept together, since near-equal sizes of all shards couldn't hold then. An empty table gives an empty result;
other columns are not read. Law: ``bytes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import Tables, table

CODES = 12
KEY = 48
DIMS = ("source", "lang", "length", "place")
ROWS_A_PART = 2000
FINE = 2000
CELLS = 1 << 20
#: Bits of a tie that tell rows apart which are equal in id and text.
AGAIN = 12


def _points(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *[(F.col(c).cast("string") if c in docs.columns else F.lit("")).alias(c) for c in ("source", "lang")],
    )
    return base.withColumns(
        {
            "source": F.pmod(F.xxhash64("source"), F.lit(1 << CODES)),
            "lang": F.pmod(F.xxhash64("lang"), F.lit(1 << CODES)),
            "length": F.least(F.lit((1 << CODES) - 1), F.floor(F.log2("size") * 96)).cast("long"),
            "row": F.monotonically_increasing_id(),
        }
    )


def _tied(points: DataFrame) -> DataFrame:
    own = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 << (KEY - CODES - AGAIN)))
    return points.withColumn("tie", F.shiftleft(own, AGAIN).bitwiseOR(F.pmod(F.xxhash64("row"), F.lit(1 << AGAIN))))


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), KEY - CODES).bitwiseOR(F.col("tie"))


def _with_cells(rows: DataFrame, cells: dict[int, tuple]) -> DataFrame:
    """The rows of the named cells with their cell's ``dim`` and ``at``: a table of at most as many rows as the tree has leaves."""
    known = rows.sparkSession.createDataFrame([(c, DIMS.index(d), at) for c, (d, at) in cells.items()], "cell int, dim int, at long")
    key = F.when(F.col("dim") == 0, _key(DIMS[0]))
    for i, d in enumerate(DIMS[1:], 1):
        key = key.when(F.col("dim") == i, _key(d))
    return rows.join(F.broadcast(known) if len(cells) <= CELLS else known, "cell").withColumn("key", key)


def _medians(rows: DataFrame, wide: dict[int, str], weights: dict[int, int]) -> dict[int, tuple[str, int]]:
    """For each cell the key, in its widest dimension, below which half its bytes lie."""
    open_, prefix, below = set(wide), dict.fromkeys(wide, 0), dict.fromkeys(wide, 0)
    known: dict[int, tuple[str, int]] = {}
    for depth in range(KEY // CODES):
        if not open_:
            break
        shift = KEY - CODES * (depth + 1)
        half = rows.sparkSession.createDataFrame([(c, weights[c] / 2 - below[c]) for c in open_], "cell int, half double")
        inside = _with_cells(rows, {c: (wide[c], prefix[c]) for c in open_}).filter(F.shiftright("key", shift + CODES) == F.col("at"))
        bins = inside.groupBy("cell", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("cell").orderBy("bin"))  # 4,096 rows a cell at most
        bins = bins.withColumn("upto", upto).join(half, "cell")
        middle = F.min(F.when(F.col("upto") >= F.col("half"), F.struct("bin", "bytes", "upto")))
        last = F.max(F.struct("bin", "bytes", "upto"))
        for row in bins.groupBy("cell").agg(F.coalesce(middle, last).alias("m"), F.first("half").alias("half")).collect():
            c, (bin_, heavy, upto_), half_ = row["cell"], row["m"], row["half"]
            prefix[c], below[c] = bin_, below[c] + upto_ - heavy
            if heavy * FINE <= weights[c] or not shift:
                after = half_ - (upto_ - heavy) > heavy / 2
                known[c] = (wide[c], (bin_ + after) << shift)
        open_ -= set(known)
    return known


def kd_cells(points: DataFrame, depth: int, tables: Tables) -> DataFrame:
    """The rows with their ``cell``, 0 to 2^depth - 1; one small table is written per level."""
    rows = points.withColumn("cell", F.lit(0))
    for level in range(depth):
        spans = [x for d in DIMS for x in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"))]
        stats = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), *spans).collect()
        wide = {r["cell"]: max(DIMS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"], -DIMS.index(d))) for r in stats}
        cuts = _medians(rows, wide, {r["cell"]: r["bytes"] for r in stats})
        side = (F.col("cell") * 2 + (F.col("key") >= F.col("at")).cast("int")).alias("cell")
        rows = tables.save(_with_cells(rows, cuts).select(*points.columns, side), f"level{level}")
        if level:
            tables.drop(f"level{level - 1}")
    return rows


def kd_shards(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``shards`` is a power of two; with ``target_bytes`` instead the tree goes as deep as leaves of that size need.
    """
    tables = Tables(docs.sparkSession, "shards")
    first = tables.save(_points(docs), "sizes")
    whole = first.agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("size").alias("bytes"), F.count("*").alias("rows")
    ).first()
    lo, span = whole["lo"] or 0, (whole["hi"] or 0) - (whole["lo"] or 0) + 1
    place = F.coalesce(F.floor((F.col("doc_id") - lo) / F.lit(span) * (1 << CODES)), F.lit(0)).cast("long")
    points = _tied(first).withColumn("place", place)
    leaves = shards if target_bytes is None else max(1, -(-(whole["bytes"] or 0) // target_bytes))
    depth = max(0, (leaves - 1).bit_length())
    placed = kd_cells(points, depth if whole["rows"] else 0, tables)
    parts = max(16, -(-whole["rows"] // (ROWS_A_PART << depth)))
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(parts)).cast("int").alias("part")
    placed = tables.save(placed.select("doc_id", "size", "text_crc32", "row", F.col("cell").alias("shard"), part), "placed")
    tables.drop("sizes")
    counted = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))  # as many rows as there are parts: one per 2,000 documents
    offsets = counted.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("offset"))
    inner = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "row")
    return (
        placed.withColumn("row", F.row_number().over(inner) - 1)
        .join(offsets, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("row")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=16)
