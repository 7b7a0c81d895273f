"""The published datasets: a registry, one fact table that feeds them all, files of bounded size, and a manifest.

A dataset is a name, a plan over the catalog, and the columns that its files are ordered by, so that a reader of one company or person opens few of them. No dataset has a file for each entity: a file has
at most ``ROWS_A_FILE`` rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ROWS_A_FILE = 100_000
MANIFEST = "dataset string, rows long, files long"


@dataclass(frozen=True)
class Dataset:
    build: Callable[[object], DataFrame]
    order: tuple[str, ...] = ()


def write(name: str, df: DataFrame, root: str, order: tuple[str, ...] = (), rows_a_file: int = ROWS_A_FILE) -> None:
    if not re.fullmatch(r"[a-z0-9-]+", name):
        raise ValueError(f"not a name of a dataset: {name}")
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).json(f"{root}/{name}")


def _files(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(where))


def publish(catalog: object, datasets: Mapping[str, Dataset], root: str, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """Writes all datasets below ``root`` and then, last, their manifest, which is returned: a reader that sees a manifest sees whole datasets. Rows are counted in what was written."""
    spark, out = catalog.spark, []
    for name, own in datasets.items():
        df = own.build(catalog)
        write(name, df, root, own.order, rows_a_file)
        rows = spark.read.schema(df.schema).json(f"{root}/{name}").count()
        out.append((name, rows, _files(spark, f"{root}/{name}")))
    manifest = spark.createDataFrame(out, MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return manifest
