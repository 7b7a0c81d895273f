"""All detectors as jobs of their own: one that fails or takes too long costs its own findings and nothing else.

Each detector runs in a thread of its own, its jobs under a tag, and writes its findings to a table. When its time is up the jobs of its tag are cancelled. What comes back is the findings of the detectors
that ended well, and a status for every detector.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.loads import shared_root

FINDING = "kind string, subject string, ticker string, at timestamp, rarity double, data string"
STATUS = "detector string, ok boolean, findings long, error string, seconds double"


def _one(spark: SparkSession, name: str, build: Callable[[], DataFrame], path: str, budget: float | None) -> tuple[str, bool, int, str | None, float]:
    tag, began, failed = f"detector-{uuid.uuid4().hex}", time.time(), []

    def work() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            build().select(*[c.split()[0] for c in FINDING.split(", ")]).write.parquet(path)
        except Exception as e:  # noqa: BLE001  any failure is this detector's alone
            failed.append(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300])
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(budget)
    late = thread.is_alive()
    for _ in range(60):  # a job may begin after others were cancelled
        if not thread.is_alive():
            break
        spark.sparkContext.cancelJobsWithTag(tag)
        thread.join(0.5)
    took = round(time.time() - began, 3)
    if late:
        return name, False, 0, f"stopped after {budget:g} seconds", took
    if failed:
        return name, False, 0, failed[0], took
    return name, True, spark.read.schema(FINDING).parquet(path).count(), None, took


def detect(spark: SparkSession, detectors: dict[str, Callable[[], DataFrame]], budget: float | None = 30.0, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """Findings of all detectors that ended within their budget of seconds (None: however long they took), and detector, ok, findings, error, seconds of each; ``at_once`` of them run side by side."""
    root = f"{shared_root(spark)}/findings-{uuid.uuid4().hex}"
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        runs = [pool.submit(partial(_one, spark, name, build, f"{root}/{name}", budget)) for name, build in detectors.items()]
        status = [r.result() for r in runs]
    good = [f"{root}/{name}" for name, ok, *_ in status if ok]
    findings = spark.read.schema(FINDING).parquet(*good) if good else spark.createDataFrame([], FINDING)
    return findings, spark.createDataFrame(status, STATUS)


def whole(findings: DataFrame, status: DataFrame) -> DataFrame:
    """The findings, if all detectors ended well: from findings alone nobody can tell a detector that failed from one that found nothing."""
    failed = status.filter(~F.col("ok")).orderBy("detector").collect()
    if failed:
        raise RuntimeError("findings aren't whole: " + "; ".join(f"{r['detector']}: {r['error']}" for r in failed))
    return findings


def summary(status: DataFrame) -> DataFrame:
    """detector, ok, findings: what doesn't change from run to run."""
    return status.select("detector", "ok", F.col("findings").cast("long").alias("findings"))
