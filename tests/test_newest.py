import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import fql
from ledgerline.plans.mapping import AS_OF, Catalog
from ledgerline.plans.registry import QUERIES

DAY = dt.date.fromisoformat(AS_OF)
TABLES = "/root/testdata/sf0.001"


def looked_for(spark, root, text, tables=TABLES, after=None):
    """The page, the plan over all rows, and the days that were looked from."""
    c, query, floors = Catalog(spark, tables), fql.parse(text), []

    def planned(floor):
        floors.append(floor)
        return fql.plan(query, c.branches(floor), DAY, after=after, floor=floor)

    page, looks = fql.newest(query, planned, c.dates(), DAY, str(root), after), list(floors)
    return page, planned(None), looks


def test_the_newest_page_needs_no_join_of_older_rows(spark):
    """Before, all line items were joined with orders, parts and customers for 50 rows."""
    page = QUERIES["fql_recent"](spark, TABLES)
    assert page.count() == 50 and not [f for f in page.inputFiles() if "lineitem" in f or "orders" in f]


@pytest.mark.parametrize("text", ["type:insider,sanction,donation", "type:trade limit:20", "type:contract,tariff agency:urgent", "-sector:econ before:1998-05-09 type:trade,insider"])
def test_pages_are_those_of_all_rows(spark, tmp_path, text):
    page, whole, floors = looked_for(spark, tmp_path, text)
    assert floors and None not in floors and page.rows.collect() == whole.rows.collect() and page.rows.schema.simpleString() == whole.rows.schema.simpleString()
    after = page.page()["meta"]["next_cursor"]
    page, whole, floors = looked_for(spark, tmp_path, text, after=after)
    assert floors and page.rows.collect() == whole.rows.collect()


@pytest.mark.parametrize("text", ["by:customer#000000007", "type:trade sort:amount limit:20", "type:trade group:month", "type:court since:2030", "type:nosuch"])
def test_other_pages_are_planned_whole(spark, tmp_path, text):
    page, whole, _ = looked_for(spark, tmp_path, text)
    assert page.rows.collect() == whole.rows.collect()


@pytest.mark.parametrize(("kept", "looks", "whole"), [("id % 100 = 0", 2, False), ("id < 40", 1, True), ("id % 3 = 0", 1, False), ("id < 2", 1, True)])
def test_rows_that_joins_lose(spark, tmp_path, kept, looks, whole):
    """What the dates promise is only where to look: lost rows are made up for by a second look or by all rows, those without a date at last."""
    rows = spark.range(3000).select(F.col("id").alias("event_id"), F.expr("CASE WHEN id > 0 THEN timestamp '2000-01-01' + make_interval(0, 0, 0, 0, id) END").alias("occurred_at"))
    query, floors = fql.parse("type:court limit:5"), []

    def planned(floor):
        floors.append(floor)
        return fql.plan(query, {"court": lambda: rows.filter(kept.replace("id", "event_id"))}, DAY, floor=floor)

    got = [r["event_id"] for r in fql.newest(query, planned, {"court": lambda: rows}, DAY, str(tmp_path)).rows.collect()]
    assert len(floors) == looks + whole and (None in floors) == whole and got == [r["event_id"] for r in planned(None).rows.collect()] and got


def test_orders_without_lines_and_lines_without_orders(spark, tmp_path):
    """The newest orders have no lines, and the newest lines no orders: neither is on a page, and neither hides another row."""
    for name in ("customer", "supplier", "part", "nation", "region", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders, lines = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("orders", "lineitem"))
    late = orders.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000).withColumn("o_orderdate", (F.lit("2005-01-01").cast("timestamp") + F.make_interval(days=F.col("o_orderkey") % 9)).cast(orders.schema["o_orderdate"].dataType))
    orders.unionByName(late).write.parquet(f"{tmp_path}/orders.parquet")
    lines.unionByName(lines.withColumn("l_orderkey", F.col("l_orderkey") + 20_000_000)).write.parquet(f"{tmp_path}/lineitem.parquet")
    page, whole, floors = looked_for(spark, tmp_path, "type:trade,contract limit:20", tmp_path)
    assert floors and floors[0] >= "2005" and page.rows.collect() == whole.rows.collect() and page.rows.count() == 20
