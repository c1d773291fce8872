"""Plans of loads: what is shuffled and what isn't broadcast."""

from pyspark.sql import functions as F

from marquee.functions.columns import ITEM
from marquee.operators import resolve


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_slugs_meet_without_a_broadcast(spark):
    batch = spark.createDataFrame([(1, "BOOK", "S", "7", "a")], "pos long, item_type string, source string, external_id string, slug string")
    items = spark.createDataFrame([("BOOK", 7, "b", False)], "item_type string, item_id long, slug string, title_locked boolean")
    links = spark.createDataFrame([("BOOK", 7, "S", "7")], "item_type string, item_id long, source string, external_id string")
    got = resolve.align_slugs(batch.limit(1), items.limit(5), links.limit(5))
    assert "Broadcast" not in plan_of(got)
    assert got.collect() == [(1, "BOOK", 7, "a", "renamed", "a")]


def test_credits_are_counted_by_item_after_one_shuffle(spark):
    cast = spark.createDataFrame([], "item_type string, item_id long, cast array<struct<n:string,c:string,o:int>>")
    credits = spark.createDataFrame([("BOOK", 1, 5, "AUTHOR"), ("BOOK", 1, 5, "WRITER")], "item_type string, item_id long, person_id long, role string")
    batch = spark.createDataFrame([(1, "BOOK", 1, 5, "n", "WRITER", None, None), (2, "BOOK", 1, 6, "m", "WRITER", None, None)], "pos long, item_type string, item_id long, person_id long, name string, role string, character_name string, billing int")
    counted = resolve.load_credits(cast, credits, batch)[1].groupBy(*ITEM).agg(F.count("*").alias("n"))
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert counted.collect() == [("BOOK", 1, 3)]
