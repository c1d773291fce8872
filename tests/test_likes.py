"""Likes of items with very many fans and ratings: counted without making them, made without shuffling them."""

import re

import pytest

import __spark_entry__ as entry
from marquee.operators import community

FANS, RATERS = 20_000, 20_000


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """One item with 20,000 fans, each twice, and ratings of 20,000 users, a half of them fans: 400 million likes but 10,000."""
    at = str(tmp_path_factory.mktemp("crowded"))
    clicks = spark.range(2 * FANS).selectExpr("id * 5 as event_id", "id % 20000 as user_id", "'click' as event_type")
    bought = spark.range(RATERS).selectExpr("id * 5 + 1 as event_id", "id + 10000 as user_id", "'purchase' as event_type")
    rows = clicks.union(bought).selectExpr("*", "timestamp '2024-01-20 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id) as ts", "1.0D as value", "'{\"k\": 8}' as props")
    rows.write.parquet(f"{at}/events.parquet")
    return at


def test_likes_are_counted_without_making_them(spark, crowded):
    counts = entry.queries()["a5_like_counts"](spark, crowded)
    assert counts.count() == RATERS
    assert counts.selectExpr("sum(like_count)").first()[0] == FANS * RATERS - 10_000
    unread = entry.queries()["a6_unread_counts"](spark, crowded).filter("recipient_id >= 25000")
    # of 20,000 fans those whose number 3 doesn't divide, and one to three followers or completions at most
    assert all(13_333 <= r["unread"] <= 13_336 for r in unread.filter("recipient_id < 25100").collect())


@pytest.mark.parametrize("name", ["g13_without_user_likes", "r4_social_notifications", "j8_notifications_resolved", "g12_erase_user"])
def test_likes_are_not_shuffled(spark, name):
    """Nothing is dealt anew above the join of fans and ratings."""
    plan = entry.queries()[name](spark, entry.SMALL)._jdf.queryExecution().sparkPlan().toString().split("\n")
    joins = [i for i, row in enumerate(plan) if "Join" in row and "slot#" in row.split("Inner")[0]]
    assert joins
    for i in joins:
        depth = lambda row: len(re.match(r"[ :+\-]*", row).group())
        level, above = depth(plan[i]), []
        for row in reversed(plan[:i]):
            if depth(row) < level:
                level = depth(row)
                above.append(row)
        assert not any("Aggregate" in row or "SortMergeJoin" in row or "ShuffledHash" in row or "Exchange" in row for row in above), above


def test_bundles_equal_the_likes(spark):
    fans = spark.createDataFrame([(1, "BOOK", 1, True), (2, "BOOK", 1, False), (3, "BOOK", 2, False), (None, "BOOK", 1, False), (4, "GAME", 1, None)], "user_id long, item_type string, item_id long, is_read boolean")
    ratings = spark.createDataFrame([(10, 1, "BOOK", 1), (11, 5, "BOOK", 1), (12, 3, "BOOK", 2), (13, None, "BOOK", 1), (14, 1, "GAME", 1)], "id long, user_id long, item_type string, item_id long")
    likes = community.likes_of_items(fans, ratings)
    assert sorted((r["rating_id"], r["user_id"]) for r in likes.collect()) == [(10, 2), (11, 1), (11, 2), (14, 4)]
    got = community.like_bundles(fans, ratings).collect()
    assert sorted((r["rating_id"], r["author"], r["like_count"], r["unread"]) for r in got) == [(10, 1, 1, 1), (11, 5, 2, 1), (14, 1, 1, 0)]
    assert sorted(map(tuple, community.like_counts(likes).collect())) == [(10, 1), (11, 2), (14, 1)]
