"""Trending: de-duplicated, moderated and decayed activity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.columns import EDIT_WEIGHT, ITEM, TYPES, at, decay, event_weight, status_weight, type_order
from marquee.operators.catalog import canonical_order, top_k_per_group

HALF_LIFE = {1: 6 * 3600.0, 7: 42 * 3600.0}
MIN_GESTURES, MIN_USERS = 5, 3


def not_banned(rows: DataFrame, users: DataFrame) -> DataFrame:
    return rows.join(users.filter("not is_banned").select("user_id"), "user_id", "left_semi")


def gestures(events: DataFrame, library: DataFrame, ratings: DataFrame, users: DataFrame, since) -> DataFrame:
    """(user_id, item, kind, ts, weight): the three disjoint contributions to activity.

    Events count once for a user, item and kind, at the latest time; library entries only without the user's own
    completion in the window; ratings only as edits after the event that announced them."""
    recent = events.filter(at(F.col("created_at")) >= at(since))
    shown = ratings.filter("not is_hidden").select(F.col("id").alias("rating_id"))
    seen = recent.filter("rating_id is null").unionByName(recent.join(shown, "rating_id", "left_semi").select(*recent.columns))
    collapsed = not_banned(seen, users).groupBy("user_id", *ITEM, F.col("event_type").alias("kind")).agg(F.max("created_at").alias("ts"))
    by_event = collapsed.withColumn("weight", event_weight(F.col("kind")))

    done = recent.filter("event_type = 'status_completed'").select("user_id", *ITEM)
    shelved = library.filter(F.col("status").isin("want", "in_progress", "dropped") & (at(F.col("updated_at")) >= at(since)))
    by_shelf = not_banned(shelved.join(done, ["user_id", *ITEM], "left_anti"), users).select(
        "user_id", *ITEM, F.concat(F.lit("shelf_"), "status").alias("kind"), F.col("updated_at").alias("ts"), status_weight(F.col("status")).alias("weight")
    )

    announced = events.filter("rating_id is not null").groupBy(F.col("rating_id").alias("id")).agg(F.max("created_at").alias("announced_at"))
    edited = ratings.filter(~F.col("is_hidden") & (F.col("updated_at") > F.col("created_at")) & (at(F.col("updated_at")) >= at(since)))
    edited = edited.join(announced, "id", "left").filter("announced_at is null or updated_at > announced_at")
    by_edit = not_banned(edited, users).select("user_id", *ITEM, F.lit("edit").alias("kind"), F.col("updated_at").alias("ts"), F.lit(EDIT_WEIGHT).alias("weight"))
    return by_event.unionByName(by_shelf).unionByName(by_edit)


def activity_scores(events, library, ratings, users, since, now, half_life: float) -> DataFrame:
    """(item, score, total_gestures, distinct_users of the type) for every item with activity since then.

    Gestures are summed for each user and item first; scores and the types' totals both come from these sums."""
    rows = gestures(events, library, ratings, users, since)
    sums = rows.groupBy(*ITEM, "user_id").agg(F.sum(F.col("weight") * decay(F.col("ts"), now, half_life)).alias("score"), F.count("*").alias("n"))
    totals = sums.groupBy("item_type").agg(F.sum("n").alias("total_gestures"), F.countDistinct("user_id").alias("distinct_users"))
    scores = sums.groupBy(*ITEM).agg(F.sum("score").alias("score"))
    # one row for each type
    return scores.join(F.broadcast(totals), "item_type")


def fallback(items: DataFrame, today: Column, days: int, limit: int = 20) -> DataFrame:
    """(item, slug, place): per type the best of what was released in the days before today, or of all items where nothing was.

    Each type is sorted by itself with a limit, so that a task keeps no more rows than that."""
    fresh = F.coalesce((F.col("release_date") <= today) & (F.col("release_date") >= F.date_sub(today, days)), F.lit(False))
    kept = [items.filter((F.col("item_type") == t) & only).orderBy(*canonical_order()).limit(limit).withColumn("fresh", F.lit(flag)) for t in TYPES for only, flag in ((fresh, True), (F.lit(True), False))]
    both = reduce(DataFrame.unionByName, kept)
    any_fresh = F.max("fresh").over(Window.partitionBy("item_type"))  # twice the limit for each type
    return top_k_per_group(both.withColumn("any_fresh", any_fresh).filter("fresh = any_fresh"), ["item_type"], canonical_order(), limit, "place").select(*ITEM, "slug", "place")


def trending(events, library, ratings, users, items, now, period: int = 7, limit: int = 20) -> DataFrame:
    """(item_type, item_id, slug, place, origin): per type the most active items, or the fallback where activity is
    too thin or none of its items exists. Items that don't exist are dropped after the limit."""
    since = at(now) - F.expr(f"interval {period} days")
    active = activity_scores(events, library, ratings, users, since, now, HALF_LIFE[period]).filter((F.col("total_gestures") >= MIN_GESTURES) & (F.col("distinct_users") >= MIN_USERS))
    # rounded, so that the last bits of a sum don't decide between equals
    ranked = top_k_per_group(active.withColumn("s", F.round("score", 6)), ["item_type"], [F.desc("s"), F.asc("item_id")], limit, "place")
    live = ranked.join(items.select(*ITEM, "slug"), ITEM).select(*ITEM, "slug", "place", F.lit("activity").alias("origin"))
    instead = fallback(items, F.to_date(at(now)), {1: 90, 7: 365}[period], limit).withColumn("origin", F.lit("fallback"))
    first = F.min("origin").over(Window.partitionBy("item_type"))  # activity before fallback; twice the limit for each type
    out = live.unionByName(instead).withColumn("first", first).filter("origin = first").drop("first")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("item_type").orderBy("place")))


def mixed_trending(per_type: DataFrame, each: int = 5) -> DataFrame:
    """The types' best interleaved: first all first places in the fixed order of types, then all second ones."""
    order = Window.orderBy("place", type_order(F.col("item_type")))  # at most each rows of every type
    return per_type.filter(F.col("place") <= each).withColumn("position", F.row_number().over(order))
