"""Activity as streams: transitions into a status, and what followers are told."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marquee.functions.columns import ITEM
from marquee.operators.community import follower_fanout

KEY = ["user_id", *ITEM]


def completions(changes: DataFrame) -> DataFrame:
    """Of all status changes (event_id, user_id, item, ts, status) those that enter completed; every lap counts."""
    before = F.lag("status").over(Window.partitionBy(*KEY).orderBy("ts", "event_id"))
    return changes.withColumn("before", before).filter("status = 'completed' and (before is null or before <> 'completed')").drop("before")


def completion_stream(changes: DataFrame) -> DataFrame:
    """The same over a stream of changes; state is the last status of a user's entry. Changes of one entry in one trigger
    are put in order; one that arrives after a later trigger counts as it comes."""
    schema = "event_id long, user_id long, item_type string, item_id long, ts timestamp"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = rows["status"].shift(1)
        before.iloc[0] = last
        state.update((rows["status"].iloc[-1],))
        yield rows[(rows["status"] == "completed") & (before != "completed")][["event_id", "user_id", "item_type", "item_id", "ts"]]

    return changes.groupBy(*KEY).applyInPandasWithState(run, schema, "status string", "append", GroupStateTimeout.NoTimeout)


def rewritten(batch: DataFrame, path: str, number: int) -> None:
    """Write a batch to a folder of its number; a batch that is run again replaces its own rows."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def notify_followers(completed: DataFrame, follows: DataFrame, path: str, checkpoint: str):
    """A notification for each follower of who completes something, in batches as they come, each under ``batch=n``."""

    def write(batch: DataFrame, number: int) -> None:
        events = batch.withColumns({"event_type": F.lit("status_completed"), "created_at": F.col("ts")})
        rewritten(follower_fanout(events, follows), path, number)

    return completed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def rating_event_stream(changes: DataFrame) -> DataFrame:
    """(rating_id, user_id, item, created_at, retracted) over a stream of changes of ratings (rating_id, user_id, item, score,
    review_text, ts, change_id): an event when a rating first says something, its retraction when it says nothing any more."""
    schema = "rating_id long, user_id long, item_type string, item_id long, created_at timestamp, retracted boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["ts", "change_id"])
        says = rows["score"].notna() | rows["review_text"].notna()
        before = says.shift(1, fill_value=shown)
        state.update((bool(says.iloc[-1]),))
        out = rows[says != before].assign(retracted=~says[says != before]).rename(columns={"ts": "created_at"})
        yield out[["rating_id", "user_id", "item_type", "item_id", "created_at", "retracted"]]

    return changes.groupBy("rating_id").applyInPandasWithState(run, schema, "shown boolean", "append", GroupStateTimeout.NoTimeout)


def keep_trending(events: DataFrame, library: DataFrame, ratings: DataFrame, users: DataFrame, path: str, checkpoint: str, half_life: float, days: int = 7, late: str = "1 day"):
    """Scores that follow a stream of events: a repeated event id is taken once, one that is later than ``late`` is dropped.

    Each batch is a folder of the log by day, and the scores as of its latest event are worked out from the days of the
    window alone. A batch that is run again replaces its own folders."""
    from marquee.operators.trending import activity_scores

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.withColumn("day", F.to_date("created_at")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/log/batch={number}")
        schema = batch.schema.add("batch", "long").add("day", "date")
        log = session.read.schema(schema).parquet(f"{path}/log").filter(F.col("batch") <= number)
        # days are folders, so only names are read for the latest
        last = log.agg(F.max("day")).first()[0]
        if last is not None:
            recent = log.filter(F.col("day") >= F.date_sub(F.lit(last), days)).drop("batch", "day")
            now = recent.agg(F.max("created_at")).first()[0]
            since = F.lit(now) - F.expr(f"interval {days} days")
            scores = activity_scores(recent, library, ratings, users, since, F.lit(now), half_life)
            scores.withColumn("as_of", F.lit(now)).write.mode("overwrite").parquet(f"{path}/scores/batch={number}")

    once = events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
