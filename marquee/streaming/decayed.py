"""Trending scores that follow a stream: decayed sums kept forwards, so that nothing is scored again as time goes on.

The state of a user is their latest gesture of each kind on each item. When it changes, and when the watermark takes a gesture out of the window
(a timer says when), what it adds to the item now and added before go out as signed rows: a completion within the window silences
the shelf, an edit counts after the event that announced the rating, a kind that is withdrawn (hidden, banned, taken off the
shelf) adds nothing.

Sums are kept with weights that grow from a landmark: a gesture at t weighs w * 2 ** ((t - landmark) / half-life) for ever, and a score at
any later time is one factor away. The landmark is the day of the gesture, so weights stay small and old days come to nothing by
themselves, as all that they held has been taken back. Each batch adds the sums of its own rows, as a folder of its number that a repeated
batch replaces; ``fold`` makes one folder of those so far.

The window ends at the watermark: after a trigger the sums are those of ``trending.activity_scores`` since the watermark less the period.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marquee.functions.columns import EDIT_WEIGHT, ITEM, event_weight, status_weight
from marquee.sources.shared import latest_fold
from marquee.streaming.ordered import DAY_MS, KEY

SHELVED = ("want", "in_progress", "dropped")
CHANGE = "change_id long, user_id long, item_type string, item_id long, kind string, ts timestamp, at timestamp, weight double, live boolean"
SIGNED = "user_id long, item_type string, item_id long, ms long, weight double, sign long"


def gesture_changes(events: DataFrame, library: DataFrame, ratings: DataFrame, users: DataFrame) -> DataFrame:
    """Tables of activity as a feed of changes of gestures (CHANGE): what is hidden or whose user is banned comes as withdrawn. change_id says
    which of two changes of a kind is the later one."""
    ok = users.select("user_id", (~F.col("is_banned")).alias("ok"))
    hidden = ratings.select(F.col("id").alias("rating_id"), "is_hidden")
    shown = events.join(hidden, "rating_id", "left").select(F.col("id").alias("change_id"), *KEY, F.col("event_type").alias("kind"), F.col("created_at").alias("ts"), event_weight(F.col("event_type")).alias("weight"), F.coalesce(~F.col("is_hidden"), F.col("rating_id").isNull()).alias("live"))
    shelf = library.filter(F.col("status").isin(*SHELVED)).select(F.col("id").alias("change_id"), *KEY, F.concat(F.lit("shelf_"), "status").alias("kind"), F.col("updated_at").alias("ts"), status_weight(F.col("status")).alias("weight"), F.lit(True).alias("live"))
    edits = ratings.filter("updated_at > created_at").select(F.col("id").alias("change_id"), *KEY, F.lit("edit").alias("kind"), F.col("updated_at").alias("ts"), F.lit(EDIT_WEIGHT).alias("weight"), (~F.col("is_hidden")).alias("live"))
    rows = shown.unionByName(shelf).unionByName(edits).join(ok, "user_id", "left")
    return rows.select("change_id", *KEY, "kind", F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("timestamp").alias("at"), "weight", (F.col("live") & F.coalesce("ok", F.lit(False))).alias("live"))


class Gestures(StatefulProcessor):
    """Of a user: state is read and written once a trigger for all items, and one timer stands for the gesture that leaves the window next."""

    def __init__(self, period_ms: int):
        self.period = period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getListState("latest", "item_type string, item_id long, kind string, ms long, weight double, live boolean, change_id long, announced long")
        self.given = handle.getListState("given", "item_type string, item_id long, kind string, ms long, weight double")

    def _wanted(self, held: dict[str, tuple], watermark: int) -> dict[str, tuple[int, float]]:
        """What counts now of an item's gestures: kind -> (time, weight)."""
        counts = {k: (v[0], v[1]) for k, v in held.items() if v[2] and v[0] >= watermark - self.period}
        if "status_completed" in counts:
            counts = {k: v for k, v in counts.items() if not k.startswith("shelf_")}
        announced = held["rating_created"][4] if "rating_created" in held else None
        if "edit" in counts and announced is not None and counts["edit"][0] <= announced:
            del counts["edit"]
        return counts

    def _known(self) -> dict[tuple, dict[str, tuple]]:
        """item -> kind -> (ms, weight, live, change_id, announced)."""
        out: dict[tuple, dict[str, tuple]] = {}
        for r in self.latest.get() if self.latest.exists() else []:
            out.setdefault(tuple(r[:2]), {})[r[2]] = tuple(r[3:])
        return out

    def _changed(self, user: int, latest: dict[tuple, dict[str, tuple]], watermark: int, fresh: bool) -> pd.DataFrame:
        before = {tuple(r[:3]): (r[3], r[4]) for r in self.given.get()} if self.given.exists() else {}
        now = {(*item, kind): v for item, held in latest.items() for kind, v in self._wanted(held, watermark).items()}
        rows = [(user, *k[:2], *v, -1) for k, v in before.items() if now.get(k) != v]
        rows += [(user, *k[:2], *v, 1) for k, v in now.items() if before.get(k) != v]
        if now and now != before:
            self.given.put([(*k, *v) for k, v in now.items()])
        elif before and not now:
            self.given.clear()
        # an item is forgotten when something of it has left the window and nothing of it counts any more
        counting = {k[:2] for k in now}
        stays = {i: held for i, held in latest.items() if fresh or i in counting or not any(v[0] < watermark - self.period for v in held.values())}
        if stays and (fresh or len(stays) < len(latest)):
            self.latest.put([(*item, kind, *v) for item, held in stays.items() for kind, v in held.items()])
        elif latest and not stays:
            self.latest.clear()
        later = [v[0] + self.period + 1 for held in stays.values() for v in held.values() if fresh or v[0] + self.period + 1 > watermark]
        if later:
            self.handle.registerTimer(min(later))
        out = pd.DataFrame(rows, columns=["user_id", *ITEM, "ms", "weight", "sign"])
        return out.astype({"user_id": "int64", "item_id": "int64", "ms": "int64", "weight": "float64", "sign": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = self._known()
        for batch in rows:
            for kind, ms, weight, live, change, item_type, item_id in batch[["kind", "ms", "weight", "live", "change_id", *ITEM]].itertuples(index=False):
                held = latest.setdefault((item_type, int(item_id)), {})
                known = held.get(kind)
                announced = max(int(ms), known[4]) if known else int(ms)
                if known is None or change > known[3]:
                    # of what counts, the latest time stays, whichever came first
                    at = max(int(ms), known[0]) if known and known[2] and live else int(ms)
                    held[kind] = (at, float(weight), bool(live), int(change), announced)
                elif known[2] and live:
                    held[kind] = (max(int(ms), known[0]), known[1], True, known[3], announced)
                else:
                    held[kind] = (*known[:4], announced)
        yield self._changed(key[0], latest, timerValues.getCurrentWatermarkInMs(), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._changed(key[0], self._known(), timerValues.getCurrentWatermarkInMs(), False)

    def close(self) -> None:
        pass


def signed_gestures(changes: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """SIGNED rows over a stream of changes of gestures (CHANGE; at is when the change was made)."""
    timed = changes.withWatermark("at", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("user_id").transformWithStateInPandas(Gestures(days * DAY_MS), SIGNED, "append", "EventTime")


def _sums(rows: DataFrame, half_life: float) -> DataFrame:
    """(item, user_id, day, sum, n) of signed rows, in the weights of their day."""
    day = F.floor(F.col("ms") / DAY_MS).cast("int")
    ahead = F.pow(F.lit(2.0), (F.col("ms") - day.cast("long") * DAY_MS) / F.lit(1000.0 * half_life))
    return rows.groupBy(*ITEM, "user_id", day.alias("day")).agg(F.sum(F.col("sign") * F.col("weight") * ahead).alias("sum"), F.sum("sign").alias("n"))


SUMS = "item_type string, item_id long, user_id long, day int, sum double, n long"


def keep_scores(changes: DataFrame, path: str, checkpoint: str, half_life: float, days: int = 7, late: str = "1 day"):
    """A stream writer that keeps the sums under path."""

    def write(batch: DataFrame, number: int) -> None:
        _sums(batch, half_life).write.mode("overwrite").parquet(f"{path}/sums/batch={number}")

    return signed_gestures(changes, days, late).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)


def kept_sums(spark: SparkSession, path: str) -> DataFrame:
    """(item, user_id, day, sum, n) so far: the last fold and the batches after it."""
    upto = latest_fold(spark, f"{path}/folds")
    rows = spark.read.schema(f"{SUMS}, batch long").parquet(f"{path}/sums").filter(F.col("batch") > (-1 if upto is None else upto)).drop("batch")
    if upto is not None:
        rows = rows.unionByName(spark.read.schema(SUMS).parquet(f"{path}/folds/fold={upto}"))
    return rows.groupBy(*ITEM, "user_id", "day").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).filter("n <> 0")


def fold(spark: SparkSession, path: str) -> int:
    """Make one folder of all batches so far; the last batch's number. Days that came to nothing are gone from it."""
    last = spark.read.schema(f"{SUMS}, batch long").parquet(f"{path}/sums").agg(F.max("batch")).first()[0]
    if last != latest_fold(spark, f"{path}/folds"):
        kept_sums(spark, path).write.mode("overwrite").parquet(f"{path}/folds/fold={last}")
    return last


def scores(spark: SparkSession, path: str, now, half_life: float) -> DataFrame:
    """(item, score, total_gestures, distinct_users of the type) as of now, as ``trending.activity_scores`` gives them."""
    rows = kept_sums(spark, path)
    age = (F.unix_micros(F.lit(now).cast("timestamp")) / F.lit(1e6) - F.col("day") * F.lit(DAY_MS / 1000)) / F.lit(half_life)
    each = rows.withColumn("score", F.col("sum") * F.pow(F.lit(0.5), age))
    totals = each.groupBy("item_type").agg(F.sum("n").alias("total_gestures"), F.countDistinct("user_id").alias("distinct_users"))
    return each.groupBy(*ITEM).agg(F.sum("score").alias("score")).join(F.broadcast(totals), "item_type")  # a row for each type
