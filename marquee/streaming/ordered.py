"""Transitions in the order of event time, whatever the order of arrival.

Changes wait in the state of their group (a user, or a rating) until the watermark has passed them; a timer then puts all that are due in order, by time
and id, and says what they enter. So any order of arrival within the lateness gives what the batch operator gives over all
changes; what is later still is dropped by the watermark. The last value of a key stays for ``keep`` of event time after the
last change and is then forgotten, so the state doesn't grow for ever.

Both streams need the RocksDB state store (see ``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marquee.functions.columns import ITEM

KEY = ["user_id", *ITEM]
DAY_MS = 86_400_000


def use_state_store(spark: SparkSession) -> None:
    """State of any number of keys on disk; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Keeps changes until they are due, then calls ``entered`` for each in order with the value before it.

    columns: what a change is made of besides its group, the first being its time in ms and the second its id. A group may hold many
    keys, told apart by ``inner``: state is then read and written once a group and trigger, not once a key, and a
    group has one timer, for what is due next."""

    columns: list[str]
    schema: str
    #: Of a change's columns those that tell the keys of a group apart, with their SQL types; none where the group is the key.
    inner: list[str] = []
    inner_schema = ""
    #: Of a change's columns the one whose last value is kept, and its SQL type.
    value: str
    value_type: str

    def __init__(self, keep_days: int):
        self.keep = keep_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.last = handle.getListState("last", f"{self.inner_schema}value {self.value_type}, ts long")

    def entered(self, key: tuple, change: tuple, before) -> list[tuple]:
        raise NotImplementedError

    def made(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch[self.columns].astype(object).where(batch[self.columns].notna(), None)
            changes = [tuple(r) for r in batch.itertuples(index=False)]
            self.waiting.appendList(changes)
            self.handle.registerTimer(min(c[0] for c in changes))
        yield self.made([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, n = timerValues.getCurrentWatermarkInMs(), len(self.inner)
        at, value = [self.columns.index(c) for c in self.inner], self.columns.index(self.value)
        waiting = sorted((tuple(c) for c in self.waiting.get()) if self.waiting.exists() else [], key=lambda c: (c[0], c[1]))
        due = [c for c in waiting if c[0] <= watermark]
        rest = waiting[len(due) :]
        known = {tuple(r[:n]): (r[n], r[n + 1]) for r in self.last.get()} if self.last.exists() else {}
        out = []
        for c in due:
            name = tuple(c[i] for i in at)
            out += self.entered((*key, *name), c, known[name][0] if name in known else None)
            known[name] = (c[value], c[0])
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        awaited = {tuple(c[i] for i in at) for c in rest}
        stays = {name: v for name, v in known.items() if name in awaited or v[1] + self.keep > watermark}
        if stays and (due or len(stays) < len(known)):
            self.last.put([(*name, *v) for name, v in stays.items()])
        elif known and not stays:
            self.last.clear()
        later = [c[0] for c in rest[:1]] + [v[1] + self.keep for v in stays.values() if v[1] + self.keep > watermark]
        if later:
            self.handle.registerTimer(min(later))
        yield self.made(out)

    def close(self) -> None:
        pass


class Completions(Ordered):
    columns = ["ms", "event_id", "status", *ITEM]
    schema = "ms long, event_id long, status string, item_type string, item_id long"
    inner, inner_schema = ITEM, "item_type string, item_id long, "
    value, value_type = "status", "string"

    def entered(self, key, change, before):
        ms, event_id, status, *_ = change
        return [(event_id, *key, ms)] if status == "completed" and before != "completed" else []

    def made(self, rows):
        out = pd.DataFrame(rows, columns=["event_id", *KEY, "ms"])
        return out.astype({"event_id": "int64", "user_id": "int64", "item_id": "int64", "ms": "int64"})


class RatingEvents(Ordered):
    columns = ["ms", "change_id", "says", "user_id", "item_type", "item_id"]
    schema = "ms long, change_id long, says boolean, user_id long, item_type string, item_id long"
    value, value_type = "says", "boolean"

    def entered(self, key, change, before):
        ms, _, says, user, kind, item = change
        return [(key[0], user, kind, item, ms, not says)] if says != bool(before) else []

    def made(self, rows):
        out = pd.DataFrame(rows, columns=["rating_id", *KEY, "ms", "retracted"])
        return out.astype({"rating_id": "int64", "user_id": "int64", "item_id": "int64", "ms": "int64", "retracted": "bool"})


def _in_order(changes: DataFrame, time: str, late: str, keys: list[str], processor: Ordered, schema: str) -> DataFrame:
    timed = changes.withWatermark(time, late).withColumn("ms", F.unix_millis(time))
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


def completion_stream(changes: DataFrame, late: str = "1 day", keep_days: int = 365) -> DataFrame:
    """(event_id, user_id, item, ts) over a stream of status changes (event_id, user_id, item, ts, status): those that enter completed. A key
    that is forgotten after keep_days without a change enters completed anew."""
    out = _in_order(changes, "ts", late, ["user_id"], Completions(keep_days), "event_id long, user_id long, item_type string, item_id long, ms long")
    return out.select("event_id", *KEY, F.timestamp_millis("ms").alias("ts"))


def rating_event_stream(changes: DataFrame, late: str = "1 day", keep_days: int = 3650) -> DataFrame:
    """(rating_id, user_id, item, created_at, retracted) over a stream of changes of ratings (rating_id, user_id, item, score, review_text, ts,
    change_id): an event when a rating first says something, its retraction when it says nothing any more."""
    says = changes.withColumn("says", F.col("score").isNotNull() | F.col("review_text").isNotNull())
    out = _in_order(says, "ts", late, ["rating_id"], RatingEvents(keep_days), "rating_id long, user_id long, item_type string, item_id long, ms long, retracted boolean")
    return out.select("rating_id", *KEY, F.timestamp_millis("ms").alias("created_at"), "retracted")
