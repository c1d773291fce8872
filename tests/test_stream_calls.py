"""How often the streams' processors go to the state store: once a user and trigger, not once an item."""

import pandas as pd

from marquee.functions.columns import ITEM
from marquee.streaming import decayed, ordered, upkeep


class FakeList:
    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def appendList(self, rows):
        self.calls.append("append")
        self.rows += rows

    def clear(self):
        self.calls.append("clear")
        self.rows = []


class FakeHandle:
    def __init__(self):
        self.calls = []

    def getListState(self, name, schema):
        return FakeList(self.calls)

    def registerTimer(self, at):
        self.calls.append(("timer", at))


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_completions_read_state_once_a_user():
    handle, p = FakeHandle(), ordered.Completions(1)
    p.init(handle)
    rows = pd.DataFrame([(1000 + i, i, "completed", "BOOK", i % 400) for i in range(800)], columns=["ms", "event_id", "status", *ITEM])
    list(p.handleInputRows((7,), iter([rows]), At(0)))
    first = pd.concat(p.handleExpiredTimer((7,), At(1599), None))
    then = pd.concat(p.handleExpiredTimer((7,), At(1800), None))
    assert list(first["event_id"]) == list(range(400)) and then.empty
    assert len(handle.calls) <= 14
    assert list(p.handleExpiredTimer((7,), At(2000 + ordered.DAY_MS), None))[0].empty and not p.last.exists()


def test_gestures_read_state_once_a_user():
    handle, p = FakeHandle(), decayed.Gestures(1000)
    p.init(handle)
    rows = pd.DataFrame([("shelf_want", 5000 + i, 1.0, True, i, "BOOK", i) for i in range(500)], columns=["kind", "ms", "weight", "live", "change_id", *ITEM])
    given = pd.concat(p.handleInputRows((7,), iter([rows]), At(5000)))
    assert len(given) == 500 and set(given["sign"]) == {1}
    left = pd.concat(p.handleExpiredTimer((7,), At(6100), None))
    assert len(left) == 100 and set(left["sign"]) == {-1}
    assert ("timer", 6101) in handle.calls and len(handle.calls) <= 10
    pd.concat(p.handleExpiredTimer((7,), At(10_000), None))
    assert not p.latest.exists() and not p.given.exists()


def test_fans_are_fed_once_an_item(spark):
    """A user who likes all ratings of an item is one row of the feed, however many ratings there are."""
    empty = lambda schema: spark.createDataFrame([], schema)
    fans = spark.createDataFrame([(1, "BOOK", 3), (1, "GAME", 3), (2, "BOOK", 3)], "user_id long, item_type string, item_id long")
    none = [empty("id long, user_id long, item_type string, item_id long, score double, is_hidden boolean"), empty("user_id long, item_type string, item_id long, status string"), empty("follower_id long, followed_id long")]
    rows = upkeep.table_changes(*none, fans, empty("user_id long, is_banned boolean"), 1).collect()
    assert sorted((r["user_id"], r["part"], r["row"]) for r in rows) == [(1, "like", "BOOK/3"), (1, "like", "GAME/3"), (2, "like", "BOOK/3")]
    assert upkeep.added(1, "like", ("BOOK", 3, None, None, True, False), False) == [("like", "BOOK", 3, "", 0.0)]
    assert upkeep.added(1, "like", (None, 30, None, None, True, False), False) == [("like", "", 30, "", 0.0)]
