"""Streams that follow event time: any arrival within the lateness equals the batch."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM
from marquee.streaming import events, ordered

START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def state_store(spark):
    ordered.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, rows, schema, batches, stream, tmp_path, name):
    """The rows of a stream over files that hold the given batches of row numbers, one trigger each, then one that moves the watermark on."""
    path = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    for n, batch in enumerate(batches):
        spark.createDataFrame([rows[i] for i in batch], schema).coalesce(1).write.mode("append").parquet(path)
        if n == 0:
            query = stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
    query.stop()
    return spark.table(name)


def shuffled(n, late_rows, seed):
    """Batches of numbers in time's order, each displaced by late_rows at most."""
    rng = np.random.default_rng(seed)
    order = np.argsort(np.arange(n) + rng.uniform(0, late_rows, n), kind="stable")
    return np.array_split(order, 4)


def test_completions_in_any_order_of_arrival(spark, tmp_path):
    rng = np.random.default_rng(4)
    schema = "event_id long, user_id long, item_type string, item_id long, ts timestamp, status string"
    rows = [(i, int(rng.integers(0, 4)), "BOOK", int(rng.integers(0, 2)), START + dt.timedelta(minutes=10 * (i // 2)), str(rng.choice(["want", "completed", "completed", "dropped"]))) for i in range(160)]
    want = {tuple(r) for r in events.completions(spark.createDataFrame(rows, schema)).select("event_id", "user_id", *ITEM, "ts").collect()}
    end = [(10**6, 99, "BOOK", 0, START + dt.timedelta(days=30), "want")]
    batches = [*(b.tolist() for b in shuffled(160, 12, 1)), [160]]
    got = run(spark, rows + end, schema, batches, lambda s: ordered.completion_stream(s, "3 hours"), tmp_path, "completed_in_order")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_rating_events_in_any_order_of_arrival(spark, tmp_path):
    rng = np.random.default_rng(5)
    schema = "rating_id long, user_id long, item_type string, item_id long, score double, review_text string, ts timestamp, change_id long"
    rows = []
    for i in range(120):
        r = int(rng.integers(0, 6))
        rows.append((r, r % 3, "GAME", r, None if rng.random() < 0.5 else 3.0, None if rng.random() < 0.7 else "x", START + dt.timedelta(minutes=10 * i), i))
    want, shown = [], {}
    for r, user, kind, item, score, text, ts, _ in rows:
        says = score is not None or text is not None
        if says != shown.get(r, False):
            want.append((r, user, kind, item, ts, not says))
        shown[r] = says
    end = [(99, 99, "GAME", 0, 1.0, None, START + dt.timedelta(days=30), 10**6)]
    batches = [*(b.tolist() for b in shuffled(120, 12, 2)), [120]]
    got = run(spark, rows + end, schema, batches, lambda s: ordered.rating_event_stream(s, "3 hours"), tmp_path, "rated_in_order")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_key_is_forgotten_after_its_time(spark, tmp_path):
    schema = "event_id long, user_id long, item_type string, item_id long, ts timestamp, status string"
    rows = [(n, 1, "BOOK", 1, START + dt.timedelta(days=d), "completed") for n, d in enumerate([0, 1, 40])] + [(9, 2, "BOOK", 1, START + dt.timedelta(days=20), "want"), (10, 2, "BOOK", 1, START + dt.timedelta(days=60), "want")]
    got = run(spark, rows, schema, [[0], [1], [3], [2], [4]], lambda s: ordered.completion_stream(s, "1 hour", keep_days=10), tmp_path, "forgotten")
    assert sorted(r["event_id"] for r in got.collect()) == [0, 2]
