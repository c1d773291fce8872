"""Streams that keep sums, pages and feeds that keep to bounds, pruned pairs: against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM
from marquee.operators import community, pages, recommend
from marquee.streaming import decayed, ordered, upkeep

START = dt.datetime(2024, 3, 1)
HALF = 42 * 3600.0


@pytest.fixture
def state_store(spark):
    ordered.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def counted(rows, since, late_ok=None):
    """What counts of gesture changes at a time: {(user, item, kind): (ts, weight)}."""
    held = {}
    for change, user, kind_of, item, kind, ts, _, weight, live in sorted(rows):
        known = held.get((user, kind_of, item, kind))
        at = max(ts, known[0]) if known and known[2] and live else ts
        held[user, kind_of, item, kind] = (at, weight, live, max(ts, known[3]) if known else ts)
    out = {k: v for k, v in held.items() if v[2] and v[0] >= since}
    done = {k[:3] for k in out if k[3] == "status_completed"}
    out = {k: v for k, v in out.items() if not (k[3].startswith("shelf_") and k[:3] in done)}
    told = {k[:3]: v[3] for k, v in held.items() if k[3] == "rating_created"}
    return {k: v for k, v in out.items() if not (k[3] == "edit" and k[:3] in told and v[0] <= told[k[:3]])}


def test_kept_scores_equal_the_plain_ones_at_every_trigger(spark, tmp_path, state_store):
    rng = np.random.default_rng(6)
    kinds = {"rating_created": 3.0, "status_completed": 2.0, "shelf_want": 1.0, "edit": 1.0}
    rows = []
    for i in range(240):
        kind = str(rng.choice(list(kinds)))
        ts = START + dt.timedelta(hours=i)
        rows.append((i, int(rng.integers(0, 4)), "BOOK", int(rng.integers(0, 3)), kind, ts, ts, kinds[kind], bool(rng.random() < 0.85)))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(decayed.CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = decayed.keep_scores(stream, str(tmp_path / "kept"), str(tmp_path / "cp"), HALF, days=2, late="0 seconds").start()
    for n, part in enumerate(np.array_split(np.arange(240), 4)):
        mine = [rows[i] for i in rng.permutation(part)]
        spark.createDataFrame(mine, decayed.CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        now = rows[part[-1]][5]
        want = {}
        for (_, _, item, _), v in counted(rows[: part[-1] + 1], now - dt.timedelta(days=2)).items():
            want[item] = want.get(item, 0.0) + v[1] * 0.5 ** ((now - v[0]).total_seconds() / HALF)
        if n == 2:
            assert decayed.fold(spark, str(tmp_path / "kept")) == decayed.fold(spark, str(tmp_path / "kept"))
        got = {r["item_id"]: r for r in decayed.scores(spark, str(tmp_path / "kept"), now, HALF).collect()}
        assert set(got) == set(want)
        assert all(math.isclose(got[i]["score"], want[i], rel_tol=1e-9) for i in want)
        assert {r["total_gestures"] for r in got.values()} == {len(counted(rows[: part[-1] + 1], now - dt.timedelta(days=2)))}
    query.stop()


def test_aggregates_follow_inserts_edits_hides_bans_and_erasure(spark, tmp_path, state_store):
    rng = np.random.default_rng(7)
    feed, change = [], 0
    for _ in range(260):
        user, change = int(rng.integers(0, 5)), change + 1
        if rng.random() < 0.1:
            feed.append((change, user, "user", "", None, None, None, None, None, bool(rng.random() < 0.15), bool(rng.random() < 0.4)))
        elif rng.random() < 0.6:
            row = int(rng.integers(0, 6))
            score = None if rng.random() < 0.2 else float(rng.integers(2, 11)) / 2
            feed.append((change, user, "rating", f"{user}/{row}", "BOOK", row, None, score, bool(rng.random() < 0.8), bool(rng.random() < 0.2), None))
        else:
            part = str(rng.choice(["shelf", "follow", "like", "note"]))
            feed.append((change, user, part, str(rng.integers(0, 4)), None, int(rng.integers(0, 4)), str(rng.choice(["want", "completed"])), None, bool(rng.random() < 0.7), bool(rng.random() < 0.3), None))

    def plain(upto):
        rows, users = {}, {}
        for c in feed[:upto]:
            if c[2] == "user":
                users[c[1]] = (c[10], c[9])
            else:
                rows[c[1], c[2], c[3]] = c
        sums = {}
        for c in rows.values():
            banned, erased = users.get(c[1], (False, False))
            for m, kind, i, label, score in [] if erased else upkeep.added(c[1], c[2], (*c[4:9], c[9]), banned):
                s = sums.get((m, kind, i, label), (0.0, 0))
                sums[m, kind, i, label] = (s[0] + score, s[1] + 1)
        return sums

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(upkeep.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = upkeep.keep_aggregates(stream, str(tmp_path / "kept"), str(tmp_path / "cp")).start()
    for n, part in enumerate(np.array_split(np.arange(len(feed)), 3)):
        mine = [feed[i] for i in rng.permutation(part)]  # in any order within a trigger
        spark.createDataFrame(mine, upkeep.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        if n == 1:
            upkeep.fold(spark, str(tmp_path / "kept"))
        want = plain(part[-1] + 1)
        for m in ("rating", "shelf", "followers", "following", "like", "unread"):
            got = {(m, r["item_type"], r["id"], r["label"]): (r["sum"], r["n"]) for r in upkeep.kept(spark, str(tmp_path / "kept"), m).collect()}
            assert got == {k: v for k, v in want.items() if k[0] == m}
    query.stop()


def test_kept_pages(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 37).alias("v"), "id").repartition(5)
    order = [F.desc("v"), F.asc("id")]
    kept = pages.keep(rows, order, str(tmp_path / "p"), range_rows=100)
    want = [r["id"] for r in rows.orderBy(*order).collect()]
    assert kept.total() == 1000 and len(kept.counts) > 5
    for number in (1, 7, 20, 21):
        page = kept.page(number, 50)
        got = page.collect()
        assert [r["id"] for r in got] == want[(number - 1) * 50 : number * 50] and all(r["total"] == 1000 for r in got)
        if got:
            assert [r["id"] for r in kept.after(tuple(got[-1]["mark"]), 9).collect()] == want[number * 50 : number * 50 + 9]
            # a page reads its ranges only
            read = kept._from((number - 1) * 50, 50)
            assert len({r["range"] for r in read.collect()}) <= 2
            assert "PartitionFilters: [" in (plan := read._jdf.queryExecution().executedPlan().toString()) and "PartitionFilters: []" not in plan
    empty = pages.keep(rows.limit(0), order, str(tmp_path / "e"))
    assert empty.total() == 0 and empty.page(1, 5).count() == 0


@pytest.mark.parametrize("parts", [1, 1000, 10])
def test_feed_pages_equal_the_whole_feed(spark, monkeypatch, parts):
    """Whichever authors are met by broadcast."""
    monkeypatch.setattr(community, "MANY_PARTS", parts)
    rng = np.random.default_rng(8)
    users = spark.createDataFrame([(i, i == 7) for i in range(30)], "user_id long, is_banned boolean")
    events = [(i, int(rng.integers(0, 12)), "status_completed", "BOOK", i, None, START + dt.timedelta(minutes=int(rng.integers(0, 200)))) for i in range(300)]
    events += [(400 + i, 0, "rating_created", "BOOK", i, i, START + dt.timedelta(minutes=500 + i)) for i in range(3)]
    events = spark.createDataFrame(events, "id long, user_id long, event_type string, item_type string, item_id long, rating_id long, created_at timestamp")
    follows = spark.createDataFrame([(r, a) for r in range(30) for a in range(12) if a == 0 or rng.random() < 0.4], "follower_id long, followed_id long")
    ratings = spark.createDataFrame([(0, False), (1, True), (2, False)], "id long, is_hidden boolean")
    likes = spark.createDataFrame([(1, 0), (2, 0)], "user_id long, rating_id long")
    from marquee.operators.catalog import top_k_per_group

    whole = community.following_feed(events, follows, ratings, users, likes)
    columns = ["reader_id", "id", "like_count", "place"]
    want = top_k_per_group(whole, ["reader_id"], [F.desc("created_at"), F.desc("id")], 6).select(*columns)
    got = community.feed_pages(events, follows, ratings, users, likes, 6).select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("min_users", [1, 3])
def test_pruned_pairs_give_the_same_lists(spark, min_users, monkeypatch):
    rng = np.random.default_rng(9)
    cells = {(u, "BOOK", int(i)) for u in range(60) for i in rng.integers(20 * (u % 6), 20 * (u % 6) + 20, 6)}
    cells |= {(100 + u, "BOOK", int(i)) for u in range(3) for i in rng.integers(0, 120, 90)}  # heavy users, across all groups
    library = spark.createDataFrame(sorted(cells), "user_id long, item_type string, item_id long")
    made = []
    real = recommend.summed
    monkeypatch.setattr(recommend, "summed", lambda pairs, *names: made.append(pairs) or real(pairs, *names))
    want = recommend.cooccurrence(library, library.limit(0), 5, min_users)
    got = recommend.cooccurrence_pruned(library, library.limit(0), 5, min_users, light=10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    every = library.join(library.withColumnsRenamed({"item_id": "other"}), ["user_id", "item_type"]).filter("item_id < other").count()
    counted_pairs = sum(p.count() for p in made)
    # where few pairs have users enough there is no bound
    assert counted_pairs < 0.9 * every if min_users == 1 else counted_pairs <= every


def test_floor_of_activity(spark):
    library = spark.createDataFrame([(u, "BOOK", i) for u in range(4) for i in range(u)], "user_id long, item_type string, item_id long")
    assert recommend.cooccurrence_active(library, library.limit(0), users=2, items=2)
    assert not recommend.cooccurrence_active(library, library.limit(0), users=3, items=2)


def test_rows_without_an_owner_survive_an_erasure(spark):
    rows = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "id long, user_id long")
    assert sorted(r["id"] for r in community.without_user(rows, 7).collect()) == [2, 3]
