"""Every catalog query against its SQL in DuckDB, on the smallest tables; and all of the operators' rules on literal rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marquee.functions import columns as fn
from marquee.operators import catalog, community, dumps, incremental, recommend, resolve, similarity, trending
from marquee.plans import batch_queries, book_queries, catalog_queries, credit_queries, landed_queries, lane_queries  # noqa: F401
from marquee.plans.bindings import TABLES
from marquee.sources import landed
from marquee.streaming import events
from tests.conftest import TESTDATA


def canonical(df):
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) or x is pd.NaT:
            return "NULL"
        if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, (bool, np.bool_)):
            return repr(round(float(x), 6) + 0.0)
        return str(x)

    df = df[sorted(df.columns)]
    return sorted(map(str, ([cell(x) for x in row] for row in df.itertuples(index=False))))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{TESTDATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    made = catalog_queries.QUERIES[name](spark, TESTDATA)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = made.toPandas()
    want = duck.sql(catalog_queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalog_queries.QUERIES) - set(catalog_queries.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog_queries.QUERIES[name](spark, TESTDATA).count() > 0


USERS = [(1, False), (2, False), (3, True)]
EVENT = "id long, user_id long, event_type string, item_type string, item_id long, rating_id long, created_at timestamp"
SHELF = "user_id long, item_type string, item_id long, status string, updated_at timestamp"
RATING = "id long, user_id long, item_type string, item_id long, score double, review_text string, is_hidden boolean, created_at timestamp, updated_at timestamp"


def at(day, hour=0):
    return pd.Timestamp(2024, 1, day, hour).to_pydatetime()


def gestures(spark, event_rows=(), shelf_rows=(), rating_rows=()):
    tables = [spark.createDataFrame(list(r), s) for r, s in ((event_rows, EVENT), (shelf_rows, SHELF), (rating_rows, RATING))]
    users = spark.createDataFrame(USERS, "user_id long, is_banned boolean")
    return tables, users


def test_a_repeated_completion_counts_once_and_shuts_out_the_shelf(spark):
    laps = [(1, 1, "status_completed", "BOOK", 7, None, at(29)), (2, 1, "status_completed", "BOOK", 7, None, at(30))]
    (e, s, r), users = gestures(spark, laps, [(1, "BOOK", 7, "dropped", at(30))])
    rows = trending.gestures(e, s, r, users, "2024-01-25").collect()
    assert [(x["kind"], x["ts"], x["weight"]) for x in rows] == [("status_completed", at(30), 2.0)]


def test_banned_users_and_hidden_ratings_vanish(spark):
    rows = [(1, 3, "status_completed", "BOOK", 7, None, at(30)), (2, 1, "rating_created", "BOOK", 7, 50, at(30))]
    ratings = [(50, 1, "BOOK", 7, 4.0, None, True, at(30), at(31)), (51, 3, "BOOK", 7, 4.0, None, False, at(20), at(30))]
    (e, s, r), users = gestures(spark, rows, [(3, "BOOK", 7, "want", at(30))], ratings)
    assert trending.gestures(e, s, r, users, "2024-01-25").count() == 0


def test_half_life(spark):
    row = spark.range(1).select(fn.decay(F.lit("2024-01-30 00:00:00").cast("timestamp"), "2024-01-31 18:00:00", 42 * 3600).alias("w")).first()
    assert row["w"] == pytest.approx(0.5)


def test_average_rounds_half_up(spark):
    ratings = spark.createDataFrame([(i, 1, "BOOK", 7, s, None, False, at(1), at(1)) for i, s in enumerate((4.0, 4.0, 4.0, 4.5))], RATING)
    items = spark.createDataFrame([("BOOK", 7), ("BOOK", 8)], "item_type string, item_id long")
    users = spark.createDataFrame(USERS, "user_id long, is_banned boolean")
    got = {x["item_id"]: (x["average"], x["n_scores"]) for x in community.rating_aggregates(ratings, users, items).collect()}
    assert got == {7: (4.13, 4), 8: (None, 0)}


def test_median_of_pages_is_rounded_up(spark):
    rows = [("w", 1, 100, "2001", ["eng"], None, "0", -1, ["PS-1"], None), ("w", 2, 101, "in 1999", ["spa", "eng"], "978", "1", 5, [], ["813"]), ("w", 3, None, None, [], None, None, 9, ["PZ-7", "PS-1"], ["8", "813"]), ("w", 4, -5, None, None, None, None, None, None, None)]
    editions = spark.createDataFrame(rows, "work_id string, pos long, pages int, publish_date string, languages array<string>, isbn_13 string, isbn_10 string, cover long, lcc array<string>, ddc array<string>")
    got = dumps.aggregate_editions(editions, editions.select("work_id")).first()
    assert (got["pages"], got["isbn"], got["first_year"], got["cover"], got["editions"]) == (101, "0", 1999, 5, 4)
    assert (got["languages"], got["lcc"], got["ddc"]) == (["eng", "spa"], ["PS-1", "PZ-7", "PS-1"], ["813", "8", "813"])


def test_english_works_do_not_fall_through(spark):
    rows = [("a", 6, 5, 110, ["eng", "spa"]), ("b", 6, 5, 110, ["spa"]), ("c", 20, 10, 100, ["eng"]), ("d", 90, 50, None, ["eng"]), ("e", 5, 2, 100, ["spa"]), ("f", 19, 50, 900, ["eng"]), ("g", 5, 2, 99, ["spa"])]
    works = spark.createDataFrame(rows, "work_id string, readers long, editions long, pages long, languages array<string>")
    assert {r["work_id"]: r["selected_as"] for r in dumps.select_language(works).collect()} == {"b": "spa", "c": "eng", "e": "spa"}


def test_the_gate_judges_by_type(spark):
    day = "2024-01-31"
    rows = [(1, "", "Released", day), (2, " ", "Released", day), (3, "t", "Canceled", day), (4, "t", "Rumored", day), (5, "t", "Planned", day), (6, "t", None, "2023-11-02"), (7, "t", None, "2023-11-01"), (8, "t", None, "2024-07-30")]
    df = spark.createDataFrame([(*r, False, False, "p", None) for r in rows], "id int, title string, status string, release_date string, adult boolean, video boolean, poster string, overview string")
    told = lambda t: [r[0] for r in df.orderBy("id").select(incremental.release_verdict(day, t)).collect()]
    assert told("MOVIE") == ["no_title", "admitted", "status:Canceled", "status:Rumored", "admitted", "too_old", "too_old", "too_far_ahead"][:5] + ["admitted", "too_old", "too_far_ahead"]
    assert told("SERIES")[2:4] == ["admitted", "admitted"]


def test_genres_of_books(spark):
    rows = [
        (1, ["PZ-0007.00000000.R79"], [], []),
        (2, ["PZ-0004.00"], ["813.54"], []),
        (3, ["PR-6068"], ["823/.914"], []),
        (4, ["QA-76", "HD-1", "QA-9"], [], []),
        (5, ["??"], ["[Fic]", "158.1", "929"], []),
        (6, [], [], ["Military  History", "Fiction", "unheard of"]),
        (7, None, None, None),
        (8, ["BC1", "BD1", "PS1", "PS2", "BJ1"], [], []),
        (9, [], ["803"], []),
        (10, ["PS1"], ["[Fic]"], []),
        (11, ["PS1"], ["803", "821.1", "823.5"], []),
        (12, [" ps-3568"], [], []),
        (13, [], ["j823"], []),
        (14, ["BD1", "PZ 7", "BD2", "PZ-4", "PZ-8"], [], []),
        (15, ["PZ-9", "BD1"], ["92"], []),
        (16, [None, "??"], [None, "[Xyz]", "0.04"], ["cookery"]),
    ]
    works = spark.createDataFrame(rows, "id int, lcc array<string>, ddc array<string>, subjects array<string>")
    got = {r["id"]: r["genres"] for r in dumps.derive_genres(works).collect()}
    assert got == {
        1: ["fiction", "childrens-young-adult"],
        2: ["fiction"],
        3: ["fiction", "literature"],
        4: ["mathematics"],
        5: ["fiction", "self-help", "history"],
        6: ["history", "military-naval", "fiction"],
        7: [],
        8: ["literature"],
        9: ["literature"],
        10: ["literature"],
        11: ["poetry", "literature"],
        12: ["literature"],
        13: ["fiction", "literature"],
        14: ["philosophy"],
        15: ["fiction", "childrens-young-adult"],
        16: ["computing"],
    }


def test_franchise_keys(spark):
    titles = ["The Amber Tower: A Winter Tale", "Copper Road 2", "Blue Harbour IV", "Ox: The Beginning", "Plain title", "The Lantern 3", "Silent Delta – Reborn", "Green Part 3", "Part 3", "Un-spaced dash", "La Costa, part II", None, "2"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(fn.franchise_key(F.col("t"))).collect()]
    assert got == ["amber tower", "copper road", "blue harbour", None, None, "lantern", "silent delta", "green", "part", None, "costa", None, None]


def test_quota_keeps_the_order_and_penalties_compound():
    pool = pd.DataFrame(
        {
            "item_type": "BOOK",
            "item_id": 1,
            "other_type": ["BOOK"] * 5 + ["MOVIE", "GAME"],
            "other_id": range(7),
            "score": [0.9, 0.89, 0.88, 0.7, 0.6, 0.2, 0.1],
            "creators": [["7"], ["7"], ["7"], [], [], [], []],
            "franchise": [None] * 7,
        }
    )
    page = similarity.ranked_page(pool, 4, 0, 0.25)
    assert page["other_id"].tolist() == [0, 3, 1, 4]
    page = similarity.ranked_page(pool, 4, 1, 0.25)
    assert page["other_id"].tolist() == [0, 3, 1, 5] and page["place"].tolist() == [1, 2, 3, 4]
    assert similarity.ranked_page(pool, 3, 0, 0.0)["other_id"].tolist() == [0, 1, 2]


def test_quotas_are_filled_from_short_types():
    assert similarity.quotas({"MOVIE": 2, "SERIES": 50, "BOOK": 50, "GAME": 50}, 20) == {"MOVIE": 2, "SERIES": 6, "BOOK": 6, "GAME": 6}
    assert similarity.quotas({"MOVIE": 9, "SERIES": 9, "BOOK": 9, "GAME": 9}, 6) == {"MOVIE": 2, "SERIES": 2, "BOOK": 1, "GAME": 1}
    assert similarity.quotas({"MOVIE": 9, "SERIES": 9, "BOOK": 0, "GAME": 0}, 8, {"MOVIE": 7}) == {"MOVIE": 7, "SERIES": 1, "BOOK": 0, "GAME": 0}


def test_claims_of_external_ids(spark):
    batch = spark.createDataFrame([(1, "BOOK", 1, "S", "x"), (2, "BOOK", 2, "S", "x"), (3, "BOOK", 3, "S", "a"), (4, "BOOK", 3, "S", "b"), (5, "BOOK", 4, "S", "held"), (6, "BOOK", 9, "S", "held")], "pos long, item_type string, item_id long, source string, external_id string")
    links = spark.createDataFrame([("BOOK", 9, "S", "held")], "item_type string, item_id long, source string, external_id string")
    got = {r["pos"]: r["outcome"] for r in resolve.link_external_ids(batch, links).collect()}
    assert got == {1: "linked", 2: "contested", 3: "superseded", 4: "linked", 5: "taken", 6: "contested"}


def test_loading_a_batch_twice_changes_nothing(spark):
    target = spark.createDataFrame([("BOOK", 1, "old", True), ("BOOK", 2, "old", False)], "item_type string, item_id long, title string, locked boolean")
    batch = spark.createDataFrame([("BOOK", 1, 1, "new"), ("BOOK", 2, 2, "new"), ("BOOK", 2, 3, "newer"), ("BOOK", 5, 4, "five")], "item_type string, item_id long, pos long, title string")
    once = resolve.upsert(target, batch, fn.ITEM, ["title"], {"title": "locked"})
    twice = resolve.upsert(once.drop("outcome"), batch, fn.ITEM, ["title"], {"title": "locked"})
    rows = lambda df: sorted((r["item_id"], r["title"]) for r in df.collect())
    assert rows(once) == rows(twice) == [(1, "old"), (2, "newer"), (5, "five")]
    assert {r["item_id"]: r["outcome"] for r in once.collect()} == {1: "updated", 2: "updated", 5: "created"}


def test_edits_lock_and_unlock(spark):
    items = spark.createDataFrame([("BOOK", 1, "t", ["slug"])], "item_type string, item_id long, title string, locked_fields array<string>")
    edits = spark.createDataFrame([("BOOK", 1, "new", ["title"], ["slug"])], "item_type string, item_id long, title string, lock array<string>, unlock array<string>")
    got = resolve.apply_edits(items, edits, ["title"]).first()
    assert (got["title"], got["locked_fields"]) == ("new", ["title"])


def test_cursor_stops_at_a_failure_and_at_a_gap(spark):
    schema = "source string, kind string, item_type string, begin_at long, end_at long, succeeded boolean"
    batches = spark.createDataFrame([("a", "k", "BOOK", 5, 6, True), ("a", "k", "BOOK", 6, 7, False), ("a", "k", "BOOK", 7, 8, True), ("b", "k", "BOOK", 9, 10, True)], schema)
    cursors = spark.createDataFrame([("a", "k", "BOOK", 5), ("b", "k", "BOOK", 5)], "source string, kind string, item_type string, cursor long")
    assert {r["source"]: r["cursor"] for r in incremental.advance_cursors(batches, cursors).collect()} == {"a": 6, "b": 5}


def test_search_needs_every_word(spark):
    items = spark.createDataFrame([("BOOK", 1, "Red moon", "a tale", 5.0), ("BOOK", 2, "Moon", None, 9.0), ("GAME", 1, "Red-moon rising", "moon", None)], "item_type string, item_id long, title string, overview string, rating_external double")
    asked = spark.createDataFrame([(1, "moon RED"), (2, "sun"), (3, "red-moon")], "query_id long, q string")
    got = catalog.top_k_per_group(catalog.search(items, asked), ["query_id"], catalog.search_order(), 9).collect()
    assert sorted((r["query_id"], r["item_type"], r["item_id"], r["place"]) for r in got) == [(1, "BOOK", 1, 1), (1, "GAME", 1, 2), (3, "GAME", 1, 1)]


def test_bounds_that_cross_are_refused(spark):
    with pytest.raises(ValueError):
        catalog.catalog_filters(spark.range(1), internal=(4, 2))


def test_seeds_prefer_the_heavier_then_the_rating(spark):
    ratings = spark.createDataFrame([(1, "BOOK", 1, 4.0), (1, "BOOK", 2, 3.5), (1, "BOOK", 3, 5.0)], "user_id long, item_type string, item_id long, score double")
    shelf = spark.createDataFrame([(1, "BOOK", 1, "completed"), (1, "BOOK", 2, "want"), (1, "BOOK", 4, "dropped")], "user_id long, item_type string, item_id long, status string")
    got = sorted((r["item_id"], r["weight"], r["origin"]) for r in recommend.seeds(ratings, shelf).collect())
    assert got == [(1, 4.0, "rating"), (2, 3.0, "library"), (3, 5.0, "rating")]


def test_dump_files_are_read(spark, tmp_path):
    (tmp_path / "d.tsv").write_text('/type/work\t/works/OL1W\t3\t2020\t{"title": "T", "covers": [-1, 4], "description": {"value": "long"}, "authors": [{"author": {"key": "/authors/OL2A"}}, {"key": "/authors/OL2A"}, {"key": "/authors/OL3A"}]}\nshort\tline\n')
    works = landed.parse_work_records(landed.read_dump(spark, str(tmp_path / "d.tsv"))).collect()
    assert [(w["work_id"], w["title"], w["cover"], w["description"], w["author_ids"]) for w in works] == [("OL1W", "T", 4, "long", ["OL2A", "OL3A"])]
    (tmp_path / "log.tsv").write_text("/works/OL1W\t/books/OL9M\twant\t2020\n/works/OL2W\n/books/OL1M\tx\n")
    assert [r[0] for r in landed.read_reading_log(spark, str(tmp_path / "log.tsv")).collect()] == ["OL1W"]
    (tmp_path / "ids.json").write_text('{"id": 1, "original_name": "N", "adult": true}\nbroken\n{"id": 2, "original_title": "T", "popularity": 1.5}\n')
    got = sorted(map(tuple, landed.read_id_export(spark, str(tmp_path / "ids.json")).collect()))
    assert got == [(1, "N", 0.0, True, False), (2, "T", 1.5, False, False)]


def test_slugs_of_other_scripts(spark):
    titles = spark.createDataFrame([("Amélie: le film",), ("千と千尋",), (None,)], "t string")
    got = [r[0] for r in titles.select(landed.slug_of(F.col("t"), F.lit("2001-02-03").cast("date"), "TMDB", F.lit(9))).collect()]
    assert got == ["amelie-le-film-2001", "tmdb-9", "tmdb-9"]


def test_loose_dates(spark):
    texts = ["2001-02-03", "2001-02", "2001", "February 3, 2001", "sometime", None]
    got = [r[0] and str(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn.loose_date(F.col("t"))).collect()]
    assert got == ["2001-02-03", "2001-02-01", "2001-01-01", "2001-02-01", None, None]


def test_stream_of_completions_equals_the_batch(spark, tmp_path):
    schema = "event_id long, user_id long, item_type string, item_id long, ts timestamp, status string"
    rows = [(i, i % 3, "BOOK", i % 2, at(1 + i // 4, i % 4), ["want", "completed", "completed", "dropped"][(i * 7 + i // 5) % 4]) for i in range(48)]
    for n in range(3):  # in order of time, a file for each trigger
        spark.createDataFrame(rows[16 * n : 16 * n + 16], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = events.completion_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["event_id"] for r in events.completions(spark.createDataFrame(rows, schema)).collect())


def test_followers_are_told_in_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5, "BOOK", 7, at(3))], "event_id long, user_id long, item_type string, item_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    follows = spark.createDataFrame([(8, 5), (9, 5), (8, 6)], "follower_id long, followed_id long")
    done = spark.readStream.schema("event_id long, user_id long, item_type string, item_id long, ts timestamp").parquet(str(tmp_path / "in"))
    events.notify_followers(done, follows, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["recipient_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [8, 9]


def test_ties_of_neighbours_go_by_key(spark):
    rows = [(["MOVIE", "BOOK"][i % 2], i, [1.0, 0.0]) for i in range(60)] + [("GAME", 99, [0.0, 1.0]), ("GAME", 100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "item_type string, item_id long, embedding array<double>").repartition(4)
    got = similarity.knn(df.filter("item_id in (0, 99)"), df, 5).orderBy("item_id", "place").collect()
    assert [(r["other_type"], r["other_id"]) for r in got if r["item_id"] == 0] == [("BOOK", i) for i in (1, 3, 5, 7, 9)]
    assert [r["score"] for r in got if r["item_id"] == 99] == [0.0] * 5
    cross = similarity.neighbours(df.filter("item_id = 1"), df, 3, cross=4).filter("cross_place is not null").orderBy("cross_place").collect()
    assert [(r["other_type"], r["other_id"]) for r in cross] == [("MOVIE", i) for i in (0, 2, 4, 6)]


def test_best_keeps_the_first_of_equals():
    score = np.array([[1.0, 2.0, 2.0, 2.0, -np.inf], [0.0, 0.0, 0.0, 0.0, 0.0]])
    assert similarity.best(score, 2).tolist() == [[False, True, True, False, False], [True, True, False, False, False]]
    assert similarity.best(np.full((1, 3), -np.inf), 2).sum() == 0


def test_the_index_finds_nine_tenths_of_the_neighbours(spark):
    folder = TESTDATA.replace("sf0.001", "sf0.1")
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").selectExpr("'BOOK' as item_type", "vec_id as item_id", "embedding")
    asked = vectors.filter("item_id % 20 = 0")
    key = ["item_id", "other_id"]
    exact = similarity.knn(asked, vectors, 10).select(*key)
    found = similarity.ivf_neighbours(asked, vectors, 10).select(*key)
    assert exact.join(found, key).count() >= 0.9 * exact.count()


def test_persons_and_sagas_of_one_name_are_different_groups(spark):
    vectors = spark.createDataFrame([("BOOK", i, [1.0, 0.1 * i]) for i in range(4)], "item_type string, item_id long, embedding array<double>")
    items = spark.createDataFrame([("BOOK", 0, "x"), ("BOOK", 1, "300: a"), ("BOOK", 2, "y"), ("BOOK", 3, "z")], "item_type string, item_id long, title string")
    credits = spark.createDataFrame([("BOOK", 2, 300, "AUTHOR")], "item_type string, item_id long, person_id long, role string")
    got = similarity.similar(vectors.filter("item_id = 0"), vectors, items, credits).orderBy("place").collect()
    assert [r["other_id"] for r in got] == [1, 2, 3]


def test_cooccurrence_pairs_all_items_of_a_user(spark, monkeypatch):
    monkeypatch.setattr(recommend, "PAIR_BLOCK", 4)
    shelf = [(1, "BOOK", i) for i in range(30)] + [(2, "BOOK", 0), (2, "BOOK", 29)]
    df = spark.createDataFrame(shelf, "user_id long, item_type string, item_id long")
    got = recommend.cooccurrence(df, df.filter("false"), k=100).collect()
    pairs = {(r["item_id"], r["other_id"]) for r in got}
    assert pairs == {(a, b) for a in range(30) for b in range(30) if a != b}
    top = [r["other_id"] for r in got if r["item_id"] == 0 and r["place"] == 1]
    assert top == [29]


def test_lists_of_users_without_seeds_and_short_ones(spark):
    items = spark.createDataFrame([("MOVIE", i, f"t{i}", f"s{i}", float(9 - i), None) for i in range(6)], "item_type string, item_id long, title string, slug string, rating_external double, rating_internal double")
    genres = spark.createDataFrame([("MOVIE", 0, "g"), ("MOVIE", 1, "g")], "item_type string, item_id long, genre string")
    shelf = spark.createDataFrame([(1, "MOVIE", 0, "want"), (2, "MOVIE", 1, "dropped")], "user_id long, item_type string, item_id long, status string")
    none = spark.createDataFrame([], "user_id long, item_type string, item_id long, score double")
    users = spark.createDataFrame([(3,)], "user_id long")
    page = lambda asked: asked.select("item_type", "item_id", F.lit("MOVIE").alias("other_type"), F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 4, 5)))).alias("other_id")).withColumn("place", F.col("other_id").cast("int"))
    got = {}
    for r in recommend.recommendations(none, shelf, genres, items, users, page, k=3).orderBy("position").collect():
        got.setdefault(r["user_id"], []).append((r["item_id"], r["reason"]))
    assert got[1] == [(1, "Because t0 is in your library"), (4, "Because t0 is in your library"), (5, "Because t0 is in your library")]
    assert [x for x, _ in got[2]] == [0, 2, 3] and [x for x, _ in got[3]] == [0, 1, 2] and got[3][0][1] == "Popular right now"


def test_rating_events_come_and_go_in_a_stream(spark, tmp_path):
    schema = "rating_id long, user_id long, item_type string, item_id long, score double, review_text string, ts timestamp, change_id long"
    rows = [(1, 1, "BOOK", 7, None, None, at(1), 1), (1, 1, "BOOK", 7, 4.0, None, at(2), 2), (1, 1, "BOOK", 7, None, "x", at(3), 3), (2, 1, "BOOK", 8, 3.0, None, at(3), 4), (2, 1, "BOOK", 8, None, None, at(4), 5), (2, 1, "BOOK", 8, 2.0, None, at(5), 6)]
    df = spark.createDataFrame(rows, schema)
    assert sorted((r["rating_id"], r["created_at"]) for r in community.rating_events(df).collect()) == [(1, at(2)), (2, at(5))]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.rating_event_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["rating_id"], r["created_at"], r["retracted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, at(2), False), (2, at(3), False), (2, at(4), True), (2, at(5), False)]


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    for _ in range(2):
        events.rewritten(spark.range(3), str(tmp_path), 4)
    assert spark.read.parquet(str(tmp_path)).count() == 3


def test_editions_are_read(spark):
    body = '{"works": [{"key": "/works/OL1W"}, {"key": "/works/OL1W"}], "languages": [{"key": "/languages/eng"}], "number_of_pages": 12, "lc_classifications": ["", "PS1"], "isbn_10": [" ", "0x"], "covers": [-1, 3]}'
    df = spark.createDataFrame([(body,), ('{"works": [{"key": "/works/OL2W"}], "number_of_pages": -3}',)], "body string")
    got = {r["work_id"]: r for r in landed.parse_edition_records(df).collect()}
    assert (got["OL1W"]["languages"], got["OL1W"]["pages"], got["OL1W"]["lcc"], got["OL1W"]["isbn_10"], got["OL1W"]["cover"]) == (["eng"], 12, ["PS1"], "0x", 3)
    assert got["OL2W"]["pages"] is None
    only = landed.parse_edition_records(df, spark.createDataFrame([("OL2W",)], "work_id string"))
    assert [r["work_id"] for r in only.collect()] == ["OL2W"]


def test_vectors_of_another_width_are_refused(spark):
    sources = spark.createDataFrame([("BOOK", i, f"text {i}", f"h{i}") for i in range(3)], "item_type string, item_id long, text string, hash string")
    stored = spark.createDataFrame([("BOOK", 0, [1.0], "h0", "m"), ("BOOK", 1, [1.0], "old", "m"), ("GAME", 9, [1.0], "x", "m")], "item_type string, item_id long, embedding array<float>, hash string, model string")
    narrow = lambda s: similarity.hashed_vectors(s, 2)
    after, report = similarity.embedding_pass(sources, stored, "m", narrow, 2)
    assert {r["outcome"]: r["n"] for r in report.collect()} == {"embedded": 2, "unchanged": 1, "other": 1}
    assert {(r["item_type"], r["item_id"]): len(r["embedding"]) for r in after.collect()} == {("BOOK", 0): 1, ("BOOK", 1): 2, ("BOOK", 2): 2, ("GAME", 9): 1}
    after, report = similarity.embedding_pass(sources, stored, "m", narrow, 3, force=True)
    assert {r["outcome"]: r["n"] for r in report.collect()} == {"refused": 3, "other": 1} and after.count() == 3


def test_edits_that_are_refused(spark):
    edits = spark.createDataFrame([("BOOK", 1, " ", ["secret", "title"], None), ("BOOK", 2, "ok", ["title"], [])], "item_type string, item_id long, title string, lock array<string>, unlock array<string>")
    got = {r["item_id"]: r["problems"] for r in resolve.edit_problems(edits, ["title", "slug"], ["title"]).collect()}
    assert got == {1: ["not editable: secret", "blank title"], 2: []}


def test_people_of_a_batch_are_found_or_made_once(spark):
    schema = "pos long, item_type string, item_id long, source string, external_id string, slug string, name string, role string, character_name string, billing int"
    batch = spark.createDataFrame([(1, "MOVIE", 1, "T", "a", "ann", "Ann", "DIRECTOR", None, None), (2, "MOVIE", 2, "T", "a", "ann", "Ann", "WRITER", None, None), (3, "MOVIE", 1, "T", "b", "bob", "Bob", "WRITER", None, None), (4, "MOVIE", 1, "T", "c", "cy", "Cy", "ACTOR", "x", 1), (5, "MOVIE", 1, "T", None, "dd", "D", "WRITER", None, None)], schema)
    people = spark.createDataFrame([(7, "Bob", "bob")], "person_id long, name string, slug string")
    links = spark.createDataFrame([], "source string, external_id string, person_id long")
    none = spark.createDataFrame([], "item_type string, item_id long, person_id long, role string")
    empty_cast = resolve.build_cast(batch.filter("false"))
    cast, credits, known, linked, rejected = resolve.load_item_people(batch, empty_cast, none, people, links)
    assert rejected.count() == 1 and [r["item_id"] for r in cast.collect()] == [1]
    ids = {r["slug"]: r["person_id"] for r in known.collect()}
    assert set(ids) == {"ann", "bob"} and ids["bob"] == 7
    assert sorted((r["item_id"], r["person_id"], r["role"]) for r in credits.collect()) == sorted([(1, ids["ann"], "DIRECTOR"), (2, ids["ann"], "WRITER"), (1, 7, "WRITER")])
    again, _ = resolve.load_people(batch.filter("role <> 'ACTOR' and external_id is not null"), known, linked)
    assert sorted(r["slug"] for r in again.collect()) == ["ann", "bob"]


def test_lanes_decide_where_to_start(spark):
    from datetime import date

    from marquee.operators import lanes

    assert lanes.needs_baseline(None, date(2024, 1, 9), True) and lanes.needs_baseline(date(2024, 1, 1), date(2024, 1, 9), True) and not lanes.needs_baseline(date(2024, 1, 2), date(2024, 1, 9), True)
    assert lanes.dump_is_covered("2024-01", "2024-01") and not lanes.dump_is_covered("2024-02", "2024-01") and not lanes.dump_is_covered("2024-02", None)
    assert (lanes.next_edition("b", "b", "a"), lanes.next_edition("b", "c", "a")) == ("b", "a")
    rows = spark.createDataFrame([(str(i), at(i)) for i in range(1, 9)], "external_id string, ts timestamp")
    found, cursor = lanes.game_lane(rows, "ts", None, "2024-01-08 00:00:00", cold_days=3, cap=2)
    assert sorted(r[0] for r in found.collect()) == ["6", "7"] and cursor.first()["cursor"] == at(7)
    found, cursor = lanes.game_lane(rows, "ts", "2024-02-01 00:00:00", "2024-02-02")
    assert found.count() == 0 and str(cursor.first()["cursor"]) == "2024-02-01 00:00:00"


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert os.path.isdir(TESTDATA)
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_book_documents(spark):
    rows = [
        ('{"key": "/works/OL1W", "title": "Élan", "first_publish_year": 1900, "cover_i": 5, "isbn": [" ", "978"]}', '{"description": {"value": "Long"}, "first_publish_date": "May 3, 1901"}'),
        ('{"key": "/works/OL2W", "title": "Two", "first_publish_year": 1950, "cover_i": -1}', '{"description": "Plain"}'),
        ('{"key": "/works/OL3W", "title": "本"}', None),
    ]
    got = sorted(tuple(r) for r in landed.parse_book_docs(spark.createDataFrame(rows, "body string, detail string")).select("external_id", "slug", "overview", F.col("release_date").cast("string"), "isbn", F.col("poster_url").isNotNull()).collect())
    assert got == [("OL1W", "elan-1901", "Long", "1901-05-01", "978", True), ("OL2W", "two-1950", "Plain", "1950-01-01", None, False), ("OL3W", "openlibrary-OL3W", None, None, None, False)]


def test_companies_and_credits_of_a_batch(spark):
    batch = spark.createDataFrame([(1, "GAME", 1, [("A", "a", "DEVELOPER"), ("B", "b", "PUBLISHER")]), (2, "GAME", 2, [("A again", "a", "DEVELOPER")])], "pos long, item_type string, item_id long, companies array<struct<name:string,slug:string,role:string>>")
    known = spark.createDataFrame([("b", "Known B")], "slug string, name string")
    links = spark.createDataFrame([("GAME", 1, "b", "PUBLISHER")], "item_type string, item_id long, slug string, role string")
    companies, credits = resolve.company_rows(known, links, batch)
    assert sorted(map(tuple, companies.collect())) == [("a", "A"), ("b", "Known B")]
    assert sorted(map(tuple, credits.collect())) == [("GAME", 1, "a", "DEVELOPER"), ("GAME", 1, "b", "PUBLISHER"), ("GAME", 2, "a", "DEVELOPER")]

    people = spark.createDataFrame([(1, "BOOK", 1, 9, "N", "ACTOR", "c", 1), (2, "BOOK", 1, None, "M", "ACTOR", None, 2), (3, "BOOK", 1, 9, "N", "WRITER", None, None), (4, "BOOK", 1, 9, "N", "WRITER", None, None)], "pos long, item_type string, item_id long, person_id long, name string, role string, character_name string, billing int")
    old = resolve.build_cast(people.withColumn("item_id", F.lit(5).cast("long")))
    none = spark.createDataFrame([], "item_type string, item_id long, person_id long, role string")
    cast, crew, rejected = resolve.load_credits(old, none, people)
    assert sorted(r["item_id"] for r in cast.collect()) == [1, 5] and rejected.count() == 1
    assert [tuple(r) for r in crew.collect()] == [("BOOK", 1, 9, "WRITER")]


def test_trending_follows_a_stream(spark, tmp_path):
    rows = [(1, 1, "status_completed", "BOOK", 7, None, at(29)), (1, 1, "status_completed", "BOOK", 7, None, at(29)), (2, 2, "status_completed", "BOOK", 7, None, at(30))]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    (_, s, r), users = gestures(spark)
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    events.keep_trending(stream, s, r, users, str(tmp_path / "out"), str(tmp_path / "ck"), 86400.0).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "scores")).filter("batch = 0").first()
    assert (got["total_gestures"], got["distinct_users"], got["score"]) == (2, 2, pytest.approx(3.0))


def test_catalog_versions(spark, tmp_path):
    from marquee.sources import tables

    rows = spark.createDataFrame([("BOOK", 1, "t"), ("GAME", 1, "u")], "item_type string, item_id long, title string")
    tables.write_catalog(rows, str(tmp_path), 1)
    tables.write_catalog(rows.filter("item_type = 'GAME'"), str(tmp_path), 2)
    assert tables.read_catalog(spark, str(tmp_path), 1).count() == 2
    assert tables.current_version(spark, str(tmp_path)) == 2 and tables.read_catalog(spark, str(tmp_path)).count() == 1
    back = tables.read_catalog(spark, str(tmp_path), 1).filter("item_type = 'BOOK'")
    assert [r["title"] for r in back.collect()] == ["t"] and "PartitionFilters: [isnotnull(item_type" in back._jdf.queryExecution().executedPlan().toString()
