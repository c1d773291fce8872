"""Seeding from dumps whose works have very many editions."""

from pyspark.sql import functions as F

from marquee.operators import dumps, seeding
from marquee.sources import versioned

EDITION = "work_id string, pos long, pages int, publish_date string, languages array<string>, isbn_13 string, isbn_10 string, cover long, lcc array<string>, ddc array<string>"


def many_editions(spark, n=600):
    """Work w: PS and QA by turns, first QA, PS more often; each edition has a second number. Work v has none."""
    rows = [("w", i, 200, "2001", ["eng"], None, "0", 1, ["QA-1" if i % 3 == 0 else "PS-2", "??"], ["158.1"] if i % 2 else ["[Fic]", "823.1"]) for i in range(n)]
    return spark.createDataFrame([*rows, *(("v", i, 200, "2001", ["eng"], None, "0", 1, None, []) for i in range(30))], EDITION)


def test_call_numbers_grow_with_what_differs(spark):
    editions = many_editions(spark)
    works = editions.select("work_id").distinct().withColumn("subjects", F.array(F.lit("Fiction")))
    told = dumps.with_call_numbers(works, editions)
    got = {r["work_id"]: r for r in told.collect()}
    assert (got["w"]["lcc"], got["w"]["lcc_counts"], got["w"]["ddc"]) == (["QA-1", "??", "PS-2"], [200, 600, 400], ["[Fic]", "823.1", "158.1"])
    assert (got["v"]["lcc"], got["v"]["lcc_counts"], got["v"]["ddc"]) == ([], [], [])
    whole = dumps.aggregate_editions(editions, works).join(works, "work_id")
    genres = lambda df: {r["work_id"]: r["genres"] for r in dumps.derive_genres(df).collect()}
    assert genres(told) == genres(whole) and genres(told)["v"] == ["fiction"]


def seeded(spark, editions):
    log = spark.createDataFrame([("w",)] * 30 + [("v",)] * 30, "work_id string")
    works = spark.createDataFrame([("w", "Book", ["Fiction"], None, None, ["A1"]), ("v", "Other", ["Fiction"], 3, None, ["A1", "A2"])], "work_id string, title string, subjects array<string>, cover long, description string, author_ids array<string>")
    return dumps.seed_books(log, editions, works, spark.createDataFrame([("A1", "Ann"), ("A2", "Bo")], "author_id string, name string"))


def reads_only(df) -> bool:
    return not any(x in df._jdf.queryExecution().optimizedPlan().toString() for x in ("Aggregate", "Generate"))


def test_editions_are_gone_through_once(spark):
    """Books and batches are used several times downstream; they are read, not worked out again."""
    books, credits = seeded(spark, many_editions(spark))
    assert reads_only(books) and books.count() == 2
    assert {(r["work_id"], r["author_id"], r["billing"]) for r in credits.collect()} == {("w", "A1", 0), ("v", "A1", 0), ("v", "A2", 1)}


def test_batches_are_worked_out_once(spark, tmp_path):
    books, authors = seeded(spark, many_editions(spark, 60))
    empty = lambda schema: spark.createDataFrame([], schema)
    items = spark.createDataFrame([("BOOK", 1, "Old", "old", None, None)], "item_type string, item_id long, title string, slug string, overview string, release_date date")
    table = versioned.create(items, str(tmp_path / "catalog"), ["item_type", "item_id"])
    done = seeding.seed_catalog(table, books, authors, empty("item_type string, item_id long, source string, external_id string"), empty("person_id long, name string, slug string"), empty("source string, external_id string, person_id long"), empty("item_type string, item_id long, person_id long, role string"))
    assert "xxhash64" not in done.links._jdf.queryExecution().optimizedPlan().toString()  # the new ids are read
    assert (table.read().count(), done.people.count(), done.credits.count()) == (3, 2, 3)
