"""Kept indexes and versioned tables: updates, crashes, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM
from marquee.operators import catalog, similarity, vector_index, word_index
from marquee.sources import versioned

TYPES = ["MOVIE", "SERIES", "BOOK", "GAME"]


def vectors_of(spark, n=1500, dim=12):
    """Vectors around 30 points, 6 % of them games."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(30, dim))
    rows = []
    for i in range(n):
        kind = "GAME" if i % 17 == 0 else TYPES[i % 3]
        rows.append((kind, i, [float(x) for x in points[i % 30] + 0.4 * rng.normal(size=dim)]))
    return spark.createDataFrame(rows, "item_type string, item_id long, embedding array<float>")


def keys(df):
    return sorted(map(tuple, df.select(*ITEM, "other_type", "other_id", "score").collect()))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    vectors = vectors_of(spark).cache()
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    later = F.col("item_id") % 4 == 1
    wrong = vectors.filter(later & (F.col("item_id") % 8 == 1)).withColumn("embedding", F.reverse("embedding"))
    extra = vectors.filter("item_id % 50 = 7").withColumn("item_id", F.col("item_id") + 10_000)
    vector_index.build(vectors.filter(~later).unionByName(wrong).unionByName(extra), path, lists=16)
    index = vector_index.opened(spark, path)
    index.add(vectors.filter(later))
    index.remove(extra)
    return vectors, index


def test_index_over_all_lists_is_exact_after_changes(kept):
    vectors, index = kept
    asked = vectors.filter("item_id % 20 = 0")
    assert keys(index.search(asked, 15, exact=True)) == keys(similarity.knn(asked, vectors, 15))
    got, want = index.search(asked, 8, cross=6, exact=True), similarity.neighbours(asked, vectors, 8, cross=6)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_index_finds_nine_tenths_of_each_type_and_fills_the_page(kept):
    vectors, index = kept
    asked = vectors.filter("item_id % 20 = 0")
    for t in TYPES:
        true = similarity.knn(asked, vectors.filter(F.col("item_type") == t), 10)
        found = index.search(asked, 10, types=(t,))
        r = vector_index.recall_by_type(found, true).collect()
        assert len(r) == 1 and r[0]["hits"] >= 0.9 * r[0]["n"], t
        assert found.groupBy(*ITEM).count().filter("count <> 10").isEmpty()
    cross = index.search(asked, 10, cross=10).filter("item_type <> other_type and cross_place is not null")
    assert cross.groupBy(*ITEM).count().filter("count <> 10").isEmpty()


def test_a_filtered_search_reads_few_lists(kept):
    vectors, index = kept
    probed = index.probed(vectors.filter("item_id % 20 = 0"), 10, None, 0, False)
    assert probed.count() < 0.7 * 16 * vectors.filter("item_id % 20 = 0").count()


def test_a_segment_that_was_not_finished_does_not_exist(kept, spark):
    vectors, index = kept
    asked = vectors.filter("item_id = 40")
    before = keys(index.search(asked, 5))
    index.placed(vectors.withColumn("item_id", F.col("item_id") + 50_000)).limit(0).select("list", "part", *ITEM).write.parquet(f"{index.path}/gone/segment=9")
    assert index.segments() == [0, 1, 2] and keys(index.search(asked, 5)) == before


def test_pages_from_the_index(kept, spark):
    vectors, index = kept
    items = vectors.select(*ITEM, F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("title"))
    credits = spark.createDataFrame([], "item_type string, item_id long, person_id long, role string")
    asked = vectors.filter("item_id % 100 = 0")
    exact = similarity.similar(asked, vectors, items, credits)
    found = similarity.similar(asked, vectors, items, credits, pool=lambda a, n, quota: index.search(a, n, cross=n, exact=True))
    assert keys(found) == keys(exact)


def test_odd_vectors_are_left_out(spark):
    rows = [("BOOK", i, [1.0, float(i), 2.0]) for i in range(5)]
    odd = [("BOOK", 10, [1.0, 2.0]), ("BOOK", 11, [float("nan"), 1.0, 1.0]), ("BOOK", 12, None), ("BOOK", 13, [None, 1.0, 1.0]), ("BOOK", 14, [0.0, 0.0, 0.0])]
    schema = "item_type string, item_id long, embedding array<double>"
    vectors = spark.createDataFrame(rows + odd, schema)
    found = similarity.knn(vectors, vectors, 10)
    assert {r["item_id"] for r in found.collect()} == {r["other_id"] for r in found.collect()} == set(range(5))
    assert similarity.knn(spark.createDataFrame([], schema), spark.createDataFrame([], schema), 3).count() == 0


ITEM_COLUMNS = "item_type string, item_id long, title string, overview string, rating_external double"


def titles(spark, n=900):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["the"] * 20
    rows = [(TYPES[i % 4], i, " ".join(words[int(x)] for x in rng.integers(0, 80, 5)), None if i % 3 else "the Sub-Text", None if i % 11 == 0 else float(i * 37 % 50) / 5) for i in range(n)]
    return spark.createDataFrame([*rows, ("BOOK", 5000, None, None, 1.0), ("BOOK", 5001, "", "", 1.0)], ITEM_COLUMNS)


@pytest.fixture(scope="module")
def word_kept(spark, tmp_path_factory):
    items = titles(spark).cache()
    changed = F.col("item_id") % 6 == 1
    extra = items.filter("item_id % 9 = 2").withColumn("item_id", F.col("item_id") + 10_000)
    path = str(tmp_path_factory.mktemp("words") / "index")
    word_index.build(items.filter(~changed).unionByName(items.filter(changed).withColumn("title", F.lit("the w1 w2 w3"))).unionByName(extra), path)
    index = word_index.opened(spark, path)
    index.update(items.filter(changed), removed=extra)
    return items, index


def test_word_index_answers_like_the_search(word_kept, spark):
    items, index = word_kept
    asked = [(i, f"w{i} the") for i in range(20)] + [(20, "the"), (21, "the w1 w2"), (22, "sub-text"), (23, "nowhere the"), (24, ""), (25, None), (26, "w5 W5 w6"), (27, "sub")]
    queries = spark.createDataFrame(asked, "query_id int, q string")
    want = catalog.top_k_per_group(catalog.search(items, queries), ["query_id"], catalog.search_order(), 7)
    columns = ["query_id", *ITEM, "rating_external", F.round("rank", 6), "place"]
    got = index.search(queries, 7)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(map(tuple, want.select(*columns).collect()), key=repr)
    assert index.search(queries.filter("query_id = 24")).count() == 0


def test_a_search_reads_the_buckets_of_its_words_only(word_kept, spark):
    _, index = word_kept
    read = index.asked_postings(spark.createDataFrame([("w7",)], "word string"))
    files = {f.rsplit("/", 2)[-2] for f in (r[0] for r in read.select(F.input_file_name()).distinct().collect())}
    assert len(files) == 1 and "In(word" in read._jdf.queryExecution().toString().replace("EqualTo(word", "In(word")
    assert {r["word"] for r in read.collect()} == {"w7"}


def test_a_word_segment_that_was_not_finished_does_not_exist(word_kept, spark):
    items, index = word_kept
    queries = spark.createDataFrame([(1, "the w1")], "query_id int, q string")
    before = sorted(map(tuple, index.search(queries).collect()))
    items.select(*ITEM).write.parquet(f"{index.path}/gone/segment=5")
    assert sorted(map(tuple, index.search(queries).collect())) == before


def test_versions_switch_at_once(spark, tmp_path):
    rows = spark.createDataFrame([("BOOK", i, f"t{i}", i % 7 == 0) for i in range(200)], "item_type string, item_id long, title string, title_locked boolean")
    versioned.create(rows, str(tmp_path / "t"), ITEM, buckets=4)
    table = versioned.opened(spark, str(tmp_path / "t"))
    batch = spark.createDataFrame([("BOOK", i, p, f"n{p}") for p, i in enumerate([3, 7, 3, 500])], "item_type string, item_id long, pos long, title string")
    version, outcomes = table.upsert(batch, ["title"], {"title": "title_locked"})
    assert version == 1 and sorted((r["item_id"], r["outcome"]) for r in outcomes.collect()) == [(3, "updated"), (7, "updated"), (500, "created")]
    now = {r["item_id"]: r["title"] for r in table.read().collect()}
    assert now[3] == "n2" and now[7] == "t7" and now[500] == "n3" and len(now) == 201
    assert {r["item_id"]: r["title"] for r in table.read(0).collect()} == {i: f"t{i}" for i in range(200)}

    # a run that dies between writing and switching leaves the table as it was, and its files are written over
    table.stage(table.read().filter("item_id < 50").withColumn("title", F.lit("lost")))
    assert table.current() == 1 and {r["item_id"]: r["title"] for r in table.read().collect()} == now
    table.delete(spark.createDataFrame([("BOOK", 3), ("BOOK", 9999)], "item_type string, item_id long"))
    after = {k: t for k, t in now.items() if k != 3}
    assert {r["item_id"]: r["title"] for r in table.read().collect()} == after
    with pytest.raises(Exception, match="(?i)exist"):
        table._switch(2, 0, [])
    assert table.compact() == 3
    assert {r["item_id"]: r["title"] for r in versioned.opened(spark, table.path).read().collect()} == after
    assert {r["item_id"] for r in table.lookup(batch).collect()} == {7, 500}
    with pytest.raises(Exception, match="null key"):
        table.stage(rows.limit(1).withColumn("item_type", F.lit(None).cast("string")))


def test_the_base_is_never_shuffled(spark, tmp_path):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "BOOK").otherwise("GAME").alias("item_type"), F.col("id").alias("item_id"), F.concat(F.lit("t"), "id").alias("title"))
    table = versioned.create(rows, str(tmp_path / "t"), ITEM, buckets=8)
    table.commit(table.stage(table.read().filter("item_id % 3 = 0").withColumn("title", F.lit("x"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (table.read(), table.lookup(rows.filter("item_id % 5 = 0"))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            scans = [n for n, line in enumerate(plan.split("\n")) if "Scan" in line and versioned._name(f"{table.path}/base-0") in line]
            assert scans, plan
            for n in scans:  # between the base's scan and its join there is no exchange
                depth = len(plan.split("\n")[n]) - len(plan.split("\n")[n].lstrip(" :+-"))
                above = []
                for line in reversed(plan.split("\n")[:n]):
                    d = len(line) - len(line.lstrip(" :+-"))
                    if d < depth:
                        above.append(line)
                        depth = d
                    if "Join" in line and d <= depth:
                        break
                assert any("Join" in x for x in above) and not any("Exchange" in x for x in above), "\n".join(above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
