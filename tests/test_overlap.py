"""Overlap lists of many askers over large sets of genres: exact over any parts, and only lists are shuffled."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marquee.operators import recommend


def order() -> list:
    return [F.desc_nulls_last("rating"), F.asc("item_id")]


@pytest.mark.parametrize("askers, part_items, piece", [(8192, 1 << 20, 4096), (3, 40, 7)])
def test_lists_equal_brute_force(spark, monkeypatch, askers, part_items, piece):
    for name, value in (("ASKERS", askers), ("PART_ITEMS", part_items), ("PIECE", piece)):
        monkeypatch.setattr(recommend, name, value)
    draw = random.Random(5)
    items = [(t, i, draw.choice([None, 1.5, float("nan"), *range(9)])) for t in ("BOOK", "GAME", "FILM") for i in range(120)]
    items = [(t, i, None if r is None else float(r)) for t, i, r in items]
    genres = [(t, i, g) for t, i, _ in items for g in draw.choices(["a", "b", "c", "d", "é", None], k=draw.choice([0, 1, 2, 5]))]
    wanted = [(a, t, g) for a in [*range(20), None] for t in ("BOOK", "GAME", "SONG") for g in draw.choices(["a", "b", "c", "é", "unheard of", None], k=3)]
    wanted += [(20, "BOOK", "unheard of"), (21, "GAME", None), (22, "GAME", "a")]
    taken = [(a, t, i) for a in [*range(23), None] for t, i, _ in items if draw.random() < (0.9 if a in (3, 22) else 0.1)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = recommend.overlap_lists(
        frame(wanted, "asker int, item_type string, genre string"), frame(taken, "asker int, item_type string, item_id long"), frame(genres, "item_type string, item_id long, genre string"), frame(items, "item_type string, item_id long, rating double"), order(), 6
    ).collect()

    of, asked = defaultdict(set), defaultdict(set)
    for t, i, g in genres:
        of[t, i].add(g)
    for a, t, g in wanted:
        asked[a, t].add(g)
    # what is taken by nobody is matched with nobody
    had = {(a, t, i) for a, t, i in taken if a is not None}
    best = lambda r: (2, 0) if r is None else (0, 0) if r != r else (1, -r)
    expected = set()
    for (a, t), wants in asked.items():
        rows = [(-len(wants & of[t, i] - {None}), best(r), i) for u, i, r in items if u == t and (a, t, i) not in had]
        for place, (n, _, i) in enumerate(sorted(r for r in rows if r[0])[:6], 1):
            expected.add((a, t, i, -n, place))
    assert len(got) == len(expected) and {(r["asker"], r["item_type"], r["item_id"], r["overlap"], r["place"]) for r in got} == expected


def shuffled(spark) -> int:
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_only_lists_are_shuffled(spark):
    """2,000 askers who want 48 of 60 sets of 500 items each, tables too large to broadcast: 40 items for an asker, not 40 of each set."""
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    items = spark.range(30_000).selectExpr("'BOOK' as item_type", "id as item_id", "cast(hash(id) % 1000 as double) as rating")
    genres = items.selectExpr("item_type", "item_id", "explode(array(concat('a', item_id % 10), concat('b', item_id div 10 % 6))) as genre")
    wanted = spark.range(2_000).selectExpr("id as asker", "'BOOK' as item_type", "explode(flatten(array(transform(sequence(0, 7), x -> concat('a', (x + id) % 10)), transform(sequence(0, 5), x -> concat('b', x))))) as genre")
    taken = wanted.selectExpr("asker", "item_type", "asker as item_id").distinct()
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert recommend.overlap_lists(wanted, taken, genres, items, order(), 40).count() == 80_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert shuffled(spark) - before < 10e6
