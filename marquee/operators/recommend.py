"""Recommendations for all users at once: seeds, genre overlap, authorship, adaptations, co-occurrence."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marquee.functions.columns import ITEM, TYPES, type_order
from marquee.operators.catalog import canonical_order, interleave, top_k_per_group
from marquee.sources.shared import kept

MIN_SEED_SCORE = 4.0
AUTHORS = ("AUTHOR", "SOURCE_AUTHOR")


def seeds(ratings: DataFrame, library: DataFrame) -> DataFrame:
    """(user_id, item, weight, origin): what a user rated 4 or better (weight: the score), completed (4) or wants (3);
    once for an item, the heaviest, a rating before a library entry."""
    rated = ratings.filter(F.col("score") >= MIN_SEED_SCORE).select("user_id", *ITEM, F.col("score").alias("weight"), F.lit("rating").alias("origin"))
    shelf = F.when(F.col("status") == "completed", 4.0).when(F.col("status") == "want", 3.0)
    shelved = library.select("user_id", *ITEM, shelf.alias("weight"), F.lit("library").alias("origin")).filter("weight is not null")
    order = [F.desc("weight"), F.when(F.col("origin") == "rating", 0).otherwise(1)]
    return top_k_per_group(rated.unionByName(shelved), ["user_id", *ITEM], order, 1, "rn").drop("rn")


def seen_items(ratings: DataFrame, library: DataFrame) -> DataFrame:
    return ratings.select("user_id", *ITEM).union(library.select("user_id", *ITEM)).distinct()


#: Askers of one type that look through a part of the items together, and items of a part.
ASKERS, PART_ITEMS, PIECE = 8192, 1 << 20, 4096


def overlap_lists(wanted: DataFrame, taken: DataFrame, item_genres: DataFrame, items: DataFrame, order: list[Column], k: int = 20) -> DataFrame:
    """(asker, item, the columns of items, overlap, place): per asker and type the k items with most of the wanted genres
    (asker, item_type, genre) that aren't among the taken ones (asker, item); of equals the first by ``order``.

    Items with the same genres overlap alike, so wanted genres meet the distinct sets of genres, not the items. Of each set
    only as many of its best items are looked at as the asker may need: k and one for each item taken; askers are classed by the power of two
    above that, so that one with a long history doesn't lengthen the others' lists. Groups of askers meet parts of the sets within tasks,
    and only an asker's k best of a part leave one: neither sets nor items that an asker doesn't get are shuffled with it."""
    wants = wanted.groupBy("asker", "item_type").agg(F.collect_set("genre").alias("wants"))
    had = taken.groupBy("asker", "item_type").agg(F.collect_set("item_id").alias("had"))
    none = F.array().cast(had.schema["had"].dataType)
    asks = wants.join(had, ["asker", "item_type"], "left").withColumn("had", F.coalesce("had", none))
    asks = kept(asks.withColumn("class", F.ceil(F.log2(F.size("had") + k)).cast("int")), "askers")
    groups = asks.groupBy("item_type", "class").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("slots"))  # 41 classes of a type at most

    genres = item_genres.distinct().groupBy(*ITEM).agg(F.sort_array(F.collect_list("genre")).alias("genres"))
    nth = F.row_number().over(Window.partitionBy("item_type", "genres").orderBy(*order))
    best = items.join(genres, ITEM).withColumn("nth", nth).join(F.broadcast(groups), "item_type").filter(F.col("nth") <= F.pow(F.lit(2), "class"))
    best = kept(best, "best-of-sets")
    parts = best.groupBy("item_type", "class").agg(F.ceil(F.count("*") / PART_ITEMS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("genres", F.floor(F.col("nth") / PIECE)), F.col("parts")).cast("int")
    key = ["item_type", "class", "part"]
    ranked = best.join(F.broadcast(parts), ["item_type", "class"]).withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    sets = ranked.groupBy(*key, "slots", "genres").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("m"))
    sets = sets.select(*key, "genres", F.col("m.rank").alias("ranks"), F.col("m.item_id").alias("ids"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    dealt = asks.join(F.broadcast(groups.join(parts, ["item_type", "class"])), ["item_type", "class"])
    dealt = dealt.withColumns({"slot": F.pmod(F.xxhash64("asker"), F.col("slots")).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}).drop("slots", "parts")

    out = StructType([asks.schema["asker"], asks.schema["item_type"], StructField("item_id", items.schema["item_id"].dataType), StructField("overlap", LongType())])
    met = dealt.groupBy(*key, "slot").cogroup(sets.groupBy(*key, "slot"))
    found = met.applyInArrow(lambda some, of: best_of_part(some, of, k), out)
    # all windows within an asker's rows can do with this one shuffle
    return top_k_per_group(found.join(items, ITEM).repartition("asker"), ["asker", "item_type"], [F.desc("overlap"), *order], k)


def best_of_part(asks: pa.Table, sets: pa.Table, k: int) -> pa.Table:
    """(asker, item_type, item_id, overlap): for each asker (asker, item_type, wants, had) the k items of the sets (genres, ranks, ids: of the set's best
    items, by rank) with most of the wanted genres, of equals the first by rank, without what the asker had."""
    if not sets.num_rows or not asks.num_rows:
        sets, asks = sets.slice(0, 0), asks.slice(0, 0)
    words, word_at = listed(sets, "genres")
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    by_word = np.argsort(code, kind="stable")
    sets_of = np.repeat(np.arange(sets.num_rows), np.diff(word_at))[by_word]
    starts = np.searchsorted(code[by_word], np.arange(len(coded.dictionary) + 1))
    ranks, at = listed(sets, "ranks")
    ranks, ids, sizes = ranks.to_numpy(zero_copy_only=False), listed(sets, "ids")[0].to_numpy(zero_copy_only=False), np.diff(at)

    def members(of: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the first so many members of sets lie."""
        return np.repeat(at[of] - np.cumsum(first) + first, first) + np.arange(first.sum())

    def first_of(of: np.ndarray, n: int) -> np.ndarray:
        """Where the n members of sets with the smallest ranks lie, in order; all where there are fewer."""
        have = sizes[of]
        if have.sum() > n:
            each = np.minimum(have, -(-n // len(of)))
            while each.sum() < n:
                each = np.minimum(have, 2 * each)
            bound = np.partition(ranks[members(of, each)], n - 1)[n - 1]  # n members come up to it
            of = of[ranks[at[of]] <= bound]
            have = np.minimum(sizes[of], n)
        where = members(of, have)
        return where[np.argsort(ranks[where])][:n]

    wants, wants_at = listed(asks, "wants")
    wants = pc.fill_null(pc.index_in(wants, value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
    had, had_at = listed(asks, "had")
    had = had.to_numpy(zero_copy_only=False)
    rows, places, overlaps = [], [], []
    for row in range(asks.num_rows):
        asked = [w for w in wants[wants_at[row] : wants_at[row + 1]] if w >= 0]
        if not asked:
            continue
        met, hits = np.unique(np.concatenate([sets_of[starts[w] : starts[w + 1]] for w in asked]), return_counts=True)
        own = had[had_at[row] : had_at[row + 1]]
        need, found, levels = k + len(own), [], []
        for level in range(hits.max(), 0, -1):
            of = met[hits == level]
            if len(of):
                found.append(first_of(of, need))
                levels.append(np.full(len(found[-1]), level))
                need -= len(found[-1])
                if not need:
                    break
        where, level = np.concatenate(found), np.concatenate(levels)
        fresh = np.flatnonzero(~np.isin(ids[where], own))[:k]
        rows.append(np.full(len(fresh), row))
        places.append(where[fresh])
        overlaps.append(level[fresh])
    joined = lambda some: np.concatenate(some) if some else np.zeros(0, np.int64)
    some = asks.select(["asker", "item_type"]).take(pa.array(joined(rows), pa.int64()))
    return some.append_column("item_id", pa.array(ids[joined(places)])).append_column("overlap", pa.array(joined(overlaps), pa.int64()))


def listed(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and where each list begins (and the last ends)."""
    column = table.column(name)
    size = pc.list_value_length(column).to_numpy().astype(np.int64)
    return pc.list_flatten(column).combine_chunks(), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def genre_overlap(user_seeds: DataFrame, seen: DataFrame, item_genres: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(user_id, item, slug, rating_external, overlap, place): per user and type the unseen items with most of the genres of the
    user's seeds of that type. A genre counts once however many seeds have it."""
    wanted = user_seeds.select(F.col("user_id").alias("asker"), *ITEM).join(item_genres, ITEM).select("asker", "item_type", "genre")
    order = [F.desc_nulls_last("rating_external"), F.asc("item_id")]
    lists = overlap_lists(wanted, seen.withColumnRenamed("user_id", "asker"), item_genres, items.select(*ITEM, "slug", "rating_external"), order, k)
    return lists.withColumnRenamed("asker", "user_id")


def similar_books(books: DataFrame, items: DataFrame, credits: DataFrame, item_genres: DataFrame, limit: int = 10) -> DataFrame:
    """(item_type, item_id, other_type, other_id, kind, place): for each book (item_id) those of its authors, then, up to the
    limit, those that share most of its genres, the internal rating before the external one."""
    book = F.col("item_type") == "BOOK"
    asked = books.select("item_id").distinct()
    authored = books_by_same_authors(items, credits, limit).join(asked, "item_id", "left_semi")
    wanted = item_genres.filter(book).join(asked, "item_id", "left_semi").select(F.col("item_id").alias("asker"), "item_type", "genre")
    taken = authored.select(F.col("item_id").alias("asker"), F.col("other_id").alias("item_id")).union(asked.select(F.col("item_id").alias("asker"), "item_id")).withColumn("item_type", F.lit("BOOK"))
    order = [F.desc_nulls_last("rating_internal"), F.desc_nulls_last("rating_external"), F.asc("item_id")]
    alike = overlap_lists(wanted, taken, item_genres.filter(book), items.filter(book).select(*ITEM, "rating_internal", "rating_external"), order, limit)
    both = authored.select("item_id", "other_id", F.lit("SHARED_AUTHOR").alias("kind"), "place").unionByName(
        alike.select(F.col("asker").alias("item_id"), F.col("item_id").alias("other_id"), F.lit("SHARED_GENRE").alias("kind"), "place")
    )
    page = top_k_per_group(both.withColumnRenamed("place", "nth"), ["item_id"], [F.asc("kind"), F.asc("nth")], limit)
    return page.select(F.lit("BOOK").alias("item_type"), "item_id", F.lit("BOOK").alias("other_type"), "other_id", "kind", "place")


#: Types whose short lists are filled from similar items, and how many seeds of each are asked.
FILLED_TYPES, FILL_SEEDS = ("MOVIE", "SERIES"), 3
POPULAR = "Popular right now"


def seed_order() -> list[Column]:
    return [F.desc("weight"), F.when(F.col("origin") == "rating", 0).otherwise(1), F.asc("item_id")]


def told() -> Column:
    """The reason that a seed (title, origin) gives."""
    return F.when(F.col("origin") == "rating", F.concat(F.lit("Because you rated "), "title")).otherwise(F.concat(F.lit("Because "), "title", F.lit(" is in your library")))


def recommendations(
    ratings: DataFrame,
    library: DataFrame,
    item_genres: DataFrame,
    items: DataFrame,
    users: DataFrame | None = None,
    pages: Callable[[DataFrame], DataFrame] | None = None,
    types: tuple[str, ...] = TYPES,
    k: int = 20,
) -> DataFrame:
    """(user_id, item, slug, reason, position): the types' overlap lists interleaved; of equal slugs the first type's stays.

    A user (user_id; all that have rated or shelved anything, and those in ``users``) without a seed of the types gets
    the popular items that they haven't seen. One whose list falls short of k gets more from the similar items of their
    best seeds: ``pages`` gives (item_type, item_id, other_type, other_id, place) of the items it is handed, the best seeds of
    all users."""
    items = items.filter(F.col("item_type").isin(*types))
    own = kept(seeds(ratings, library).join(items.select(*ITEM, "title"), ITEM), "seeds")
    seen = kept(seen_items(ratings, library), "seen")
    number = type_order(F.col("item_type"))
    lists = genre_overlap(own, seen, item_genres, items, k)
    once = top_k_per_group(lists.withColumn("list_no", number), ["user_id", "slug"], [F.asc("list_no"), F.asc("place")], 1, "rn").drop("rn")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "item_type").orderBy("place")))
    reasons = seed_reasons(own)
    # a user's reasons in one row, so that the lists stay where they lie
    told_by = reasons.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("item_type", "reason"))).alias("reasons"))
    local = interleave(placed, ["user_id"], "list_no", "place").filter(F.col("position") <= k).join(told_by, "user_id")
    out = local.select("user_id", *ITEM, "slug", F.col("reasons")[F.col("item_type")].alias("reason"), F.array(F.col("position").cast("int")).alias("rank"))
    if pages is not None:
        asking = top_k_per_group(own.filter(F.col("item_type").isin(*FILLED_TYPES)), ["user_id", "item_type"], seed_order(), FILL_SEEDS, "seed_no")
        asking = asking.withColumns({"reason": told(), "list_no": number})
        answers = pages(asking.select(*ITEM).distinct())
        near = asking.join(answers, ITEM).select("user_id", F.col("other_type").alias("item_type"), F.col("other_id").alias("item_id"), "reason", F.array(F.lit(k + 1), "list_no", "seed_no", F.col("place").cast("int")).alias("rank"))
        near = near.join(items.select(*ITEM, "slug"), ITEM)
        seen_slugs = seen.join(items.select(*ITEM, "slug"), ITEM).select("user_id", "slug").distinct()
        out = out.unionByName(near.join(seen_slugs, ["user_id", "slug"], "left_anti").select(*out.columns))
        out = top_k_per_group(out.repartition("user_id"), ["user_id", "slug"], [F.asc("rank")], 1, "rn").drop("rn")
    out = top_k_per_group(out, ["user_id"], [F.asc("rank")], k, "position").select("user_id", *ITEM, "slug", "reason", F.col("position").cast("long").alias("position"))

    everyone = seen.select("user_id").distinct() if users is None else users.select("user_id").union(seen.select("user_id")).distinct()
    idle = everyone.join(reasons.select("user_id"), "user_id", "left_anti")
    return out.unionByName(popular_for(idle, seen, items, k))


def popular_for(users: DataFrame, seen: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(user_id, item, slug, reason, position): for each user the k most popular items that they haven't seen.

    A user can need no more of the ranking than k and one place for each seen item, so users meet it by place."""
    held = users.join(seen.filter(F.col("item_type").isin(*TYPES)), "user_id", "left").groupBy("user_id").agg(F.count("item_id").alias("held"))
    most = held.agg(F.max("held")).first()[0] or 0
    ranking = items.filter("rating_external is not null").orderBy(*canonical_order()).limit(k + most).withColumn("nth", F.row_number().over(Window.orderBy(*canonical_order())))
    wanted = held.select("user_id", F.explode(F.sequence(F.lit(1), (F.lit(k) + F.col("held")).cast("int"))).alias("nth"))
    fresh = wanted.join(ranking.select("nth", *ITEM, "slug"), "nth").join(seen, ["user_id", *ITEM], "left_anti")
    return top_k_per_group(fresh, ["user_id"], [F.asc("nth")], k, "position").select("user_id", *ITEM, "slug", F.lit(POPULAR).alias("reason"), F.col("position").cast("long").alias("position"))


def books_by_same_authors(items: DataFrame, credits: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, other_id, place): other books that share an author with a book, in the catalog's order."""
    books = items.filter("item_type = 'BOOK'")
    wrote = credits.filter("item_type = 'BOOK' and role = 'AUTHOR'").select("item_id", "person_id").distinct()
    pairs = wrote.join(wrote.withColumnRenamed("item_id", "other_id"), "person_id").filter("item_id <> other_id").select("item_id", "other_id").distinct()
    live = pairs.join(books.select("item_id"), "item_id", "left_semi").join(books.select(F.col("item_id").alias("other_id"), "rating_internal", "rating_external"), "other_id")
    order = [F.desc_nulls_last("rating_internal"), F.desc_nulls_last("rating_external"), F.asc("other_id")]
    return top_k_per_group(live, ["item_id"], order, k).select("item_id", "other_id", "place")


def authorship_works(credits: DataFrame, items: DataFrame) -> DataFrame:
    """(person_id, item): works of all types by those who are the author of a book that exists, under either role of
    authorship. The gate keeps translators and the like out."""
    written = credits.filter(F.col("role").isin(*AUTHORS))
    live = items.select(*ITEM)
    gate = credits.filter("role = 'AUTHOR' and item_type = 'BOOK'").join(live, ITEM, "left_semi").select("person_id").distinct()
    return written.join(gate, "person_id", "left_semi").join(live, ITEM, "left_semi").select("person_id", *ITEM).distinct()


def adaptations(relations: DataFrame, items: DataFrame, source: str = "WIKIDATA") -> DataFrame:
    """(item, other, direction, score) over the edges of one source, from both ends. ADAPTATION and DERIVATIVE only; a pair that is
    linked both ways shows once, the best score first, then the smallest key."""
    edges = relations.filter((F.col("source") == source) & F.col("relation").isin("ADAPTATION", "DERIVATIVE"))
    # an adaptation's far end is its source, a derivative's far end came of it; from the other end it is the reverse
    adapts = F.col("relation") == "ADAPTATION"

    def seen_from(near: str, far: str, is_source: Column) -> DataFrame:
        direction = F.when(is_source, "SOURCE").otherwise("DERIVED").alias("direction")
        return edges.select(F.col(f"{near}_type").alias("item_type"), F.col(f"{near}_id").alias("item_id"), F.col(f"{far}_type").alias("other_type"), F.col(f"{far}_id").alias("other_id"), direction, "score")

    out, back = seen_from("from", "to", adapts), seen_from("to", "from", ~adapts)
    both = out.unionByName(back)
    once = top_k_per_group(both, [*ITEM, "other_type", "other_id"], [F.desc("score"), F.desc("direction")], 1, "rn").drop("rn")
    far = items.select(F.col("item_type").alias("other_type"), F.col("item_id").alias("other_id"), F.col("slug").alias("other_slug"))
    return once.join(far, ["other_type", "other_id"])


#: Items of a user in one block of pairs.
PAIR_BLOCK = 256


def cooccurrence(library: DataFrame, ratings: DataFrame, k: int = 20, min_users: int = 1) -> DataFrame:
    """(item, other, score, place): cosine of items over the users who have both, a user weighing 1 / ln(1 + items). Pairs that
    fewer than min_users share are left out.

    All items of a user are paired. A user's items are dealt into blocks of PAIR_BLOCK, and block meets block, each pair
    of blocks a key of its own: so the pairs of one heavy user are made by many tasks. Pairs are made one way round
    and summed before they are turned."""
    cells = library.select("user_id", *ITEM).union(ratings.select("user_id", *ITEM)).distinct()
    sizes = cells.groupBy("user_id").agg(F.count("*").alias("n")).filter("n > 1")
    weighted = cells.join(sizes, "user_id").select("user_id", *ITEM, "n", (1 / F.log1p("n")).alias("w"))
    norms = cells.join(cells.groupBy("user_id").agg((1 / F.log1p(F.count("*"))).alias("w")), "user_id").groupBy(*ITEM).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    blocks = F.ceil(F.col("n") / PAIR_BLOCK).cast("int")
    dealt = weighted.withColumn("block", F.pmod(F.xxhash64(*ITEM), blocks).cast("int"))
    # one side goes to the pairs of blocks that begin with its own, the other to those that end with it
    near = dealt.select("user_id", F.struct(*ITEM).alias("a"), "w", F.explode(F.transform(F.sequence(F.col("block"), blocks - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))).alias("at"))
    far = dealt.select("user_id", F.struct(*ITEM).alias("b"), F.explode(F.transform(F.sequence(F.lit(0), F.col("block")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))).alias("at"))
    pairs = near.join(far, ["user_id", "at"]).filter("at.i < at.j or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    dots = pairs.groupBy("a", "b").agg(F.sum(F.col("w") * F.col("w")).alias("dot"), F.count("*").alias("users")).filter(F.col("users") >= min_users)
    both = dots.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "dot")
    named = both.select(F.col("p.x.item_type").alias("item_type"), F.col("p.x.item_id").alias("item_id"), F.col("p.y.item_type").alias("other_type"), F.col("p.y.item_id").alias("other_id"), "dot")
    far_norms = norms.select(F.col("item_type").alias("other_type"), F.col("item_id").alias("other_id"), F.col("norm").alias("other_norm"))
    scored = named.join(norms, ITEM).join(far_norms, ["other_type", "other_id"]).withColumn("score", F.round(F.col("dot") / F.col("norm") / F.col("other_norm"), 6))
    return top_k_per_group(scored, ITEM, [F.desc("score"), F.asc("other_type"), F.asc("other_id")], k).select(*ITEM, "other_type", "other_id", "score", "place")


#: A user with so many items at most is light: the pairs are few and weigh most.
LIGHT_ITEMS = 64
#: Scores are rounded to six places before they are ranked, so a bound must miss by more than that.
SLACK = 2e-6


def item_pairs(cells: DataFrame, wanted: Column) -> DataFrame:
    """(a, b, w) for each pair of items of a user that is wanted, one way round; cells (user_id, item, n, w, and what wanted reads of
    either side as ``name`` and ``name_b``). Blocks of PAIR_BLOCK items meet, each pair of blocks a key of its own."""
    extra = [c for c in cells.columns if c not in ("user_id", *ITEM, "n", "w")]
    blocks = F.ceil(F.col("n") / PAIR_BLOCK).cast("int")
    dealt = cells.withColumn("block", F.pmod(F.xxhash64(*ITEM), blocks).cast("int"))
    begins = F.transform(F.sequence(F.col("block"), blocks - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    ends = F.transform(F.sequence(F.lit(0), F.col("block")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    near = dealt.select("user_id", F.struct(*ITEM).alias("x"), "w", *extra, F.explode(begins).alias("at"))
    far = dealt.select("user_id", F.struct(*ITEM).alias("y"), *(F.col(c).alias(f"{c}_b") for c in extra), F.explode(ends).alias("at"))
    met = near.join(far, ["user_id", "at"]).filter("at.i < at.j or x < y").filter(wanted)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")


def summed(pairs: DataFrame, dot: str, users: str) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.sum(F.col("w") * F.col("w")).alias(dot), F.count("*").alias(users))


def cooccurrence_pruned(library: DataFrame, ratings: DataFrame, k: int = 20, min_users: int = 1, light: int = LIGHT_ITEMS) -> DataFrame:
    """What ``cooccurrence`` gives, without counting pairs that can't be among an item's k best.

    All pairs of light users are counted; they weigh most, and of each item the k-th best of what they come to is a bound that its k-th
    best score can't be below. What the other, heavy users can add to a pair is at most the smaller of the two items' weights in them.
    So a pair goes on only if that could lift it to the bound of one of its items: pairs that light users have are judged with
    what they have, and looked up in the lists of heavy users if they need it; of heavy users only pairs are made that reach a bound
    by heavy weight alone. Scores of what is left are exact."""
    cells = library.select("user_id", *ITEM).union(ratings.select("user_id", *ITEM)).distinct()
    sizes = cells.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("w", 1 / F.log1p("n"))
    weighted = kept(cells.join(sizes, "user_id").select("user_id", *ITEM, "n", "w"), "cells")
    square = F.col("w") * F.col("w")
    masses = weighted.groupBy(*ITEM).agg(F.sqrt(F.sum(square)).alias("norm"), F.sum(F.when(F.col("n") > light, square).otherwise(0.0)).alias("heavy"))

    few = kept(summed(item_pairs(weighted.filter((F.col("n") > 1) & (F.col("n") <= light)), F.lit(True)), "dot", "users"), "light-pairs")
    stats = masses.select(F.struct(*ITEM).alias("item"), "norm", "heavy")
    side = lambda df, x: df.select(*(F.col(c).alias(x if c == "item" else f"{c}_{x}") for c in df.columns))
    light_scores = few.filter(F.col("users") >= min_users).join(side(stats, "a"), "a").join(side(stats, "b"), "b").withColumn("score", F.col("dot") / F.col("norm_a") / F.col("norm_b"))
    turned = light_scores.select(F.explode(F.array("a", "b")).alias("item"), "score")
    bound = top_k_per_group(turned, ["item"], [F.desc("score")], k).filter(F.col("place") == k).select("item", F.col("score").alias("bound"))
    known = kept(stats.join(bound, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))), "item-bounds")

    def reaches(weight: Column, norms: Column, bounds: Column) -> Column:
        return weight >= norms * (bounds - SLACK)

    # pairs by heavy weight alone
    heavy = weighted.filter(F.col("n") > light).join(known.select("item.*", "norm", "heavy", "bound"), ITEM)
    alone = reaches(F.least("heavy", "heavy_b"), F.col("norm") * F.col("norm_b"), F.least("bound", "bound_b"))
    many = kept(summed(item_pairs(heavy, alone), "more", "more_users"), "heavy-pairs")

    # pairs that light users have, and that heavy ones may lift
    judged = few.join(side(known, "a"), "a").join(side(known, "b"), "b")
    lift, norms, bounds = F.least("heavy_a", "heavy_b"), F.col("norm_a") * F.col("norm_b"), F.least("bound_a", "bound_b")
    open_pairs = kept(judged.filter(reaches(F.col("dot") + lift, norms, bounds)).select("a", "b", "dot", "users", (lift > 0).alias("lifted"), reaches(lift, norms, bounds).alias("made")), "open-pairs")
    lists = heavy.select("user_id", F.struct(*ITEM).alias("item"), "w")
    asked = open_pairs.filter("lifted and not made").select("a", "b")
    looked_up = asked.join(lists.select(F.col("item").alias("a"), "user_id", "w"), "a").join(lists.select(F.col("item").alias("b"), "user_id"), ["b", "user_id"])
    both = many.unionByName(summed(looked_up, "more", "more_users"))

    total = open_pairs.select("a", "b", "dot", "users").join(both, ["a", "b"], "full_outer")
    total = total.select("a", "b", *((F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("dot", "more"), ("users", "more_users"))))
    # what heavy weight alone lifts is lifted with the light part too, so no pair of heavy users misses its light part
    found = total.filter(F.col("users") >= min_users).join(side(stats, "a"), "a").join(side(stats, "b"), "b")
    scored = found.withColumn("score", F.round(F.col("dot") / F.col("norm_a") / F.col("norm_b"), 6))
    each = scored.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "score")
    named = each.select("p.x.item_type", "p.x.item_id", F.col("p.y.item_type").alias("other_type"), F.col("p.y.item_id").alias("other_id"), "score")
    return top_k_per_group(named, ITEM, [F.desc("score"), F.asc("other_type"), F.asc("other_id")], k).select(*ITEM, "other_type", "other_id", "score", "place")


#: Co-occurrence is used from so many users on that have so many items.
ACTIVE_USERS, ACTIVE_ITEMS = 1000, 20


def cooccurrence_active(library: DataFrame, ratings: DataFrame, users: int = ACTIVE_USERS, items: int = ACTIVE_ITEMS) -> bool:
    """Whether there is enough activity for co-occurrence to say something: so many users with so many items each."""
    cells = library.select("user_id", *ITEM).union(ratings.select("user_id", *ITEM)).distinct()
    return cells.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= items).count() >= users


def seed_reasons(user_seeds: DataFrame) -> DataFrame:
    """(user_id, item_type, reason): why a user gets items of a type, told by the heaviest seed (with its title) of that type."""
    first = top_k_per_group(user_seeds, ["user_id", "item_type"], seed_order(), 1)
    return first.select("user_id", "item_type", told().alias("reason"))


def similar_reasons(page: DataFrame) -> DataFrame:
    """A page of similar items with the kind of their likeness and its score to 4 places."""
    kind = F.when(F.col("item_type") == F.col("other_type"), "SEMANTIC").otherwise("SEMANTIC_CROSS_TYPE")
    return page.withColumns({"kind": kind, "score": F.round("score", 4)})
