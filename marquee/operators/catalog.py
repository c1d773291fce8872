"""Catalog listing, search and lookups over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM, tokens


def canonical_order(by: str = "rating", ascending: bool = False) -> list[Column]:
    """The catalog's orders, nulls last, ties by key. The external rating always goes down."""
    way = F.asc_nulls_last if ascending else F.desc_nulls_last
    ties = [F.asc("item_type"), F.asc("item_id")]
    if by == "rating":
        return [way("rating_internal"), F.desc_nulls_last("rating_external"), *ties]
    if by == "date":
        return [way("release_date"), *ties]
    return [F.asc("title"), *ties]


def top_k_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(place) <= k)


def catalog_filters(items: DataFrame, text: str | None = None, released=(None, None), internal=(None, None), external=(None, None)) -> DataFrame:
    """Rows that satisfy all given filters, bounds included. % and _ in the text are wildcards."""
    for low, high in (released, internal, external):
        if low is not None and high is not None and low > high:
            raise ValueError("lower bound above upper bound")
    if text is not None:
        items = items.filter(F.col("title").ilike(f"%{text}%"))
    for column, (low, high) in (("release_date", released), ("rating_internal", internal), ("rating_external", external)):
        if low is not None:
            items = items.filter(F.col(column) >= F.lit(low))
        if high is not None:
            items = items.filter(F.col(column) <= F.lit(high))
    return items


def by_genre(items: DataFrame, item_genres: DataFrame, genre: str) -> DataFrame:
    return items.join(item_genres.filter(F.col("genre") == genre).select(*ITEM), ITEM, "left_semi")


def paginate(rows: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit)


def list_catalog(items: DataFrame, item_genres: DataFrame, item_type: str, genre: str | None = None, sort: str = "rating", ascending: bool = False, page: int = 1, limit: int = 20, **filters) -> DataFrame:
    rows = catalog_filters(items.filter(F.col("item_type") == item_type), **filters)
    if genre is not None:
        rows = by_genre(rows, item_genres, genre)
    return paginate(rows, canonical_order(sort, ascending), page, limit)


def genre_counts(item_genres: DataFrame, items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(genre, n_items) for every genre of the vocabulary, also of no item."""
    live = item_genres.join(items.select(*ITEM), ITEM, "left_semi").groupBy("genre").agg(F.count("*").alias("n_items"))
    return vocabulary.select("genre").distinct().join(live, "genre", "left").select("genre", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def catalog_stats(items: DataFrame) -> DataFrame:
    return items.groupBy("item_type").agg(F.count("*").alias("n_items"), F.max("last_synced_on").alias("last_synced_on"))


#: What the second copy of a title in the search text leaves out.
NOT_IN_TITLE = r"[^a-zA-Z0-9\s]"


def search_words(items: DataFrame) -> Column:
    """The words of an item: of its title, of the title without punctuation, and of its overview."""
    return tokens(F.concat_ws(" ", "title", F.regexp_replace("title", NOT_IN_TITLE, ""), "overview"))


def search(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item, rank) for all queries (query_id, q) at once: an item matches if it has every word of the query.

    Items meet a query by its rarest word alone, so that a frequent word joins nothing; the other words are then
    looked for among the item's own. Items are dealt by key before their words are taken, as a scan may have few tasks for many of them, and
    their texts are met by a merge, never broadcast. rank is the sum over the query's words of their frequency in the item over 1 + ln of
    its length, and decides only between equal ratings."""
    dealt = items.select(*ITEM, "rating_external", "title", "overview").repartition(*ITEM)
    texts = dealt.select(*ITEM, "rating_external", search_words(dealt).alias("words"))
    index = texts.select(*ITEM, F.explode(F.array_distinct("words")).alias("word"))
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("q"))).alias("asked"))
    each = asked.select("query_id", F.explode("asked").alias("word"))
    spread = index.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    # a word that no item has leaves the query without matches
    rarest = each.join(spread, "word", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).filter("r.n > 0").select("query_id", "r.word")
    found = index.join(rarest.join(asked, "query_id"), "word").join(texts.hint("merge"), ITEM).filter(F.size(F.array_except("asked", "words")) == 0)
    total = F.size(F.filter("words", lambda w: F.array_contains(F.col("asked"), w)))
    return found.select("query_id", *ITEM, "rating_external", (total / (1 + F.log(F.size("words")))).alias("rank"))


def search_catalog(items: DataFrame, q: str | None = None, item_type: str | None = None, released=(None, None), external=(None, None)) -> DataFrame:
    """Items, with ``rank``, that match the text (all where there is none) within the bounds; order by ``search_order``. Count
    the result for a total."""
    rows = items if item_type is None else items.filter(F.col("item_type") == item_type.upper())
    rows = catalog_filters(rows, released=released, external=external)
    if q is None:
        return rows.withColumn("rank", F.lit(0.0))
    asked = rows.sparkSession.createDataFrame([(0, q)], "query_id int, q string")
    return rows.join(search(rows, asked).select(*ITEM, "rank"), ITEM)


def search_order() -> list[Column]:
    return [F.desc_nulls_last("rating_external"), F.desc(F.round("rank", 6)), F.asc("item_id"), F.asc("item_type")]


def popular_items(items: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """Items with an external rating that aren't among the seen ones, best first."""
    rated = items.filter("rating_external is not null").join(seen.select(*ITEM), ITEM, "left_anti")
    return rated.orderBy(*canonical_order()).limit(limit)


def resolve_items(keys: DataFrame, items: DataFrame) -> DataFrame:
    """The keys that exist, with title and slug."""
    return keys.join(items.select(*ITEM, "title", "slug"), ITEM)


def viewer_status(items: DataFrame, library: DataFrame, viewer: int) -> DataFrame:
    own = library.filter(F.col("user_id") == viewer).select(*ITEM, F.col("status").alias("viewer_status"))
    return items.join(own, ITEM, "left")


def genre_text(item_genres: DataFrame) -> DataFrame:
    return item_genres.groupBy(*ITEM).agg(F.array_join(F.array_sort(F.collect_set("genre")), ", ").alias("genres"))


def interleave(lists: DataFrame, key: list[str], list_no: str, place: str) -> DataFrame:
    """Round-robin merge of ranked lists within each key: position by (place, list)."""
    return lists.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(place, list_no)))


def last_wins(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Of rows with one key the last by position, at the place of the first."""
    others = [c for c in rows.columns if c not in key and c != pos]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), pos).alias("v"), F.min(pos).alias(pos)).select(*key, pos, "v.*")


def first_seen(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    others = [c for c in rows.columns if c not in key and c != pos]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), pos).alias("v") if others else F.lit(None).alias("v"), F.min(pos).alias(pos)).select(*key, pos, *([] if not others else ["v.*"]))


def search_users(users: DataFrame, banned: bool | None = None, admin: bool | None = None, text: str | None = None) -> DataFrame:
    """Users that satisfy all that is given; order them by name and id, and page with ``paginate``."""
    if banned is not None:
        users = users.filter(F.col("is_banned") == banned)
    if admin is not None:
        users = users.filter(F.col("is_admin") == admin)
    if text is not None:
        users = users.filter(F.col("username").ilike(f"%{text}%") | F.col("display_name").ilike(f"%{text}%") | F.col("email").ilike(f"%{text}%"))
    return users


def item_documents(items: DataFrame, item_genres: DataFrame, cast: DataFrame, crew: DataFrame, companies: DataFrame | None = None, platforms: DataFrame | None = None, library: DataFrame | None = None, viewer: int | None = None) -> DataFrame:
    """One row for each item with its genres, cast and crew as arrays; with companies (item, role, name, slug), platforms
    (item, slug) and the viewer's status where their tables are given."""
    crews = crew.groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct("role", "person_id"))).alias("crew"))
    out = items.join(genre_text(item_genres), ITEM, "left").join(cast, ITEM, "left").join(crews, ITEM, "left")
    if companies is not None:
        out = out.join(companies.groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct("role", "slug", "name"))).alias("companies")), ITEM, "left")
    if platforms is not None:
        out = out.join(platforms.groupBy(*ITEM).agg(F.array_sort(F.collect_set("slug")).alias("platforms")), ITEM, "left")
    return out if library is None else viewer_status(out, library, viewer)


def item_credits(cast: DataFrame, crew: DataFrame, people: DataFrame) -> DataFrame:
    """(item, position, name, role): an item's cast in its order, then the crew (with created_at) by time, person and role."""
    acted = cast.select(*ITEM, F.lit(0).alias("part"), F.col("billing").isNull().alias("last"), F.col("billing").cast("long").alias("a"), F.col("pos").alias("b"), "name", F.lit("ACTOR").alias("role"))
    made = crew.join(people.select("person_id", "name"), "person_id").select(*ITEM, F.lit(1).alias("part"), F.lit(False).alias("last"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("a"), F.col("person_id").alias("b"), "name", "role")
    order = Window.partitionBy(*ITEM).orderBy("part", "last", F.asc_nulls_first("a"), "b", "role")
    return acted.unionByName(made).withColumn("position", F.row_number().over(order)).select(*ITEM, "position", "name", "role")


def company_credits(credits: DataFrame, companies: DataFrame) -> DataFrame:
    return credits.join(companies.select("company_id", "name", "slug"), "company_id")


def person_filmography(credits: DataFrame, items: DataFrame) -> DataFrame:
    """Credits with the slug and title of their item; null where it doesn't exist, and always for games."""
    live = items.filter("item_type <> 'GAME'").select(*ITEM, "slug", "title")
    return credits.join(live, ITEM, "left")
