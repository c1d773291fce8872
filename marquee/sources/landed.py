"""Landed files: dumps, id exports and API payloads, read into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.columns import epoch_date, first_positive, first_text, key_suffix, loose_date, slugify
from marquee.functions.fold import ascii_fold
from marquee.operators.dumps import derive_genres

#: Where images lie.
IMAGES = {"movie": "https://image.tmdb.org/t/p/w500", "game": "https://images.igdb.com/igdb/image/upload/t_cover_big"}

#: Kinds of games by number; what isn't listed is a MAIN_GAME.
GAME_TYPES = {
    0: "MAIN_GAME",
    1: "DLC_ADDON",
    2: "EXPANSION",
    3: "BUNDLE",
    4: "STANDALONE_EXPANSION",
    5: "MOD",
    6: "EPISODE",
    7: "SEASON",
    8: "REMAKE",
    9: "REMASTER",
    10: "EXPANDED_GAME",
    11: "PORT",
    12: "FORK",
    13: "PACK",
    14: "UPDATE",
}
#: Kinds of games that are let in.
ALLOWED_GAME_TYPES = "MAIN_GAME DLC_ADDON EXPANSION STANDALONE_EXPANSION EPISODE SEASON REMAKE REMASTER".split()

#: Jobs of a film crew that make a credit.
CREW_ROLES = {
    "Director": "DIRECTOR",
    "Novel": "SOURCE_AUTHOR",
    "Book": "SOURCE_AUTHOR",
    "Short Story": "SOURCE_AUTHOR",
    "Comic Book": "SOURCE_AUTHOR",
    "Graphic Novel": "SOURCE_AUTHOR",
    "Theatre Play": "SOURCE_AUTHOR",
    "Characters": "SOURCE_AUTHOR",
    "Screenplay": "WRITER",
    "Writer": "WRITER",
    "Teleplay": "WRITER",
    "Adaptation": "WRITER",
    "Dialogue": "WRITER",
}

NAMED = "array<struct<name:string,slug:string>>"
MOVIE = f"struct<id:long,title:string,original_title:string,overview:string,release_date:string,runtime:int,original_language:string,poster_path:string,budget:long,revenue:long,status:string,vote_average:double,vote_count:long,genres:array<struct<name:string>>,credits:struct<cast:array<struct<id:long,name:string,character:string,order:int>>,crew:array<struct<id:long,name:string,job:string>>>>"
SERIES = "struct<id:long,name:string,original_name:string,overview:string,first_air_date:string,last_air_date:string,number_of_seasons:int,number_of_episodes:int,original_language:string,poster_path:string,status:string,vote_average:double,vote_count:long,genres:array<struct<name:string>>,created_by:array<struct<id:long,name:string>>,credits:struct<cast:array<struct<id:long,name:string,character:string,order:int>>,crew:array<struct<id:long,name:string,job:string>>>>"
GAME = f"struct<id:long,name:string,slug:string,summary:string,cover:struct<image_id:string>,first_release_date:long,rating:double,rating_count:long,game_type:int,genres:{NAMED},platforms:{NAMED},involved_companies:array<struct<company:struct<name:string,slug:string>,developer:boolean,publisher:boolean>>>"
WORK = "struct<title:string,subjects:array<string>,covers:array<long>,description:string,authors:array<struct<author:struct<key:string>,key:string>>>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, revision, modified, body) of a dump of five columns by tabs, the fifth JSON; shorter lines are dropped.

    A gzip file is one task however large, so the lines are dealt out right after it is read."""
    lines = spark.read.text(path).repartition(spark.sparkContext.defaultParallelism)
    parts = F.split("value", "\t", 5)
    names = ["kind", "key", "revision", "modified", "body"]
    return lines.filter(F.size(parts) == 5).select(*(parts[i].alias(n) for i, n in enumerate(names)))


def read_reading_log(spark: SparkSession, path: str) -> DataFrame:
    """(work_id) of each line that begins with the key of a work and has a tab."""
    head = F.split("value", "\t", 2)
    lines = spark.read.text(path).filter(F.col("value").startswith("/works/") & (F.size(head) > 1))
    return lines.select(key_suffix(head[0]).alias("work_id")).filter("work_id is not null")


def read_id_export(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, popularity, adult, video) of a daily export of JSON lines; lines that can't be read are dropped."""
    schema = "id long, original_title string, original_name string, popularity double, adult boolean, video boolean"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).filter("id is not null")
    no = F.lit(False)
    return rows.select("id", F.coalesce("original_title", "original_name").alias("title"), F.coalesce("popularity", F.lit(0.0)).alias("popularity"), F.coalesce("adult", no).alias("adult"), F.coalesce("video", no).alias("video"))


def rating(value: Column) -> Column:
    """A mark to one place; 0 says that there is none."""
    return F.round(F.nullif(value, F.lit(0.0)), 1)


def image(kind: str, path: Column) -> Column:
    return F.when(path != "", F.concat(F.lit(IMAGES[kind]), path))


def slug_of(title: Column, day: Column, source: str, source_id: Column) -> Column:
    """title-year, or source-id where the title has nothing in ASCII."""
    base = slugify(ascii_fold(F.coalesce(title, F.lit(""))))
    return F.when(base == "", F.concat_ws("-", F.lit(source.lower()), source_id.cast("string"))).otherwise(F.concat_ws("-", base, F.year(day).cast("string")))


def nothing_as_null(number: Column) -> Column:
    return F.when(number != 0, number)


def parse_movie_details(landed: DataFrame, body: str = "body") -> DataFrame:
    m = landed.select(F.from_json(body, MOVIE).alias("m")).select("m.*")
    day = F.try_to_date("release_date", "yyyy-MM-dd")
    return m.select(
        F.lit("MOVIE").alias("item_type"),
        F.col("id").cast("string").alias("external_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        "original_title",
        slug_of(F.col("title"), day, "TMDB", F.col("id")).alias("slug"),
        F.nullif("overview", F.lit("")).alias("overview"),
        day.alias("release_date"),
        nothing_as_null(F.col("runtime")).alias("runtime"),
        "original_language",
        image("movie", F.col("poster_path")).alias("poster_url"),
        nothing_as_null(F.col("budget")).alias("budget"),
        nothing_as_null(F.col("revenue")).alias("revenue"),
        "status",
        rating(F.col("vote_average")).alias("rating_external"),
        nothing_as_null(F.col("vote_count")).alias("rating_count_external"),
        F.transform("genres", lambda g: g["name"]).alias("genres"),
        "credits",
    )


def parse_series_details(landed: DataFrame, body: str = "body") -> DataFrame:
    s = landed.select(F.from_json(body, SERIES).alias("s")).select("s.*")
    day = F.try_to_date("first_air_date", "yyyy-MM-dd")
    return s.select(
        F.lit("SERIES").alias("item_type"),
        F.col("id").cast("string").alias("external_id"),
        F.coalesce("name", F.lit("")).alias("title"),
        F.col("original_name").alias("original_title"),
        slug_of(F.col("name"), day, "TMDB", F.col("id")).alias("slug"),
        F.nullif("overview", F.lit("")).alias("overview"),
        day.alias("release_date"),
        F.try_to_date("last_air_date", "yyyy-MM-dd").alias("last_air_date"),
        "number_of_seasons",
        "number_of_episodes",
        image("movie", F.col("poster_path")).alias("poster_url"),
        rating(F.col("vote_average")).alias("rating_external"),
        nothing_as_null(F.col("vote_count")).alias("rating_count_external"),
        F.transform("genres", lambda g: g["name"]).alias("genres"),
        "status",
        "created_by",
        "credits",
    )


def once_by_slug(values: Column) -> Column:
    """The first of each slug, without blank ones."""
    slugs = F.transform(values, lambda x: x["slug"])
    return F.filter(values, lambda x, i: (x["slug"] != "") & (F.array_position(slugs, x["slug"]) == i + 1))


def parse_game_details(landed: DataFrame, body: str = "body") -> DataFrame:
    g = landed.select(F.from_json(body, GAME).alias("g")).select("g.*")
    kinds = F.create_map(*(F.lit(x) for pair in GAME_TYPES.items() for x in pair))
    companies = F.filter("involved_companies", lambda c: c["company"].isNotNull())

    def of(role: str) -> Column:
        return F.transform(F.filter(companies, lambda c: c[role]), lambda c: F.struct(c["company"]["name"].alias("name"), c["company"]["slug"].alias("slug"), F.lit(role.upper()).alias("role")))

    return g.select(
        F.lit("GAME").alias("item_type"),
        F.col("id").cast("string").alias("external_id"),
        F.coalesce("name", F.lit("")).alias("title"),
        F.coalesce(F.nullif("slug", F.lit("")), slug_of(F.col("name"), F.lit(None).cast("date"), "IGDB", F.col("id"))).alias("slug"),
        F.nullif("summary", F.lit("")).alias("overview"),
        epoch_date(F.col("first_release_date")).alias("release_date"),
        F.coalesce(F.try_element_at(kinds, F.coalesce("game_type", F.lit(0))), F.lit("MAIN_GAME")).alias("game_type"),
        image("game", F.concat(F.lit("/"), F.col("cover.image_id"), F.lit(".jpg"))).alias("poster_url"),
        F.round(F.col("rating") / 10, 1).alias("rating_external"),
        F.col("rating_count").alias("rating_count_external"),
        once_by_slug(F.col("genres")).alias("genres"),
        once_by_slug(F.col("platforms")).alias("platforms"),
        F.array_distinct(F.concat(of("developer"), of("publisher"))).alias("companies"),
    )


def allowed_games(games: DataFrame) -> DataFrame:
    """Games with the reason why they are left out, null for those that aren't."""
    return games.withColumn("reason", F.when(~F.col("game_type").isin(*ALLOWED_GAME_TYPES), F.concat(F.lit("game_type:"), "game_type")))


def parse_work_records(dump: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(work_id, title, subjects, cover, description, author_ids) of works; authors in order, each once, in either shape. Of
    wanted works (work_id) only, if these are given, so that the others' JSON isn't parsed."""
    if wanted is not None:
        dump = dump.withColumn("work_id", key_suffix(F.col("key"))).join(wanted.select("work_id"), "work_id", "left_semi")
    w = dump.select(key_suffix(F.col("key")).alias("work_id"), F.from_json("body", WORK).alias("w"), F.get_json_object("body", "$.description.value").alias("long_text"))
    ids = F.transform("w.authors", lambda a: key_suffix(F.coalesce(a["author"]["key"], a["key"]), "authors"))
    return w.select("work_id", "w.title", "w.subjects", first_positive(F.col("w.covers")).alias("cover"), F.coalesce("long_text", "w.description").alias("description"), F.array_distinct(F.array_compact(ids)).alias("author_ids"))


EDITION = "struct<works:array<struct<key:string>>,languages:array<struct<key:string>>,number_of_pages:string,dewey_decimal_class:array<string>,lc_classifications:array<string>,isbn_13:array<string>,isbn_10:array<string>,publish_date:string,covers:array<long>>"


def parse_edition_records(dump: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(work_id, pos, languages, pages, lcc, ddc, isbn_13, isbn_10, publish_date, cover) of editions, once for each of their works; of
    wanted works only, if these are given. Pages must be a whole number; pos is the edition's place in the dump, as ``dump_lines`` tells
    it, or the row's number, which is the place only if nothing was dealt out before."""
    pos = F.col("pos") if "pos" in dump.columns else F.monotonically_increasing_id()
    e = dump.select(pos.alias("pos"), F.from_json("body", EDITION).alias("e")).select("pos", "e.*", F.explode(F.array_distinct(F.transform("e.works", lambda w: key_suffix(w["key"])))).alias("work_id")).filter("work_id is not null")
    if wanted is not None:
        e = e.join(wanted.select("work_id"), "work_id", "left_semi")
    said = lambda c: F.filter(c, lambda x: x != "")
    return e.select(
        "work_id",
        "pos",
        F.array_compact(F.transform("languages", lambda x: key_suffix(x["key"], "languages"))).alias("languages"),
        F.when(F.col("number_of_pages").rlike("^[0-9]+$"), F.col("number_of_pages").try_cast("int")).alias("pages"),
        said("lc_classifications").alias("lcc"),
        said("dewey_decimal_class").alias("ddc"),
        first_text(F.col("isbn_13")).alias("isbn_13"),
        first_text(F.col("isbn_10")).alias("isbn_10"),
        "publish_date",
        first_positive(F.col("covers")).alias("cover"),
    )


def parse_author_names(dump: DataFrame) -> DataFrame:
    name = F.coalesce(*(F.nullif(F.trim(F.get_json_object("body", f"$.{f}")), F.lit("")) for f in ("name", "personal_name")))
    return dump.select(key_suffix(F.col("key"), "authors").alias("author_id"), name.alias("name")).filter("name is not null")


def parse_bindings(landed: DataFrame, properties: dict[str, str]) -> DataFrame:
    """(from_qid, relation, to_qid) of query results (from, prop, to: addresses); what isn't a plain id or a known property
    is dropped."""
    tail = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    known = F.create_map(*(F.lit(x) for pair in properties.items() for x in pair))
    rows = landed.select(tail("from").alias("from_qid"), F.try_element_at(known, tail("prop")).alias("relation"), tail("to").alias("to_qid"))
    plain = "^Q[1-9][0-9]*$"
    return rows.filter(F.col("from_qid").rlike(plain) & F.col("to_qid").rlike(plain) & F.col("relation").isNotNull())


#: Of these jobs, those that make a credit of a series.
SERIES_CREW_ROLES = {job: role for job, role in CREW_ROLES.items() if role in ("SOURCE_AUTHOR", "WRITER")}


def series_credits(series: DataFrame, n_cast: int = 10) -> tuple[DataFrame, DataFrame]:
    """Cast and crew as of a movie; a series' creators are credited as CREATOR, and it has no director."""
    cast, crew = movie_credits(series, n_cast, SERIES_CREW_ROLES)
    creators = series.select("external_id", F.explode("created_by").alias("c")).select("external_id", F.col("c.id").alias("person_id"), "c.name", F.lit("CREATOR").alias("role"))
    return cast, crew.unionByName(creators.filter(WHOLE).dropDuplicates(["external_id", "person_id"]))


#: A credit needs an id and a name.
WHOLE = "person_id is not null and person_id <> 0 and name <> ''"


def movie_credits(movies: DataFrame, n_cast: int = 10, jobs: dict[str, str] = CREW_ROLES) -> tuple[DataFrame, DataFrame]:
    """The cast (external_id, person_id, name, character, billing) in the payload's order, n_cast at most as billed, and
    the crew (external_id, person_id, name, role), once for a person and role."""
    cast = movies.select("external_id", F.posexplode(F.slice("credits.cast", 1, n_cast)).alias("pos", "c")).select("external_id", F.col("c.id").alias("person_id"), "c.name", F.col("c.character").alias("character_name"), F.col("c.order").alias("billing"), "pos")
    roles = F.create_map(*(F.lit(x) for pair in jobs.items() for x in pair))
    crew = movies.select("external_id", F.explode("credits.crew").alias("c")).select("external_id", F.col("c.id").alias("person_id"), "c.name", F.try_element_at(roles, F.col("c.job")).alias("role"))
    return cast.filter(WHOLE), crew.filter("role is not null").filter(WHOLE).dropDuplicates(["external_id", "person_id", "role"])


BOOK = "struct<key:string,title:string,first_publish_year:int,cover_i:long,isbn:array<string>,author_name:array<string>,ratings_average:double,ratings_count:long,ddc:array<string>,lcc:array<string>,subject_facet:array<string>>"


def parse_book_docs(landed: DataFrame, body: str = "body", detail: str = "detail") -> DataFrame:
    """Books of search documents with the detail of their work: its date goes before the year of first publication
    (January 1), a description may be a text or an object, a cover may be none; genres come from their classes."""

    b = landed.select(F.from_json(body, BOOK).alias("b"), F.col(detail).alias("d"))
    told = F.coalesce(F.get_json_object("d", "$.description.value"), F.get_json_object("d", "$.description"))
    day = F.coalesce(loose_date(F.get_json_object("d", "$.first_publish_date")), F.try_make_timestamp(F.col("b.first_publish_year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    books = b.select(
        F.lit("BOOK").alias("item_type"),
        key_suffix(F.col("b.key")).alias("external_id"),
        F.coalesce("b.title", F.lit("")).alias("title"),
        slug_of(F.col("b.title"), day, "OPENLIBRARY", key_suffix(F.col("b.key"))).alias("slug"),
        F.nullif(F.trim(told), F.lit("")).alias("overview"),
        day.alias("release_date"),
        F.when(F.col("b.cover_i") > 0, F.concat(F.lit("https://covers.openlibrary.org/b/id/"), F.col("b.cover_i").cast("string"), F.lit("-L.jpg"))).alias("poster_url"),
        first_text(F.col("b.isbn")).alias("isbn"),
        F.col("b.lcc").alias("lcc"),
        F.col("b.ddc").alias("ddc"),
        F.col("b.subject_facet").alias("subjects"),
    )
    return derive_genres(books)
