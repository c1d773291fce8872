"""Registered queries of the landed payloads: JSON made of the views is parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.bindings import Views
from marquee.plans.catalog_queries import query
from marquee.sources import landed


def bodies(v: Views, item_type: str, *fields) -> DataFrame:
    """(body) of the items of a type with credits: the cast in the order of ``pos``, and the crew."""
    job = F.when(F.col("role") == "DIRECTOR", "Director").when(F.col("role") == "WRITER", "Screenplay").when(F.col("role") == "AUTHOR", "Novel").otherwise("Grip")
    person = F.concat(F.lit("p"), F.col("person_id").cast("string"))
    crew = v["v_credit"].filter(F.col("item_type") == item_type).groupBy("item_id").agg(F.collect_list(F.struct(F.col("person_id").alias("id"), person.alias("name"), job.alias("job"))).alias("crew"))
    members = F.sort_array(F.collect_list(F.struct("pos", F.col("person_id").alias("id"), "name", F.col("character_name").alias("character"), F.col("billing").alias("order"))))
    cast = v["v_cast"].filter(F.col("item_type") == item_type).groupBy("item_id").agg(F.transform(members, lambda m: m.dropFields("pos")).alias("cast"))
    made = v["v_credit"].filter((F.col("item_type") == item_type) & (F.col("role") == "CREATOR")).groupBy("item_id").agg(F.collect_list(F.struct(F.col("person_id").alias("id"), person.alias("name"))).alias("created_by"))
    m = v["v_item"].filter(F.col("item_type") == item_type).join(crew, "item_id", "left").join(cast, "item_id", "left").join(made, "item_id", "left")
    return m.select(F.to_json(F.struct(*fields, F.struct("cast", "crew").alias("credits"))).alias("body"))


def movies(v: Views) -> DataFrame:
    return bodies(
        v, "MOVIE", F.col("item_id").alias("id"), "title", "original_title", "overview", F.coalesce(F.col("release_date").cast("string"), F.lit("")).alias("release_date"), (F.col("item_id") % 4 * 30).cast("int").alias("runtime"),
        F.concat(F.lit("/"), "slug").alias("poster_path"), F.col("rating_external").alias("vote_average"), F.col("rating_count_external").alias("vote_count"),
    )


def series(v: Views) -> DataFrame:
    return bodies(
        v, "SERIES", F.col("item_id").alias("id"), F.col("title").alias("name"), F.col("release_date").cast("string").alias("first_air_date"), (F.col("item_id") % 9).alias("number_of_seasons"), F.col("rating_external").alias("vote_average"),
        F.lit("Ended").alias("status"), "created_by",
    )


SLUG = "regexp_replace(replace(title, ' ', '-'), '[^a-z-]', '', 'g')"


@query(
    "s4_parse_movie_details",
    f"""SELECT CAST(item_id AS VARCHAR) AS external_id, title, concat_ws('-', {SLUG}, CAST(year(release_date) AS VARCHAR)) AS slug, overview,
      CAST(release_date AS VARCHAR) AS release_date, CAST(nullif(item_id % 4 * 30, 0) AS INTEGER) AS runtime,
    concat('https://image.tmdb.org/t/p/w500/', slug) AS poster_url, nullif(rating_external, 0) AS rating_external, nullif(rating_count_external, 0) AS
      rating_count_external FROM {{v_item}} WHERE item_type = 'MOVIE'""",
)
def _(v: Views) -> DataFrame:
    out = landed.parse_movie_details(movies(v))
    return out.select("external_id", "title", "slug", "overview", F.col("release_date").cast("string").alias("release_date"), "runtime", "poster_url", "rating_external", "rating_count_external")


#: The first ten of the cast as billed in the payload, by type.
BILLED = """SELECT CAST(item_id AS VARCHAR) AS external_id, person_id, 'ACTOR' AS role, billing FROM (SELECT * FROM {v_cast} JOIN {v_item} USING
      (item_type, item_id) WHERE item_type = 'TYPE' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= 10) WHERE person_id <> 0"""


def credit_rows(cast: DataFrame, crew: DataFrame) -> DataFrame:
    return cast.select("external_id", "person_id", F.lit("ACTOR").alias("role"), "billing").unionByName(crew.select("external_id", "person_id", "role", F.lit(None).cast("int").alias("billing")))


@query(
    "g8_movie_credits",
    f"""SELECT DISTINCT CAST(item_id AS VARCHAR) AS external_id, person_id, CASE role WHEN 'AUTHOR' THEN 'SOURCE_AUTHOR' ELSE role END AS role,
      CAST(NULL AS INTEGER) AS billing FROM {{v_credit}} JOIN {{v_item}} USING (item_type, item_id) WHERE item_type = 'MOVIE' AND role IN ('DIRECTOR',
      'WRITER', 'AUTHOR') AND person_id <> 0
    UNION ALL {BILLED.replace('TYPE', 'MOVIE')}""",
)
def _(v: Views) -> DataFrame:
    return credit_rows(*landed.movie_credits(landed.parse_movie_details(movies(v))))


@query(
    "g8_series_credits",
    f"""SELECT DISTINCT CAST(item_id AS VARCHAR) AS external_id, person_id, CASE role WHEN 'AUTHOR' THEN 'SOURCE_AUTHOR' ELSE role END AS role,
      CAST(NULL AS INTEGER) AS billing FROM {{v_credit}} JOIN {{v_item}} USING (item_type, item_id) WHERE item_type = 'SERIES' AND role IN ('CREATOR',
      'WRITER', 'AUTHOR') AND person_id <> 0
    UNION ALL {BILLED.replace('TYPE', 'SERIES')}""",
)
def _(v: Views) -> DataFrame:
    return credit_rows(*landed.series_credits(landed.parse_series_details(series(v))))


@query(
    "s5_parse_series_details",
    f"""SELECT CAST(item_id AS VARCHAR) AS external_id, title, concat_ws('-', {SLUG}, CAST(year(release_date) AS VARCHAR)) AS slug, CAST(item_id % 9
      AS INTEGER) AS number_of_seasons, nullif(rating_external, 0) AS rating_external, 'Ended' AS status FROM {{v_item}} WHERE item_type = 'SERIES'""",
)
def _(v: Views) -> DataFrame:
    return landed.parse_series_details(series(v)).select("external_id", "title", "slug", "number_of_seasons", "rating_external", "status")


GAME_TYPE = "CASE item_id % 20 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in landed.GAME_TYPES.items()) + " ELSE 'MAIN_GAME' END"


def games(v: Views) -> DataFrame:
    g = v["v_item"].filter("item_type = 'GAME'")
    named = lambda x: F.struct(x.alias("name"), x.alias("slug"))
    genre = F.concat(F.lit("g"), (F.col("item_id") % 5).cast("string"))
    body = F.struct(
        F.col("item_id").alias("id"), F.col("title").alias("name"), F.when(F.col("item_id") % 3 > 0, F.col("slug")).alias("slug"), F.unix_seconds(F.col("release_date").cast("timestamp")).alias("first_release_date"),
        (F.col("rating_external") * 10).alias("rating"), (F.col("item_id") % 20).cast("int").alias("game_type"), F.array(named(genre), named(F.lit("x")), named(genre)).alias("genres"),
    )
    return landed.parse_game_details(g.select(F.to_json(body).alias("body")))


@query(
    "s6_parse_game_details",
    f"""SELECT CAST(item_id AS VARCHAR) AS external_id, CASE WHEN item_id % 3 > 0 THEN slug ELSE {SLUG} END AS slug, CAST(release_date AS VARCHAR) AS
      release_date, {GAME_TYPE} AS game_type, rating_external, concat('g', CAST(item_id % 5 AS VARCHAR), ',x') AS genres FROM {{v_item}} WHERE
      item_type = 'GAME'""",
)
def _(v: Views) -> DataFrame:
    return games(v).select("external_id", "slug", F.col("release_date").cast("string").alias("release_date"), "game_type", "rating_external", F.array_join(F.transform("genres", lambda g: g["slug"]), ",").alias("genres"))


@query("p5_allowed_game_types", f"SELECT coalesce(reason, 'allowed') AS reason, count(*) AS n FROM (SELECT CASE WHEN {GAME_TYPE} NOT IN ('{"', '".join(landed.ALLOWED_GAME_TYPES)}') THEN concat('game_type:', {GAME_TYPE}) END AS reason FROM {{v_item}} WHERE item_type = 'GAME') GROUP BY 1")
def _(v: Views) -> DataFrame:
    return landed.allowed_games(games(v)).groupBy(F.coalesce("reason", F.lit("allowed")).alias("reason")).agg(F.count("*").alias("n"))
