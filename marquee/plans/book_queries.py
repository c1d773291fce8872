"""Registered queries of the books that a dump yields, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.genre_values import DDC_FORMS, DDC_GENRES, DDC_MARKS, LCC_GENRES, PZ_YOUNG_FROM, PZ_YOUNG_GENRES, SUBJECT_GENRES
from marquee.operators import dumps
from marquee.plans.batch_queries import EDITIONS, LOW, editions
from marquee.plans.bindings import Views
from marquee.plans.catalog_queries import query
from marquee.sources import landed
from marquee.sources.shared import kept


def values(known: dict[str, list[str]]) -> str:
    rows = ", ".join("('{}', [{}])".format(k.replace("'", "''"), ", ".join(f"'{g}'" for g in genres)) for k, genres in known.items())
    return f"(VALUES {rows})"


#: Genres (ge) of the works in a (work_id, lcc, ddc: lists in order, subjects).
GENRES = f"""le AS (SELECT work_id, unnest(generate_series(1, len(lcc))) AS nth, upper(trim(unnest(lcc))) AS s FROM a),
 lk AS (SELECT work_id, nth, k AS class, g, try_cast(nullif(regexp_extract(s, '^[A-Z]+-?[ ]*([0-9]+([.][0-9]+)?)', 1), '') AS DOUBLE) AS n FROM le
      JOIN {values(LCC_GENRES)} m(k, g) ON starts_with(regexp_extract(s, '^[A-Z][A-Z]?[A-Z]?'), k) QUALIFY row_number() OVER (PARTITION BY work_id,
      nth ORDER BY length(k) DESC) = 1),
 lv AS (SELECT work_id, class = 'PZ' AND coalesce(n >= {PZ_YOUNG_FROM}, false) AS young, class, any_value(g) AS g, count(*) AS votes, min(nth) AS first FROM lk GROUP BY ALL),
 lg AS (SELECT work_id, CASE WHEN young THEN {PZ_YOUNG_GENRES} ELSE g END AS g FROM lv QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY votes DESC, first) = 1),
 de AS (SELECT work_id, unnest(generate_series(1, len(ddc))) AS nth, unnest(ddc) AS s FROM a),
 dd AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS d, lower(regexp_extract(trim(s), '^[[]([A-Za-z]+)[]]', 1)) AS mark FROM de),
 df AS (SELECT dd.*, CASE WHEN d[1] = '8' AND length(d) > 1 AND d[2] <> '0' THEN f.g[1] END AS form FROM dd LEFT JOIN {values({k: [f] for k, f in DDC_FORMS.items()})} f(k, g) ON f.k = d[3]),
 dp AS (SELECT work_id, nth, g FROM df JOIN {values(DDC_GENRES)} m(k, g) ON starts_with(d, k) QUALIFY row_number() OVER (PARTITION BY work_id, nth ORDER BY length(k) DESC) = 1),
 dg AS (SELECT df.work_id, df.nth, CASE WHEN mark <> '' THEN coalesce(m.g, []) WHEN d[1] = '8' THEN CASE WHEN form IS NULL THEN ['literature'] ELSE
      [form, 'literature'] END ELSE coalesce(dp.g, []) END AS g
   FROM df LEFT JOIN dp USING (work_id, nth) LEFT JOIN {values(DDC_MARKS)} m(k, g) ON m.k = mark),
 dl AS (SELECT work_id, flatten(list(g ORDER BY nth)) AS g FROM dg GROUP BY work_id HAVING len(flatten(list(g))) > 0),
 fo AS (SELECT work_id, arg_min(form, nth) AS form FROM df WHERE form IS NOT NULL GROUP BY work_id),
 sg AS (SELECT work_id, flatten(list(g ORDER BY nth)) AS g FROM (SELECT work_id, unnest(generate_series(1, len(subjects))) AS nth,
      trim(regexp_replace(lower(unnest(subjects)), '[ ]+', ' ', 'g')) AS s FROM a) JOIN {values(SUBJECT_GENRES)} m(k, g) ON k = s GROUP BY work_id),
 gl AS (SELECT a.work_id, CASE WHEN lg.g IS NOT NULL THEN CASE WHEN list_contains(lg.g, 'literature') AND form IS NOT NULL THEN list_prepend(form,
      lg.g) ELSE lg.g END ELSE coalesce(dl.g, sg.g, []) END AS g FROM a LEFT JOIN lg USING (work_id) LEFT JOIN dl USING (work_id) LEFT JOIN fo USING
      (work_id) LEFT JOIN sg USING (work_id)),
 gn AS (SELECT work_id, genre, min(nth) AS nth FROM (SELECT work_id, unnest(generate_series(1, len(g))) AS nth, unnest(g) AS genre FROM gl) GROUP BY
      work_id, genre QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY min(nth)) <= 5),
 ge AS (SELECT gl.work_id, coalesce(string_agg(genre, ',' ORDER BY gn.nth), '') AS genres FROM gl LEFT JOIN gn USING (work_id) GROUP BY gl.work_id)"""


@query(
    "f20_derive_genres",
    f"""WITH a AS (SELECT work_id, coalesce(list(lcc ORDER BY pos) FILTER (lcc IS NOT NULL), []) AS lcc, coalesce(list(ddc ORDER BY pos) FILTER (ddc
      IS NOT NULL), []) AS ddc, ['nothing', any_value(subject)] AS subjects FROM {{v_edition}} JOIN {{v_work}} USING (work_id) GROUP BY work_id),
    {GENRES} SELECT * FROM ge""",
)
def _(v: Views) -> DataFrame:
    works = kept(v["v_work"].join(v["v_edition"].select("work_id").distinct(), "work_id", "left_semi"), "works")
    known = dumps.with_call_numbers(works, editions(v)).withColumn("subjects", F.array(F.lit("nothing"), F.col("subject")))
    return dumps.derive_genres(known).select("work_id", F.array_join("genres", ",").alias("genres"))


@query(
    "f17_lcc_genres",
    f"""WITH a AS (SELECT DISTINCT concat(work_id, '/', CAST(pos AS VARCHAR)) AS work_id, [lcc] AS lcc, CAST([] AS VARCHAR[]) AS ddc, CAST([] AS
      VARCHAR[]) AS subjects FROM {{v_edition}} WHERE lcc IS NOT NULL), {GENRES} SELECT * FROM ge""",
)
def _(v: Views) -> DataFrame:
    each = v["v_edition"].filter("lcc is not null").select(F.concat_ws("/", "work_id", F.col("pos").cast("string")).alias("work_id"), F.array("lcc").alias("lcc")).distinct()
    return each.select("work_id", F.array_join(F.coalesce(dumps.lcc_genres(F.col("lcc")), F.array().cast("array<string>")), ",").alias("genres"))


@query(
    "f18_ddc_genres",
    f"""WITH a AS (SELECT DISTINCT concat(work_id, '/', CAST(pos AS VARCHAR)) AS work_id, CAST([] AS VARCHAR[]) AS lcc, [ddc] AS ddc, CAST([] AS
      VARCHAR[]) AS subjects FROM {{v_edition}} WHERE ddc IS NOT NULL), {GENRES} SELECT * FROM ge""",
)
def _(v: Views) -> DataFrame:
    each = v["v_edition"].filter("ddc is not null").select(F.concat_ws("/", "work_id", F.col("pos").cast("string")).alias("work_id"), F.array("ddc").alias("ddc")).distinct()
    return each.select("work_id", F.array_join(dumps.ddc_genres(F.col("ddc")), ",").alias("genres"))


def work_dump(v: Views) -> DataFrame:
    author = lambda c: F.struct(F.concat(F.lit("/authors/"), F.col(c)).alias("key"))
    body = F.struct("title", F.array(F.lit("nothing"), F.col("subject")).alias("subjects"), F.array(F.lit(-1).cast("long"), F.col("cover")).alias("covers"), "description", F.array(F.struct(author("first_author").alias("author")), F.struct(author("second_author").alias("author"))).alias("authors"))
    return v["v_work"].select(F.concat(F.lit("/works/"), "work_id").alias("key"), F.to_json(body).alias("body"))


def seeded(v: Views) -> tuple[DataFrame, DataFrame]:
    """The dump's records land as files first: parsed over the views, they would be parsed for every row that the views make distinct."""
    authors = landed.parse_author_names(kept(v["v_author"].select(F.concat(F.lit("/authors/"), "author_id").alias("key"), F.to_json(F.struct("name")).alias("body")), "author-dump"))
    chosen = kept(dumps.select_works(v["v_reading_log"], editions(v), LOW), "chosen-works")
    works = landed.parse_work_records(kept(work_dump(v), "work-dump"), chosen)
    return dumps.seed_books(v["v_reading_log"], editions(v), works, authors, LOW, chosen)


CHOSEN = f"""{EDITIONS}, a AS (SELECT b.* EXCLUDE (lcc, ddc), coalesce(lcc, []) AS lcc, coalesce(ddc, []) AS ddc, ['nothing', subject] AS subjects,
      w.readers, trim(k.title) AS title, k.description, k.cover AS own_cover, k.first_author, k.second_author,
   CASE WHEN list_contains(languages, 'eng') THEN 'eng' ELSE 'spa' END AS selected_as FROM ea b JOIN w USING (work_id) JOIN {{v_work}} k USING (work_id) WHERE k.title <> ''
   AND ((list_contains(languages, 'eng') AND readers >= 3 AND editions >= 2 AND pages >= 100) OR (NOT list_contains(languages, 'eng') AND
      list_contains(languages, 'spa') AND readers >= 2 AND editions >= 2 AND pages >= 80)))""".replace(" a AS (SELECT work_id, count(*) AS editions", " ea AS (SELECT work_id, count(*) AS editions")


@query(
    "b1_seed_books",
    f"""WITH {CHOSEN}, {GENRES} SELECT work_id, title, description AS overview, CAST(make_date(first_year, 1, 1) AS VARCHAR) AS release_date, CASE
      WHEN own_cover > 0 THEN own_cover ELSE cover END AS cover, isbn, pages, readers, selected_as, genres FROM a JOIN ge USING (work_id)""",
)
def _(v: Views) -> DataFrame:
    books = seeded(v)[0]
    return books.withColumns({"release_date": F.col("release_date").cast("string"), "genres": F.array_join("genres", ",")})


@query(
    "b1_seed_credits",
    f"""WITH {CHOSEN}, c AS (SELECT work_id, first_author AS author_id, 0 AS billing FROM a UNION ALL SELECT work_id, second_author, 1 FROM a WHERE second_author <> first_author)
    SELECT work_id, author_id, name, billing FROM c JOIN {{v_author}} USING (author_id) WHERE trim(name) <> ''""",
)
def _(v: Views) -> DataFrame:
    return seeded(v)[1]


@query("s8_parse_work_records", """SELECT work_id, title, concat('nothing,', subject) AS subjects, CASE WHEN cover > 0 THEN cover END AS cover,
      description, CASE WHEN first_author = second_author THEN first_author ELSE concat(first_author, ',', second_author) END AS author_ids FROM
      {v_work}""")
def _(v: Views) -> DataFrame:
    return landed.parse_work_records(work_dump(v)).withColumns({"subjects": F.array_join("subjects", ","), "author_ids": F.array_join("author_ids", ",")})


@query("s9_parse_author_names", "SELECT author_id, name FROM {v_author} WHERE trim(name) <> ''")
def _(v: Views) -> DataFrame:
    return landed.parse_author_names(v["v_author"].select(F.concat(F.lit("/authors/"), "author_id").alias("key"), F.to_json(F.struct("name")).alias("body")))


@query(
    "s7_parse_book_docs",
    f"""WITH a AS (SELECT work_id, CASE WHEN n % 3 = 0 THEN ['PS-3500'] ELSE [] END AS lcc, CASE WHEN n % 2 = 0 THEN ['813.54'] ELSE [] END AS ddc,
      ['nothing', subject] AS subjects FROM {{v_work}}), {GENRES}
    SELECT work_id AS external_id, coalesce(title, '') AS title, description AS overview, CAST(make_date(CAST(1900 + n % 100 AS INTEGER), 1, 1) AS
      VARCHAR) AS release_date, genres FROM {{v_work}} JOIN ge USING (work_id)""",
)
def _(v: Views) -> DataFrame:
    n = F.col("n")
    doc = F.struct(
        F.concat(F.lit("/works/"), "work_id").alias("key"), "title", (1900 + n % 100).cast("int").alias("first_publish_year"), F.when(n % 3 == 0, F.array(F.lit("PS-3500"))).alias("lcc"),
        F.when(n % 2 == 0, F.array(F.lit("813.54"))).alias("ddc"), F.array(F.lit("nothing"), F.col("subject")).alias("subject_facet"),
    )
    books = landed.parse_book_docs(v["v_work"].select(F.to_json(doc).alias("body"), F.to_json(F.struct("description")).alias("detail")))
    return books.select("external_id", "title", "overview", F.col("release_date").cast("string").alias("release_date"), F.array_join("genres", ",").alias("genres"))
