"""Registered queries of the similarity, dump, batch and incremental operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import columns as fn
from marquee.functions.columns import ITEM
from marquee.operators import dumps, incremental, recommend, resolve, similarity
from marquee.operators.catalog import company_credits, first_seen, genre_text, item_documents, last_wins, resolve_items
from marquee.plans.bindings import NOW, Views
from marquee.plans.catalog_queries import SHELVES, query, recommended_sql, seeds_sql, shelves

COSINE = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query(
    "e2_knn",
    f"""WITH s AS (SELECT a.item_type, a.item_id, b.item_type AS other_type, b.item_id AS other_id, {COSINE} AS score FROM {{v_embedding}} a,
      {{v_embedding}} b WHERE a.item_id % 20 = 0 AND (a.item_type <> b.item_type OR a.item_id <> b.item_id))
    SELECT *, row_number() OVER (PARTITION BY item_type, item_id ORDER BY score DESC, other_type, other_id) AS place FROM s QUALIFY place <= 10""",
)
def _(v: Views) -> DataFrame:
    return similarity.knn(v["v_embedding"].filter("item_id % 20 = 0"), v["v_embedding"], 10)


@query(
    "e3_similar_pool",
    f"""WITH s AS (SELECT a.item_type, a.item_id, b.item_type AS other_type, b.item_id AS other_id, {COSINE} AS score FROM {{v_embedding}} a,
      {{v_embedding}} b WHERE a.item_id % 20 = 0 AND (a.item_type <> b.item_type OR a.item_id <> b.item_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_type, item_id ORDER BY score DESC, other_type, other_id) AS place,
      CASE WHEN item_type <> other_type THEN row_number() OVER (PARTITION BY item_type, item_id, item_type <> other_type ORDER BY score DESC, other_type, other_id) END AS cross_place FROM s)
    SELECT item_type, item_id, other_type, other_id, score, CASE WHEN place <= 60 THEN place END AS place, CASE WHEN cross_place <= 60 THEN
      cross_place END AS cross_place FROM r WHERE place <= 60 OR cross_place <= 60""",
)
def _(v: Views) -> DataFrame:
    return similarity.similar_pool(v["v_embedding"].filter("item_id % 20 = 0"), v["v_embedding"])


#: The page of similar items of every vector, without penalties: 3 places for other types, 10 in all.
PAGES = f"""pc AS (SELECT a.item_type, a.item_id, b.item_type AS other_type, b.item_id AS other_id, {COSINE} AS score FROM {{v_embedding}} a,
      {{v_embedding}} b WHERE {{asked}} AND (a.item_type <> b.item_type OR a.item_id <> b.item_id)),
 pp AS (SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY item_type, item_id ORDER BY score DESC, other_type, other_id) <= 60
   OR (item_type <> other_type AND row_number() OVER (PARTITION BY item_type, item_id, item_type <> other_type ORDER BY score DESC, other_type, other_id) <= 60)),
 pr AS (SELECT p.*, row_number() OVER (PARTITION BY p.item_type, p.item_id ORDER BY score DESC, other_type, other_id) AS rn FROM pp p JOIN {{v_item}}
      i ON i.item_type = other_type AND i.item_id = other_id),
 px AS (SELECT *, item_type <> other_type AND row_number() OVER (PARTITION BY item_type, item_id, item_type <> other_type ORDER BY rn) <= 3 AS reserved FROM pr),
 py AS (SELECT *, row_number() OVER (PARTITION BY item_type, item_id, reserved ORDER BY rn) AS yn, count(*) FILTER (reserved) OVER (PARTITION BY item_type, item_id) AS kept FROM px),
 page AS (SELECT item_type, item_id, other_type, other_id, score, row_number() OVER (PARTITION BY item_type, item_id ORDER BY rn) AS place FROM py WHERE reserved OR yn <= 10 - kept)"""


@query("e5_similar_plain", f"WITH {PAGES.replace('{asked}', 'a.item_id % 20 = 0')} SELECT * FROM page")
def _(v: Views) -> DataFrame:
    return similarity.similar(v["v_embedding"].filter("item_id % 20 = 0"), v["v_embedding"], v["v_item"], v["v_credit"], penalty=0.0)


@query("e5_similar")
def _(v: Views) -> DataFrame:
    return similarity.similar(v["v_embedding"].filter("item_id % 20 = 0"), v["v_embedding"], v["v_item"], v["v_credit"])


@query(
    "c8_recommendations_filled",
    f"""WITH us AS (SELECT user_id FROM {{v_rating}} UNION SELECT user_id FROM ({SHELVES})), {seeds_sql(150, f'({SHELVES})')}, {recommended_sql(150)},
      {PAGES.replace('{asked}', "a.item_type IN ('MOVIE', 'SERIES')")},
    n AS (SELECT user_id, count(*) AS got FROM lo GROUP BY user_id),
    ne AS (SELECT sl.user_id, list_position(['MOVIE', 'SERIES'], sl.item_type) AS list_no, seed_no, page.place AS nth, reason, coalesce(got, 0) AS
      got, other_type AS item_type, other_id AS item_id, i.slug FROM sl LEFT JOIN n USING (user_id) JOIN page ON page.item_type = sl.item_type AND
      page.item_id = sl.item_id
      JOIN {{v_item}} i ON i.item_type = other_type AND i.item_id = other_id WHERE sl.item_type IN ('MOVIE', 'SERIES') AND seed_no <= 3 AND coalesce(got, 0) < 150),
    nx AS (SELECT * FROM ne ANTI JOIN (SELECT user_id, slug FROM lo UNION SELECT user_id, slug FROM sn JOIN {{v_item}} USING (item_type, item_id)) t
      USING (user_id, slug) QUALIFY row_number() OVER (PARTITION BY user_id, slug ORDER BY list_no, seed_no, nth) = 1),
    fi AS (SELECT user_id, item_type, item_id, slug, reason, got + row_number() OVER (PARTITION BY user_id ORDER BY list_no, seed_no, nth) AS position FROM nx QUALIFY position <= 150)
    SELECT * FROM lo UNION ALL SELECT * FROM fi UNION ALL SELECT * FROM po""",
)
def _(v: Views) -> DataFrame:
    def pages(anchors: DataFrame) -> DataFrame:
        asked = v["v_embedding"].join(anchors, ITEM, "left_semi")
        return similarity.similar(asked, v["v_embedding"], v["v_item"], v["v_credit"], penalty=0.0).drop("score")

    return recommend.recommendations(v["v_rating"], shelves(v), v["v_item_genre"], v["v_item"], pages=pages, k=150)


OVERLAP = """ov AS (SELECT a.item_id, b.item_id AS other_id, count(*) AS overlap FROM (SELECT DISTINCT * FROM {v_item_genre}) a JOIN (SELECT DISTINCT
      * FROM {v_item_genre}) b ON a.item_type = 'BOOK' AND b.item_type = 'BOOK' AND a.genre = b.genre WHERE a.item_id <> b.item_id AND a.item_id IN
      (SELECT item_id FROM bk) GROUP BY ALL)"""


@query(
    "e5_similar_books",
    f"""WITH bk AS (SELECT item_id FROM {{v_item}} i WHERE item_type = 'BOOK' AND NOT EXISTS (SELECT 1 FROM {{v_embedding}} e WHERE e.item_type = 'BOOK' AND e.item_id = i.item_id)),
    aw AS (SELECT DISTINCT item_id, person_id FROM {{v_credit}} WHERE item_type = 'BOOK' AND role = 'AUTHOR'),
    au AS (SELECT p.item_id, other_id, row_number() OVER (PARTITION BY p.item_id ORDER BY o.rating_internal DESC NULLS LAST, o.rating_external DESC NULLS LAST, other_id) AS n
      FROM (SELECT DISTINCT a.item_id, b.item_id AS other_id FROM aw a JOIN aw b USING (person_id) WHERE a.item_id <> b.item_id) p JOIN {{v_item}} o
      ON o.item_type = 'BOOK' AND o.item_id = other_id WHERE p.item_id IN (SELECT item_id FROM bk) QUALIFY n <= 10),
    {OVERLAP}, ge AS (SELECT ov.item_id, other_id, row_number() OVER (PARTITION BY ov.item_id ORDER BY overlap DESC, o.rating_internal DESC NULLS
      LAST, o.rating_external DESC NULLS LAST, other_id) AS n FROM ov JOIN {{v_item}} o ON o.item_type = 'BOOK' AND o.item_id = other_id WHERE
      (ov.item_id, other_id) NOT IN (SELECT (item_id, other_id) FROM au))
    SELECT 'BOOK' AS item_type, item_id, 'BOOK' AS other_type, other_id, kind, row_number() OVER (PARTITION BY item_id ORDER BY kind, n) AS place FROM
      (SELECT *, 'SHARED_AUTHOR' AS kind FROM au UNION ALL SELECT *, 'SHARED_GENRE' FROM ge) QUALIFY place <= 10""",
)
def _(v: Views) -> DataFrame:
    vectors, none = v["v_embedding"], v["v_relation"].filter("false").select(F.col("from_type").alias("item_type"), F.col("from_id").alias("item_id"), F.col("to_type").alias("other_type"), F.col("to_id").alias("other_id"), F.lit(1).alias("rank"))
    books = v["v_item"].filter("item_type = 'BOOK'").join(vectors.select(*ITEM), ITEM, "left_anti")
    return similarity.similar_or_else(books, vectors, v["v_item"], v["v_credit"], v["v_item_genre"], none)


@query("e2_knn_ivf")
def _(v: Views) -> DataFrame:
    return similarity.ivf_neighbours(v["v_embedding"].filter("item_id % 20 = 0"), v["v_embedding"], 10)


@query("a10_embedding_coverage", """SELECT t.item_type, count(e.item_id) AS n, count(e.item_id) > 0 AS covered FROM (SELECT unnest(['MOVIE',
      'SERIES', 'BOOK', 'GAME']) AS item_type) t LEFT JOIN {v_embedding} e USING (item_type) GROUP BY t.item_type""")
def _(v: Views) -> DataFrame:
    return similarity.embedding_coverage(v["v_embedding"])


@query(
    "f11_source_text",
    """WITH g AS (SELECT item_type, item_id, string_agg(DISTINCT genre, ', ' ORDER BY genre) AS genres FROM {v_item_genre} GROUP BY ALL),
    t AS (SELECT item_type, item_id, concat('passage: ', concat_ws(chr(10), title, genres, overview)) AS text FROM {v_item} LEFT JOIN g USING (item_type, item_id))
    SELECT item_type, item_id, text, sha256(text) AS hash FROM t""",
)
def _(v: Views) -> DataFrame:
    return similarity.embedding_sources(v["v_item"], genre_text(v["v_item_genre"]))


@query("e1_embedding_pass")
def _(v: Views) -> DataFrame:
    sources = similarity.embedding_sources(similarity.embedding_candidates(v["v_item"], 400), genre_text(v["v_item_genre"]))
    stored = sources.filter("item_id % 3 = 0").select(*ITEM, "hash", F.lit("hashed-64").alias("model"))
    return similarity.hashed_vectors(similarity.stale_sources(sources, stored, "hashed-64"))


@query(
    "e1_embedding_report",
    """WITH c AS (SELECT item_type, item_id FROM {v_item} QUALIFY row_number() OVER (PARTITION BY item_type ORDER BY overview IS NOT NULL DESC,
      coalesce(rating_count_external, 0) DESC, coalesce(rating_external, 0) DESC, item_id) <= (SELECT least(100, count(*) // 4) FROM {v_item}))
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c.item_id IS NULL THEN 'other' WHEN i.item_id % 3 = 0 THEN 'unchanged' ELSE 'embedded' END AS
      outcome FROM {v_item} i LEFT JOIN c USING (item_type, item_id) WHERE c.item_id IS NOT NULL OR i.item_id % 3 = 0) GROUP BY outcome""",
)
def _(v: Views) -> DataFrame:
    genres = genre_text(v["v_item_genre"])
    sources = similarity.embedding_sources(similarity.embedding_candidates(v["v_item"], 400), genres)
    stored = similarity.embedding_sources(v["v_item"].filter("item_id % 3 = 0"), genres)
    stored = similarity.hashed_vectors(stored).join(stored.select(*ITEM, "hash"), ITEM).withColumn("model", F.lit("hashed-64"))
    return similarity.embedding_pass(sources, stored, "hashed-64")[1]


@query(
    "t7_embedding_candidates",
    """SELECT item_type, item_id, row_number() OVER (PARTITION BY item_type ORDER BY overview IS NOT NULL DESC, coalesce(rating_count_external, 0)
      DESC, coalesce(rating_external, 0) DESC, item_id) AS place
    FROM {v_item} QUALIFY place <= (SELECT least(100, count(*) // 4) FROM {v_item})""",
)
def _(v: Views) -> DataFrame:
    return similarity.embedding_candidates(v["v_item"], 400).select(*ITEM, "place")


@query("a12_reading_log_counts", "SELECT work_id, count(*) AS readers FROM {v_reading_log} GROUP BY work_id HAVING count(*) >= 2")
def _(v: Views) -> DataFrame:
    return dumps.reading_log_counts(v["v_reading_log"], 2)


#: Thresholds at which the small tables select some works of either language.
LOW = {"eng": {"readers": 3, "editions": 2, "pages": 100}, "spa": {"readers": 2, "editions": 2, "pages": 80}}


def editions(v: Views) -> DataFrame:
    one = lambda c: F.array_compact(F.array(c))
    return v["v_edition"].withColumns({"languages": one("language"), "lcc": one("lcc"), "ddc": one("ddc")})


EDITIONS = """w AS (SELECT work_id, count(*) AS readers FROM {v_reading_log} GROUP BY work_id HAVING count(*) >= 2),
 a AS (SELECT work_id, count(*) AS editions, list_sort(list_distinct(list(language))) AS languages, CAST(ceil(median(pages)) AS BIGINT) AS pages, arg_min(coalesce(isbn_13, isbn_10), pos) AS isbn,
   min(CAST(substr(publish_date, 1, 4) AS INTEGER)) AS first_year, arg_min(cover, pos) FILTER (cover > 0) AS cover,
   list(lcc ORDER BY pos) FILTER (lcc IS NOT NULL) AS lcc, list(ddc ORDER BY pos) FILTER (ddc IS NOT NULL) AS ddc FROM {v_edition} WHERE work_id IN (SELECT work_id FROM w) GROUP BY work_id)"""


@query("a13_aggregate_editions", f"""WITH {EDITIONS} SELECT work_id, editions, array_to_string(languages, ',') AS languages, pages, isbn, first_year,
      cover, coalesce(array_to_string(lcc, '|'), '') AS lcc, coalesce(array_to_string(ddc, '|'), '') AS ddc FROM a""")
def _(v: Views) -> DataFrame:
    found = dumps.aggregate_editions(editions(v), dumps.reading_log_counts(v["v_reading_log"], 2))
    return found.withColumns({"languages": F.array_join("languages", ","), "lcc": F.array_join("lcc", "|"), "ddc": F.array_join("ddc", "|")})


@query(
    "b1_select_works",
    f"""WITH {EDITIONS} SELECT work_id, readers, editions, pages, CASE WHEN list_contains(languages, 'eng') THEN 'eng' ELSE 'spa' END AS selected_as FROM a JOIN w USING (work_id)
    WHERE (list_contains(languages, 'eng') AND readers >= 3 AND editions >= 2 AND pages >= 100) OR (NOT list_contains(languages, 'eng') AND
      list_contains(languages, 'spa') AND readers >= 2 AND editions >= 2 AND pages >= 80)""",
)
def _(v: Views) -> DataFrame:
    return dumps.select_works(v["v_reading_log"], editions(v), LOW).select("work_id", "readers", "editions", "pages", "selected_as")


BATCH_COLUMNS = ["title", "slug", "rating_external"]


@query(
    "p7_validate_rows",
    """SELECT pos, array_to_string(list_filter([CASE WHEN slug IS NULL THEN 'slug missing' END, CASE WHEN length(title) > 500 THEN 'title too long'
      END, CASE WHEN NOT (rating_external BETWEEN 0 AND 1050) THEN 'rating_external out of range' END], lambda x: x IS NOT NULL), ';') AS reasons FROM
      {v_batch}""",
)
def _(v: Views) -> DataFrame:
    return validated(v).select("pos", F.array_join("reject_reasons", ";").alias("reasons"))


def validated(v: Views) -> DataFrame:
    return resolve.validate_rows(v["v_batch"], ["slug"], {"title": 500}, {"rating_external": (0, 1050)})


@query("w5_last_wins", "SELECT item_type, item_id, arg_max(title, pos) AS title, min(pos) AS pos FROM {v_batch} GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return last_wins(v["v_batch"].select(*ITEM, "title", "pos"), ITEM, "pos")


@query("w6_first_seen", "SELECT item_type, item_id, min(pos) AS pos FROM {v_batch} GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return first_seen(v["v_batch"].select(*ITEM, "pos"), ITEM, "pos")


@query("p7_reject_report", """SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN slug IS NULL THEN 'slug missing' END, CASE WHEN
      length(title) > 500 THEN 'title too long' END], lambda x: x IS NOT NULL)) AS reason FROM {v_batch}) GROUP BY reason""")
def _(v: Views) -> DataFrame:
    rows = resolve.validate_rows(v["v_batch"], ["slug"], {"title": 500}, {})
    return rows.select(F.explode("reject_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


UPSERT = """f AS (SELECT item_type, item_id, arg_max(title, pos) AS title, arg_max(slug, pos) AS slug, arg_max(rating_external, pos) AS
      rating_external FROM {v_batch} WHERE slug IS NOT NULL AND length(title) <= 500 AND rating_external BETWEEN 0 AND 1050 GROUP BY ALL),
 u AS (SELECT coalesce(i.item_type, f.item_type) AS item_type, coalesce(i.item_id, f.item_id) AS item_id, CASE WHEN f.item_id IS NULL OR
      i.title_locked THEN i.title ELSE f.title END AS title, CASE WHEN f.item_id IS NULL OR i.title_locked THEN i.slug ELSE f.slug END AS slug,
  CASE WHEN f.item_id IS NULL THEN i.rating_external ELSE f.rating_external END AS rating_external, CASE WHEN f.item_id IS NULL THEN 'kept' WHEN
      i.item_id IS NULL THEN 'created' ELSE 'updated' END AS outcome
  FROM {v_item} i FULL JOIN f ON f.item_type = i.item_type AND f.item_id = i.item_id)"""


def upserted(v: Views) -> DataFrame:
    good = validated(v).filter(F.size("reject_reasons") == 0)
    return resolve.upsert(v["v_item"], good, ITEM, BATCH_COLUMNS, {"title": "title_locked", "slug": "title_locked"})


@query("g4_upsert", f"WITH {UPSERT} SELECT * FROM u")
def _(v: Views) -> DataFrame:
    return upserted(v).select(*ITEM, *BATCH_COLUMNS, "outcome")


@query("a19_load_report", f"WITH {UPSERT} SELECT outcome, count(*) AS n FROM u GROUP BY outcome")
def _(v: Views) -> DataFrame:
    return resolve.load_report(upserted(v))


CLAIMS = "SELECT pos, item_type, item_id, CASE item_type WHEN 'BOOK' THEN 'OPENLIBRARY' WHEN 'GAME' THEN 'IGDB' ELSE 'TMDB' END AS source, CAST(pos % 1000 AS STRING) AS external_id FROM {v_batch}"


@query(
    "g2_link_external_ids",
    f"""WITH b AS ({CLAIMS}), c AS (SELECT *, row_number() OVER (PARTITION BY item_type, source, external_id ORDER BY pos) AS nth FROM b),
    k AS (SELECT c.*, h.item_id AS holder, o.external_id AS own_id FROM c LEFT JOIN {{v_external_id}} h ON h.item_type = c.item_type AND h.source =
      c.source AND h.external_id = c.external_id LEFT JOIN {{v_external_id}} o ON o.item_type = c.item_type AND o.item_id = c.item_id AND o.source =
      c.source),
    r AS (SELECT *, CASE WHEN nth > 1 THEN 'contested' WHEN holder <> item_id THEN 'taken' END AS refused FROM k)
    SELECT pos, item_type, item_id, source, external_id, CASE WHEN refused IS NOT NULL THEN refused
      WHEN EXISTS (SELECT 1 FROM r s WHERE s.refused IS NULL AND s.item_type = r.item_type AND s.item_id = r.item_id AND s.source = r.source AND s.pos > r.pos) THEN 'superseded'
      WHEN own_id = external_id THEN 'known' WHEN own_id IS NOT NULL THEN 'replaced' ELSE 'linked' END AS outcome FROM r""",
)
def _(v: Views) -> DataFrame:
    source = F.when(F.col("item_type") == "BOOK", "OPENLIBRARY").when(F.col("item_type") == "GAME", "IGDB").otherwise("TMDB")
    claims = v["v_batch"].select("pos", *ITEM, source.alias("source"), (F.col("pos") % 1000).cast("string").alias("external_id"))
    return resolve.link_external_ids(claims, v["v_external_id"])


@query(
    "g5_sync_genres",
    """WITH b AS (SELECT item_type, item_id, p FROM (SELECT item_type, item_id, part_id AS p FROM {v_item} WHERE part_id % 10 = 1 AND NOT title_locked))
    SELECT item_type, item_id, genre FROM {v_item_genre} g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.item_type = g.item_type AND b.item_id = g.item_id)
    UNION ALL SELECT item_type, item_id, concat('g', CAST(p % 7 AS VARCHAR)) FROM b UNION ALL SELECT item_type, item_id, 'small' FROM b""",
)
def _(v: Views) -> DataFrame:
    items = v["v_item"]
    batch = items.filter("part_id % 10 = 1").select(*ITEM, F.array(F.concat(F.lit("g"), (F.col("part_id") % 7).cast("string")), F.lit("small"), F.lit("small")).alias("genres"))
    return resolve.sync_genres(v["v_item_genre"], batch, items.filter("title_locked"))


@query("g10_purge_genres", "SELECT g.item_type, g.item_id, g.genre FROM {v_item_genre} g JOIN {v_item} i USING (item_type, item_id) WHERE title_locked")
def _(v: Views) -> DataFrame:
    return resolve.purge_genres(v["v_item_genre"], v["v_item"].filter("title_locked"))


CAST_SQL = """SELECT item_type, item_id, string_agg(concat(name, '/', coalesce(character_name, '-'), '/', coalesce(CAST(billing AS VARCHAR), '-')),
      ';' ORDER BY billing NULLS LAST, pos) AS members FROM {v_cast} GROUP BY ALL"""


def cast_text(v: Views) -> DataFrame:
    member = lambda m: F.concat_ws("/", m["n"], F.coalesce(m["c"], F.lit("-")), F.coalesce(m["o"].cast("string"), F.lit("-")))
    return resolve.build_cast(v["v_cast"]).select(*ITEM, F.array_join(F.transform("cast", member), ";").alias("members"))


@query("a15_build_cast", CAST_SQL)
def _(v: Views) -> DataFrame:
    return cast_text(v)


@query(
    "j18_item_documents",
    f"""WITH c AS ({CAST_SQL}), g AS (SELECT item_type, item_id, string_agg(DISTINCT genre, ', ' ORDER BY genre) AS genres FROM {{v_item_genre}} GROUP
      BY ALL), w AS (SELECT item_type, item_id, string_agg(concat(role, '/', CAST(person_id AS VARCHAR)), ';' ORDER BY role, person_id) AS crew FROM
      {{v_credit}} GROUP BY ALL),
    k AS (SELECT item_type, item_id, string_agg(concat(role, '/', slug), ';' ORDER BY role, slug) AS companies FROM {{v_company_credit}} JOIN
      {{v_company}} USING (company_id) GROUP BY ALL), l AS (SELECT item_type, item_id, status AS viewer_status FROM {{v_library}} WHERE user_id = 7),
    f AS (SELECT item_type, item_id, concat('p', CAST(item_id % 3 AS VARCHAR)) AS platforms FROM {{v_item}} WHERE item_type = 'GAME')
    SELECT item_type, item_id, slug, genres, members, crew, companies, platforms, viewer_status FROM {{v_item}} LEFT JOIN g USING (item_type, item_id)
      LEFT JOIN c USING (item_type, item_id) LEFT JOIN w USING (item_type, item_id) LEFT JOIN k USING (item_type, item_id) LEFT JOIN f USING
      (item_type, item_id) LEFT JOIN l USING (item_type, item_id)""",
)
def _(v: Views) -> DataFrame:
    companies = company_credits(v["v_company_credit"], v["v_company"])
    platforms = v["v_item"].filter("item_type = 'GAME'").select(*ITEM, F.concat(F.lit("p"), (F.col("item_id") % 3).cast("string")).alias("slug"))
    docs = item_documents(v["v_item"], v["v_item_genre"], cast_text(v), v["v_credit"], companies, platforms, v["v_library"], 7)
    text = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws("/", x[a], x[b].cast("string"))), ";").alias(c)
    return docs.select(*ITEM, "slug", "genres", "members", text("crew", "role", "person_id"), text("companies", "role", "slug"), F.array_join("platforms", ";").alias("platforms"), "viewer_status")


@query("j12_resolve_items", "SELECT a.event_id, i.slug FROM {v_act} a JOIN {v_item} i USING (item_type, item_id)")
def _(v: Views) -> DataFrame:
    return resolve_items(v["v_act"], v["v_item"]).select("event_id", "slug")


@query("j16_cast_only_people", """SELECT person_id FROM (SELECT person_id, bool_and(role = 'ACTOR') AS only_cast FROM (SELECT person_id, role FROM
      {v_credit} WHERE person_id % 3 = 0 UNION ALL SELECT person_id, 'ACTOR' FROM {v_cast}) GROUP BY person_id) WHERE only_cast""")
def _(v: Views) -> DataFrame:
    roles = v["v_credit"].filter("person_id % 3 = 0").select("person_id", "role").unionByName(v["v_cast"].select("person_id", F.lit("ACTOR").alias("role")))
    return resolve.cast_only_people(roles)


LIVE = """NOT EXISTS (SELECT 1 FROM {v_external_id} x JOIN {v_item} i ON i.item_type = x.item_type AND i.item_id = x.item_id WHERE x.item_type =
      t.item_type AND x.source = t.source AND x.external_id = t.external_id)"""


@query("j14_unlinked_targets", f"SELECT id, item_type, external_id FROM {{v_target}} t WHERE {LIVE}")
def _(v: Views) -> DataFrame:
    return incremental.unlinked_targets(v["v_target"], v["v_external_id"], v["v_item"]).select("id", "item_type", "external_id")


@query("t5_pending_targets", f"SELECT id, attempts, vote_count FROM {{v_target}} t WHERE {LIVE} AND NOT is_gone AND attempts < 3 ORDER BY attempts, vote_count DESC NULLS LAST, id LIMIT 100")
def _(v: Views) -> DataFrame:
    return incremental.pending_targets(v["v_target"], v["v_external_id"], v["v_item"], 100).select("id", "attempts", "vote_count")


@query("a8_target_progress", f"""SELECT item_type, count(*) AS total, count(*) FILTER (m AND NOT is_gone AND attempts < 3) AS pending, count(*) FILTER
      (m AND is_gone) AS gone, count(*) FILTER (m AND NOT is_gone AND attempts >= 3) AS unlinkable FROM (SELECT t.*, {LIVE} AS m FROM {{v_target}} t)
      GROUP BY item_type""")
def _(v: Views) -> DataFrame:
    return incremental.target_progress(v["v_target"], v["v_external_id"], v["v_item"])


@query("j15_reopen_targets", """SELECT id, CASE WHEN attempts > 0 AND NOT is_gone AND NOT EXISTS (SELECT 1 FROM {v_external_id} x WHERE x.item_type =
      t.item_type AND x.source = t.source AND x.external_id = t.external_id) THEN 0 ELSE attempts END AS attempts FROM {v_target} t""")
def _(v: Views) -> DataFrame:
    return incremental.reopen_targets(v["v_target"], v["v_external_id"]).select("id", "attempts")


OUTCOMES = "CASE id % 6 WHEN 0 THEN 'found' WHEN 1 THEN 'not_found' WHEN 2 THEN 'gone' ELSE 'failed' END"


@query("r13_stamp_outcomes", f"""SELECT id, attempts + CASE WHEN {OUTCOMES} <> 'failed' AND id % 2 = 0 THEN 1 ELSE 0 END AS attempts, is_gone OR
      ({OUTCOMES} = 'gone' AND id % 2 = 0) AS is_gone FROM {{v_target}}""")
def _(v: Views) -> DataFrame:
    outcomes = v["v_target"].filter("id % 2 = 0").select("id", F.expr(OUTCOMES).alias("outcome"))
    return incremental.stamp_outcomes(v["v_target"], outcomes).select("id", "attempts", "is_gone")


@query("t6_stalest_items", "SELECT item_type, item_id FROM {v_item} ORDER BY last_synced_on NULLS FIRST, item_type, item_id LIMIT 50")
def _(v: Views) -> DataFrame:
    return incremental.stalest_items(v["v_item"], 50).select(*ITEM)


@query("u3_known_source_ids", "SELECT item_type, source, external_id FROM {v_external_id} UNION SELECT item_type, source, external_id FROM {v_target}")
def _(v: Views) -> DataFrame:
    return incremental.known_source_ids(v["v_external_id"], v["v_target"])


@query("u4_appeared_ids", "SELECT id, popularity FROM {v_export_b} WHERE id NOT IN (SELECT id FROM {v_export_a}) AND id % 5 <> 0 AND NOT adult AND NOT video")
def _(v: Views) -> DataFrame:
    return incremental.appeared_ids(v["v_export_b"], v["v_export_a"], v["v_export_b"].filter("id % 5 = 0")).select("id", "popularity")


@query("u5_new_works", "SELECT DISTINCT work_id FROM {v_edition} WHERE work_id NOT IN (SELECT work_id FROM {v_reading_log})")
def _(v: Views) -> DataFrame:
    return incremental.new_keys(v["v_edition"], v["v_reading_log"], ["work_id"])


@query("u6_catalogued", "SELECT id FROM {v_target} t WHERE EXISTS (SELECT 1 FROM {v_external_id} x WHERE x.item_type = t.item_type AND x.source = t.source AND x.external_id = t.external_id)")
def _(v: Views) -> DataFrame:
    return incremental.catalogued(v["v_target"], v["v_external_id"]).select("id")


@query("j13_credit_gaps", """SELECT item_type, item_id, EXISTS (SELECT 1 FROM {v_external_id} x WHERE x.item_type = i.item_type AND x.item_id =
      i.item_id) AS linked FROM {v_item} i WHERE NOT EXISTS (SELECT 1 FROM {v_credit} c WHERE c.item_type = i.item_type AND c.item_id = i.item_id AND
      c.person_id % 5 = 0) AND NOT EXISTS (SELECT 1 FROM {v_cast} c WHERE c.item_type = i.item_type AND c.item_id = i.item_id AND c.billing = 2)""")
def _(v: Views) -> DataFrame:
    crew = v["v_credit"].filter("person_id % 5 = 0")
    return incremental.credit_gaps(v["v_item"], crew, v["v_cast"].filter("billing = 2"), v["v_external_id"]).select(*ITEM, "linked")


#: Landed titles of every kind of verdict.
LANDED = """SELECT part_id AS id, CASE WHEN part_id % 37 = 0 THEN '' ELSE title END AS title, part_id % 41 = 0 AS adult, part_id % 43 = 0 AS video,
      CASE part_id % 13 WHEN 0 THEN 'Rumored' WHEN 1 THEN 'Canceled' WHEN 2 THEN 'Planned' ELSE 'Released' END AS status,
  CASE WHEN part_id % 17 = 0 THEN 'soon' WHEN part_id % 19 = 1 THEN NULL ELSE CAST(date '2022-06-01' + CAST(part_id * 7 % 1100 AS INT) AS STRING) END
      AS release_date, CASE WHEN part_id % 4 = 0 THEN '' ELSE 'p' END AS poster, overview FROM {v_item}"""

VERDICT = f"""v AS (SELECT id, CASE WHEN title = '' THEN 'no_title' WHEN adult THEN 'adult' WHEN video THEN 'video' WHEN status IN ('Rumored',
      'Canceled') THEN concat('status:', status) WHEN release_date IS NULL THEN 'no_release_date'
  WHEN try_cast(release_date AS DATE) IS NULL THEN 'unparseable_release_date' WHEN try_cast(release_date AS DATE) < date '2024-01-31' - 90 THEN
      'too_old' WHEN try_cast(release_date AS DATE) > date '2024-01-31' + 180 THEN 'too_far_ahead'
  WHEN poster = '' AND overview IS NULL THEN 'no_poster_or_overview' ELSE 'admitted' END AS verdict FROM ({LANDED}))"""


def verdicts(v: Views) -> DataFrame:
    landed = v.spark.sql(LANDED, v_item=v["v_item"])
    return landed.select("id", incremental.release_verdict("2024-01-31").alias("verdict"))


@query("p6_release_gate", f"WITH {VERDICT} SELECT * FROM v")
def _(v: Views) -> DataFrame:
    return verdicts(v)


@query("a18_gate_report", f"WITH {VERDICT} SELECT verdict, count(*) AS n FROM v GROUP BY verdict")
def _(v: Views) -> DataFrame:
    return incremental.gate_report(verdicts(v))


BATCHES = """SELECT 'TMDB' AS source, event_type AS kind, CASE user_id % 3 WHEN 0 THEN 'MOVIE' WHEN 1 THEN 'SERIES' ELSE 'GAME' END AS item_type, day
      AS begin_at, day + 1 AS end_at, min(event_id) % 9 <> 0 AS succeeded FROM (SELECT *, CAST(extract(day FROM ts) AS BIGINT) AS day FROM {events}) q
      GROUP BY 2, 3, 4, 5"""
CURSORS = "SELECT DISTINCT 'TMDB' AS source, event_type AS kind, 'MOVIE' AS item_type, CAST(3 AS BIGINT) AS cursor FROM {events}"


@query(
    "r7_advance_cursors",
    f"""WITH b AS ({BATCHES}), c AS ({CURSORS}), r AS (SELECT b.*, c.cursor FROM b LEFT JOIN c USING (source, kind, item_type) WHERE cursor IS NULL OR end_at > cursor),
    p AS (SELECT *, coalesce(lag(end_at) OVER (PARTITION BY source, kind, item_type ORDER BY begin_at, end_at), cursor, begin_at) AS previous FROM r),
    k AS (SELECT *, min(CASE WHEN succeeded AND begin_at <= previous THEN 1 ELSE 0 END) OVER (PARTITION BY source, kind, item_type ORDER BY begin_at, end_at) AS ok FROM p),
    m AS (SELECT source, kind, item_type, max(end_at) AS moved FROM k WHERE ok = 1 GROUP BY ALL)
    SELECT source, kind, item_type, coalesce(moved, cursor) AS cursor FROM c FULL JOIN m USING (source, kind, item_type)""",
)
def _(v: Views) -> DataFrame:
    batches, cursors = v.spark.sql(BATCHES, events=v["events"]), v.spark.sql(CURSORS, events=v["events"])
    return incremental.advance_cursors(batches, cursors)


@query(
    "r8_coverage_gaps",
    """WITH l AS (SELECT DISTINCT event_type AS source, CAST(ts AS DATE) AS day FROM {events} WHERE event_id % 211 = 0), c AS (SELECT DISTINCT event_type AS source FROM {events}),
    d AS (SELECT source, CAST(unnest(generate_series(date '2024-01-03', date '2024-01-31', interval 1 day)) AS DATE) AS day FROM c),
    m AS (SELECT source, day, day < date '2024-01-17' AS lost FROM d ANTI JOIN l USING (source, day)),
    i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY source, lost ORDER BY day) AS INTEGER) AS island FROM m)
    SELECT source, lost, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS n_days FROM i GROUP BY source, lost, island""",
)
def _(v: Views) -> DataFrame:
    landed = v["events"].filter("event_id % 211 = 0").select(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).distinct()
    cursors = v["events"].select(F.col("event_type").alias("source")).distinct().withColumn("cursor_day", F.lit("2024-01-02").cast("date"))
    gaps = incremental.coverage_gaps(landed, cursors, "2024-01-31")
    return gaps.select("source", "lost", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n_days")


#: Answers of a knowledge base: none, one or two ids for an item.
BINDINGS = """SELECT item_type, item_id, CASE WHEN part_id % 6 = 0 THEN NULL ELSE concat('Q', CAST(1 + part_id % 1500 AS STRING)) END AS qid FROM
      {v_item} UNION ALL SELECT item_type, item_id, concat('Q', CAST(100000 + part_id AS STRING)) AS qid FROM {v_item} WHERE part_id % 25 = 0"""
HELD = """SELECT item_type, min(item_id) AS item_id, qid FROM (SELECT item_type, item_id, concat('Q', CAST(1 + part_id % 1500 AS STRING)) AS qid FROM
      {v_item} WHERE part_id % 4 < 3) q GROUP BY item_type, qid"""
ANCHORS = f"""ai AS (SELECT item_type, item_id, count(DISTINCT qid) AS n, min(qid) AS qid FROM ({BINDINGS}) GROUP BY ALL),
 an AS (SELECT ai.item_type, ai.item_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN h.item_id <> ai.item_id THEN 'unlinked' ELSE
      'linked' END AS outcome, ai.qid AS q FROM ai LEFT JOIN ({HELD}) h ON h.item_type = ai.item_type AND h.qid = ai.qid)"""


def anchors(v: Views) -> DataFrame:
    return incremental.anchor_items(v.spark.sql(BINDINGS, v_item=v["v_item"]), v.spark.sql(HELD, v_item=v["v_item"]))


@query("l1_anchor_items", f"WITH {ANCHORS} SELECT item_type, item_id, outcome, CASE WHEN outcome = 'linked' THEN q END AS qid FROM an")
def _(v: Views) -> DataFrame:
    return anchors(v)


@query(
    "a9_anchor_coverage",
    f"""WITH {ANCHORS} SELECT i.item_type, count(*) AS n_items, count(x.item_id) AS linked, count(an.item_id) AS anchored,
      round(coalesce(count(an.item_id) / nullif(count(x.item_id), 0), 0), 6) AS ratio
    FROM {{v_item}} i LEFT JOIN {{v_external_id}} x USING (item_type, item_id) LEFT JOIN an ON an.item_type = i.item_type AND an.item_id = i.item_id AND an.outcome = 'linked' GROUP BY i.item_type""",
)
def _(v: Views) -> DataFrame:
    return incremental.anchor_coverage(v["v_item"], v["v_external_id"], anchors(v).filter("outcome = 'linked'"))


STATEMENTS = """SELECT concat('Q', CAST(1 + part_id % 1500 AS STRING)) AS from_qid, concat('Q', CAST(1 + part_id * 7 % 1500 AS STRING)) AS to_qid,
      'ADAPTATION' AS relation FROM {v_item} WHERE part_id % 3 = 1"""


@query(
    "l2_relation_edges",
    f"""WITH {ANCHORS}, s AS ({STATEMENTS}), k AS (SELECT item_type, item_id, q FROM an WHERE outcome = 'linked')
    SELECT DISTINCT a.item_type AS from_type, a.item_id AS from_id, b.item_type AS to_type, b.item_id AS to_id, relation, 'WIKIDATA' AS source, CAST(1.0 AS DOUBLE) AS score
    FROM s JOIN k a ON a.q = from_qid JOIN k b ON b.q = to_qid WHERE a.item_type <> b.item_type OR a.item_id <> b.item_id""",
)
def _(v: Views) -> DataFrame:
    edges = incremental.relation_edges(v.spark.sql(STATEMENTS, v_item=v["v_item"]), anchors(v).filter("outcome = 'linked'"))
    return edges.withColumn("score", F.col("score").cast("double"))


@query("l3_delete_layer", "SELECT * FROM {v_relation} WHERE source <> 'MODEL'")
def _(v: Views) -> DataFrame:
    return incremental.delete_layer(v["v_relation"], "MODEL")


@query("a11_relation_counts", "SELECT source, relation, count(*) AS n_edges FROM {v_relation} GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return incremental.relation_counts(v["v_relation"])


@query("j17_resolve_qids", f"WITH {ANCHORS}, s AS ({STATEMENTS}) SELECT from_qid, item_type, item_id FROM s JOIN an ON an.q = from_qid AND outcome = 'linked'")
def _(v: Views) -> DataFrame:
    return incremental.resolve_qids(v.spark.sql(STATEMENTS, v_item=v["v_item"]), anchors(v), "from_qid").select("from_qid", *ITEM)


#: Every purchase as a change of one rating a user and item: some clear it.
CHANGES = """SELECT min(event_id) OVER (PARTITION BY user_id, item_type, item_id) AS rating_id, user_id, item_type, item_id, CASE WHEN event_id % 3 =
      0 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) END AS score, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'text' END AS review_text, ts, event_id AS
      change_id FROM {v_act} WHERE event_type = 'purchase'"""


@query(
    "r1_rating_events",
    f"""WITH c AS ({CHANGES}), s AS (SELECT *, score IS NOT NULL OR review_text IS NOT NULL AS says FROM c),
    k AS (SELECT *, sum(CASE WHEN says THEN 0 ELSE 1 END) OVER (PARTITION BY rating_id ORDER BY ts, change_id) AS stretch, sum(CASE WHEN says THEN 0
      ELSE 1 END) OVER (PARTITION BY rating_id) AS stretches FROM s)
    SELECT rating_id, user_id, item_type, item_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM k WHERE says AND stretch = stretches QUALIFY
      row_number() OVER (PARTITION BY rating_id ORDER BY ts, change_id) = 1""",
)
def _(v: Views) -> DataFrame:
    from marquee.operators.community import rating_events

    found = rating_events(v.spark.sql(CHANGES, v_act=v["v_act"]))
    return found.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


STATES = """SELECT event_id, user_id, item_type, item_id, ts, CASE event_type WHEN 'view' THEN 'want' WHEN 'click' THEN 'in_progress' WHEN 'error'
      THEN 'dropped' ELSE 'completed' END AS status FROM {v_act} WHERE event_type <> 'purchase'"""


@query("r2_completion_events", f"""SELECT event_id, user_id, item_type, item_id FROM (SELECT *, lag(status) OVER (PARTITION BY user_id, item_type,
      item_id ORDER BY ts, event_id) AS before FROM ({STATES})) WHERE status = 'completed' AND before IS DISTINCT FROM 'completed'""")
def _(v: Views) -> DataFrame:
    from marquee.streaming.events import completions

    return completions(v.spark.sql(STATES, v_act=v["v_act"])).select("event_id", "user_id", *ITEM)


COOCCURRENCE = """WITH w AS (SELECT user_id, item_type, item_id FROM {v_library} UNION SELECT user_id, item_type, item_id FROM {v_rating}), n AS
      (SELECT user_id, 1 / ln(1 + count(*)) AS w FROM w GROUP BY user_id), c AS (SELECT * FROM w JOIN n USING (user_id)),
    m AS (SELECT item_type, item_id, sqrt(sum(w * w)) AS norm FROM c GROUP BY ALL),
    d AS (SELECT a.item_type, a.item_id, b.item_type AS other_type, b.item_id AS other_id, sum(a.w * b.w) AS dot FROM c a JOIN c b USING (user_id)
      WHERE a.item_type <> b.item_type OR a.item_id <> b.item_id GROUP BY ALL)
    SELECT d.item_type, d.item_id, other_type, other_id, round(dot / m.norm / o.norm, 6) AS score, row_number() OVER (PARTITION BY d.item_type,
      d.item_id ORDER BY round(dot / m.norm / o.norm, 6) DESC, other_type, other_id) AS place
    FROM d JOIN m USING (item_type, item_id) JOIN m o ON o.item_type = other_type AND o.item_id = other_id QUALIFY place <= 20"""


@query("c10_cooccurrence", COOCCURRENCE)
def _(v: Views) -> DataFrame:
    return recommend.cooccurrence(v["v_library"], v["v_rating"])


@query("c10_cooccurrence_pruned", COOCCURRENCE)
def _(v: Views) -> DataFrame:
    return recommend.cooccurrence_pruned(v["v_library"], v["v_rating"], light=50)


@query("f5_decay", f"SELECT event_id, round(pow(0.5, (epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 1e6 / 21600.0), 9) AS weight FROM {{events}}")
def _(v: Views) -> DataFrame:
    return v["events"].select("event_id", F.round(fn.decay(F.col("ts"), NOW, 21600), 9).alias("weight"))


@query("f3_slug_parts", """SELECT slug, regexp_replace(slug, '-[0-9][0-9][0-9][0-9]$', '') AS title, try_cast(nullif(regexp_extract(slug,
      '-([0-9][0-9][0-9][0-9])$', 1), '') AS INTEGER) AS year FROM (SELECT concat(slug, '-', CAST(year(release_date) AS VARCHAR)) AS slug FROM
      {v_item} WHERE release_date IS NOT NULL)""")
def _(v: Views) -> DataFrame:
    slugs = v["v_item"].filter("release_date is not null").select(F.concat_ws("-", "slug", F.year("release_date").cast("string")).alias("slug"))
    return slugs.select("slug", fn.title_from_slug(F.col("slug")).alias("title"), fn.year_from_slug(F.col("slug")).alias("year"))


@query("f8_publish_year", "SELECT work_id, pos, CAST(substr(publish_date, 1, 4) AS INTEGER) AS year FROM {v_edition}")
def _(v: Views) -> DataFrame:
    return v["v_edition"].select("work_id", "pos", fn.publish_year(F.concat(F.lit("pub. 123456 in "), "publish_date")).alias("year"))
