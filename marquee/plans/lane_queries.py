"""Registered queries of the lanes, tables and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM
from marquee.operators import catalog, lanes, recommend, similarity
from marquee.plans.batch_queries import EDITIONS, LANDED, LOW, VERDICT, editions
from marquee.plans.bindings import Views
from marquee.plans.catalog_queries import query
from marquee.sources import landed, tables

APPEARED = "id NOT IN (SELECT id FROM {v_export_a}) AND id % 5 <> 0 AND NOT adult AND NOT video"


def release_verdicts(v: Views) -> DataFrame:
    details = v.spark.sql(LANDED, v_item=v["v_item"])
    known = v["v_export_b"].filter("id % 5 = 0")
    return lanes.new_releases(v["v_export_b"], v["v_export_a"], known, details, "2024-01-31")


@query("r9_new_releases", f"WITH {VERDICT} SELECT id, verdict FROM v WHERE id IN (SELECT id FROM {{v_export_b}} WHERE {APPEARED})")
def _(v: Views) -> DataFrame:
    return release_verdicts(v).select("id", "verdict")


@query(
    "r9_new_release_lane",
    f"""WITH {VERDICT}, a AS (SELECT 'MOVIE' AS item_type, id + 7000000 AS item_id, l.title FROM v JOIN ({LANDED}) l USING (id) WHERE verdict =
      'admitted' AND id IN (SELECT id FROM {{v_export_b}} WHERE {APPEARED}))
    SELECT item_type, item_id, title, 'kept' AS outcome FROM {{v_item}} UNION ALL SELECT item_type, item_id, title, 'created' FROM a""",
)
def _(v: Views) -> DataFrame:
    rows = release_verdicts(v).select(F.lit("MOVIE").alias("item_type"), (F.col("id") + 7000000).alias("item_id"), F.lit(0).alias("pos"), "title", "verdict")
    return lanes.new_release_lane(v["v_item"].select(*ITEM, "title"), rows, ["title"]).select(*ITEM, "title", "outcome")


@query(
    "r10_change_lane",
    """SELECT i.item_type, i.item_id, CASE WHEN x.external_id IS NOT NULL AND i.part_id % 4 = 1 AND NOT i.title_locked THEN concat('changed ',
      x.external_id) ELSE i.title END AS title FROM {v_item} i LEFT JOIN {v_external_id} x ON x.item_type = i.item_type AND x.item_id = i.item_id""",
)
def _(v: Views) -> DataFrame:
    changed = v["v_target"].filter("id % 4 = 1").select("item_type", "source", "external_id")
    details = changed.withColumn("title", F.concat(F.lit("changed "), "external_id"))
    return lanes.change_lane(v["v_item"], changed, v["v_external_id"], details, ["title"], {"title": "title_locked"}).select(*ITEM, "title")


@query("r11_since_cursor", """WITH l AS (SELECT event_id, ts FROM {events} WHERE ts > timestamp '2024-01-10 00:00:00'), e AS (SELECT max(ts) AS edge
      FROM (SELECT ts FROM l ORDER BY ts, event_id LIMIT 200)) SELECT event_id FROM l, e WHERE ts <= edge""")
def _(v: Views) -> DataFrame:
    rows = v["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    return lanes.game_lane(rows, "ts", "2024-01-10 00:00:00", "2024-01-31", "event_id", 200)[0].select("event_id")


@query(
    "r12_promotion_lane",
    """WITH e AS (SELECT item_type, source, external_id, max(item_id % 77) AS votes FROM {v_external_id} WHERE item_id % 2 = 0 GROUP BY ALL UNION ALL
      SELECT 'BOOK', 'OPENLIBRARY', concat('new', CAST(item_id AS VARCHAR)), 5 FROM {v_external_id} WHERE item_type = 'GAME')
    SELECT item_type, source, external_id, coalesce(votes, vote_count) AS vote_count, coalesce(attempts, 0) AS attempts, coalesce(is_gone, false) AS
      is_gone FROM {v_target} FULL JOIN e USING (item_type, source, external_id)""",
)
def _(v: Views) -> DataFrame:
    x = v["v_external_id"]
    again = x.filter("item_id % 2 = 0").select("item_type", "source", "external_id", (F.col("item_id") % 77).alias("vote_count"))
    new = x.filter("item_type = 'GAME'").select(F.lit("BOOK").alias("item_type"), F.lit("OPENLIBRARY").alias("source"), F.concat(F.lit("new"), F.col("item_id").cast("string")).alias("external_id"), F.lit(5).cast("long").alias("vote_count"))
    return lanes.promotion_lane(v["v_target"], again.unionByName(new))


@query(
    "r14_book_dump_diff",
    f"""WITH {EDITIONS} SELECT work_id FROM a JOIN w USING (work_id) WHERE ((list_contains(languages, 'eng') AND readers >= 3 AND editions >= 2 AND
      pages >= 100) OR (NOT list_contains(languages, 'eng') AND list_contains(languages, 'spa') AND readers >= 2 AND editions >= 2 AND pages >= 80))
    AND work_id NOT IN (SELECT work_id FROM {{v_edition}} WHERE cover % 3 = 1)""",
)
def _(v: Views) -> DataFrame:
    known = v["v_edition"].filter("cover % 3 = 1").select("work_id").distinct()
    return lanes.book_dump_diff(v["v_reading_log"], editions(v), known, LOW).select("work_id")


@query(
    "r14_book_dump_diff_few_known",
    f"""WITH {EDITIONS} SELECT work_id FROM a JOIN w USING (work_id) WHERE ((list_contains(languages, 'eng') AND readers >= 3 AND editions >= 2 AND
      pages >= 100) OR (NOT list_contains(languages, 'eng') AND list_contains(languages, 'spa') AND readers >= 2 AND editions >= 2 AND pages >= 80))
    AND work_id NOT IN (SELECT work_id FROM {{v_edition}} WHERE cover % 97 = 1)""",
)
def _(v: Views) -> DataFrame:
    known = v["v_edition"].filter("cover % 97 = 1").select("work_id").distinct()
    return lanes.book_dump_diff(v["v_reading_log"], editions(v), known, LOW).select("work_id")


@query("u1_union_types", "SELECT item_type, item_id, title, CAST(release_date AS VARCHAR) AS release_date FROM {v_item}")
def _(v: Views) -> DataFrame:
    by_type = {t: v["v_item"].filter(F.col("item_type") == t).select(F.col("item_id").alias("id"), "title", "slug", F.col("release_date").alias(d)) for t, d in tables.RELEASE_DATES.items()}
    return tables.union_types(by_type).select(*ITEM, "title", F.col("release_date").cast("string").alias("release_date"))


@query("j1_by_genre", "SELECT item_type, item_id, slug FROM {v_item} WHERE (item_type, item_id) IN (SELECT (item_type, item_id) FROM {v_item_genre} WHERE genre = 'small')")
def _(v: Views) -> DataFrame:
    return catalog.by_genre(v["v_item"], v["v_item_genre"], "small").select(*ITEM, "slug")


@query("w3_top_k_per_group", """SELECT item_type, item_id, row_number() OVER (PARTITION BY item_type ORDER BY rating_internal DESC NULLS LAST,
      rating_external DESC NULLS LAST, item_id) AS place FROM {v_item} QUALIFY place <= 7""")
def _(v: Views) -> DataFrame:
    return catalog.top_k_per_group(v["v_item"], ["item_type"], catalog.canonical_order(), 7).select(*ITEM, "place")


@query("s11_parse_bindings", """SELECT concat('Q', CAST(from_id + 1 AS VARCHAR)) AS from_qid, relation, concat('Q', CAST(to_id AS VARCHAR)) AS to_qid
      FROM {v_relation} WHERE relation <> 'COOCCURRENCE' AND to_id > 0""")
def _(v: Views) -> DataFrame:
    address = lambda kind, x: F.concat(F.lit(f"http://www.wikidata.org/{kind}/"), x)
    prop = F.when(F.col("relation") == "ADAPTATION", "P144").when(F.col("relation") == "DERIVATIVE", "P4969").otherwise("P31")
    rows = v["v_relation"].select(address("entity", F.concat(F.lit("Q"), (F.col("from_id") + 1).cast("string"))).alias("from"), address("prop/direct", prop).alias("prop"), address("entity", F.concat(F.lit("Q"), F.col("to_id").cast("string"))).alias("to"))
    return landed.parse_bindings(rows, {"P144": "ADAPTATION", "P4969": "DERIVATIVE"})


@query(
    "f22_seed_reasons",
    """WITH s AS (SELECT user_id, item_type, item_id, score AS w, 0 AS o FROM {v_rating} WHERE score >= 4 UNION ALL SELECT user_id, item_type,
      item_id, CASE status WHEN 'completed' THEN 4.0 ELSE 3.0 END, 1 FROM {v_library} WHERE status IN ('completed', 'want'))
    SELECT user_id, item_type, CASE o WHEN 0 THEN concat('Because you rated ', title) ELSE concat('Because ', title, ' is in your library') END AS
      reason FROM s JOIN {v_item} USING (item_type, item_id)
    QUALIFY row_number() OVER (PARTITION BY user_id, item_type ORDER BY w DESC, o, item_id) = 1""",
)
def _(v: Views) -> DataFrame:
    return recommend.seed_reasons(recommend.seeds(v["v_rating"], v["v_library"]).join(v["v_item"].select(*ITEM, "title"), ITEM))


@query(
    "f22_similar_reasons",
    """WITH s AS (SELECT a.item_type, a.item_id, b.item_type AS other_type, b.item_id AS other_id, round(list_cosine_similarity(CAST(a.embedding AS
      DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM {v_embedding} a, {v_embedding} b WHERE a.item_id % 20 = 0 AND (a.item_type <>
      b.item_type OR a.item_id <> b.item_id))
    SELECT item_type, item_id, other_type, other_id, CASE WHEN item_type = other_type THEN 'SEMANTIC' ELSE 'SEMANTIC_CROSS_TYPE' END AS kind FROM s
      QUALIFY row_number() OVER (PARTITION BY item_type, item_id ORDER BY score DESC, other_type, other_id) <= 5""",
)
def _(v: Views) -> DataFrame:
    page = similarity.knn(v["v_embedding"].filter("item_id % 20 = 0"), v["v_embedding"], 5)
    return recommend.similar_reasons(page).select(*ITEM, "other_type", "other_id", "kind")
