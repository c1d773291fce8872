"""Catalog and community tables derived from the driver's tables, the same for Spark and for DuckDB.

Each view is one SELECT in the SQL that both engines share. ``IDIV(a, b)`` stands for whole-number division and
``JSONK(x)`` for the field k of a JSON text; ``{name}`` is a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from marquee.functions.columns import ITEM
from marquee.operators.community import likes_of_items

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
NOW = "2024-01-31 00:00:00"
TYPES = ("MOVIE", "SERIES", "BOOK", "GAME")


def type_of(number: str) -> str:
    return f"CASE {number} % 4 WHEN 0 THEN 'MOVIE' WHEN 1 THEN 'SERIES' WHEN 2 THEN 'BOOK' ELSE 'GAME' END"


VIEWS: dict[str, str] = {
    "v_user": """SELECT user_id, concat('u', CAST(user_id AS STRING)) AS username, concat('User ', CAST(user_id AS STRING)) AS display_name,
      concat('u', CAST(user_id AS STRING), '@mail.test') AS email, user_id % 17 = 0 AS is_banned, user_id % 29 = 1 AS is_admin FROM (SELECT DISTINCT
      user_id FROM {events}) q""",
    "v_item": f"""SELECT {type_of('p_partkey')} AS item_type, IDIV(p_partkey, 4) AS item_id, p_partkey AS part_id, p_name AS title, p_name AS original_title,
        concat(replace(p_name, ' ', '-'), '-', CAST(IDIV(p_partkey, 4) AS STRING)) AS slug,
        CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE date '1990-01-01' + CAST(p_partkey * 11 % 12000 AS INT) END AS release_date,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey * 37 % 101 AS DOUBLE) / 10 END AS rating_external,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1 + CAST(p_partkey * 13 % 9 AS DOUBLE) / 2 END AS rating_internal,
        p_partkey * 29 % 1000 AS rating_count_external,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(p_type, ' ', p_brand) END AS overview,
        p_partkey % 19 = 0 AS title_locked, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE date '2023-01-01' + CAST(p_partkey % 365 AS INT) END AS last_synced_on
        FROM {{part}}""",
    "v_item_genre": f"""SELECT {type_of('p_partkey')} AS item_type, IDIV(p_partkey, 4) AS item_id, lower(replace(p_brand, '#', '-')) AS genre FROM {{part}}
        UNION ALL SELECT {type_of('p_partkey')} AS item_type, IDIV(p_partkey, 4) AS item_id, lower(p_type) AS genre FROM {{part}}""",
    "v_act": f"""SELECT event_id, user_id, event_type, ts, {type_of('k')} AS item_type, IDIV(k, 4) + CASE WHEN k >= 96 THEN 1000000 ELSE 0 END AS
      item_id FROM (SELECT event_id, user_id, event_type, ts, CAST(JSONK(props) AS BIGINT) AS k FROM {{events}}) q""",
    "v_rating": """SELECT id, user_id, item_type, item_id, CASE WHEN last_id % 11 = 0 THEN NULL ELSE 1 + CAST(last_id % 9 AS DOUBLE) / 2 END AS score,
        CASE WHEN last_id % 5 = 0 THEN NULL ELSE concat('review ', CAST(id AS STRING)) END AS review_text, id % 13 = 0 AS is_hidden, created_at, updated_at
        FROM (SELECT user_id, item_type, item_id, min(event_id) AS id, max(event_id) AS last_id, min(ts) AS created_at, max(ts) AS updated_at FROM
      {v_act} WHERE event_type = 'purchase' GROUP BY user_id, item_type, item_id) q""",
    "v_event": """SELECT id, user_id, 'rating_created' AS event_type, item_type, item_id, id AS rating_id, created_at FROM {v_rating} WHERE score IS NOT NULL OR review_text IS NOT NULL
        UNION ALL SELECT event_id AS id, user_id, 'status_completed' AS event_type, item_type, item_id, NULL AS rating_id, ts AS created_at FROM {v_act} WHERE event_type = 'signup'""",
    "v_library": """SELECT event_id AS id, user_id, item_type, item_id, CASE event_type WHEN 'view' THEN 'want' WHEN 'click' THEN 'in_progress' WHEN
      'error' THEN 'dropped' ELSE 'completed' END AS status, created_at, ts AS updated_at
        FROM (SELECT *, min(ts) OVER (PARTITION BY user_id, item_type, item_id) AS created_at, row_number() OVER (PARTITION BY user_id, item_type,
      item_id ORDER BY ts DESC, event_id DESC) AS rn FROM {v_act} WHERE event_type <> 'purchase') q WHERE rn = 1""",
    "v_like": """SELECT DISTINCT a.user_id, r.id AS rating_id FROM {v_act} a JOIN {v_rating} r ON a.item_type = r.item_type AND a.item_id = r.item_id
      WHERE a.event_type = 'click' AND a.event_id % 5 = 0 AND a.user_id <> r.user_id""",
    "v_fan": "SELECT DISTINCT user_id, item_type, item_id FROM {v_act} WHERE event_type = 'click' AND event_id % 5 = 0",
    "v_follow": """SELECT DISTINCT a.user_id AS follower_id, b.user_id AS followed_id, date '2024-01-01' + CAST((a.user_id * 3 + b.user_id) % 30 AS INT) AS followed_on
        FROM (SELECT user_id, (user_id * 7 + 3) % (SELECT max(user_id) + 1 FROM {v_user}) AS target FROM {v_user}
              UNION ALL SELECT user_id, (user_id * 11 + 5) % (SELECT max(user_id) + 1 FROM {v_user}) AS target FROM {v_user}) a
        JOIN {v_user} b ON b.user_id = a.target WHERE a.user_id <> b.user_id""",
    "v_person": "SELECT s_suppkey AS person_id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug FROM {supplier}",
    "v_credit": f"""SELECT item_type, item_id, person_id, role, min(day) AS created_at FROM (SELECT {type_of('l_partkey')} AS item_type,
      IDIV(l_partkey, 4) AS item_id, l_suppkey AS person_id, CAST(l_shipdate AS DATE) AS day,
        CASE l_linenumber % 5 WHEN 0 THEN 'DIRECTOR' WHEN 1 THEN 'CREATOR' WHEN 2 THEN 'WRITER' WHEN 3 THEN 'AUTHOR' ELSE 'SOURCE_AUTHOR' END AS role
      FROM {{lineitem}}) q GROUP BY item_type, item_id, person_id, role""",
    "v_cast": f"""SELECT {type_of('l_partkey')} AS item_type, IDIV(l_partkey, 4) AS item_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS pos, l_suppkey AS person_id, s_name AS name,
        CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_returnflag END AS character_name, CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE l_linenumber END AS billing
        FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "v_company": "SELECT n_nationkey AS company_id, n_name AS name, lower(n_name) AS slug FROM {nation}",
    "v_company_credit": f"""SELECT DISTINCT 'GAME' AS item_type, IDIV(l_partkey, 4) AS item_id, s_nationkey AS company_id, CASE l_linenumber % 2 WHEN 0 THEN 'DEVELOPER' ELSE 'PUBLISHER' END AS role
        FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey WHERE l_partkey % 4 = 3""",
    "v_batch_person": """SELECT l_orderkey * 10 + l_linenumber AS pos, 'TMDB' AS source, CAST(l_suppkey + 1000 * (l_orderkey % 2) AS STRING) AS
      external_id, concat('supplier-', CAST(l_suppkey AS STRING)) AS slug, concat('Name ', CAST(l_suppkey AS STRING)) AS name FROM {lineitem} WHERE
      l_orderkey % 7 = 0""",
    "v_external_id": f"""SELECT {type_of('p_partkey')} AS item_type, IDIV(p_partkey, 4) AS item_id, CASE p_partkey % 4 WHEN 2 THEN 'OPENLIBRARY' WHEN
      3 THEN 'IGDB' ELSE 'TMDB' END AS source, CAST(p_partkey AS STRING) AS external_id
        FROM {{part}} WHERE p_partkey % 9 <> 0""",
    "v_target": f"""SELECT id, {type_of('id')} AS item_type, CASE id % 4 WHEN 2 THEN 'OPENLIBRARY' WHEN 3 THEN 'IGDB' ELSE 'TMDB' END AS source, CAST(id AS STRING) AS external_id,
        CASE WHEN id % 8 = 0 THEN NULL ELSE id * 7 % 500 END AS vote_count, id % 5 AS attempts, id % 31 = 0 AS is_gone
        FROM (SELECT p_partkey AS id FROM {{part}} UNION ALL SELECT p_partkey + (SELECT count(*) FROM {{part}}) AS id FROM {{part}} WHERE p_partkey * 5 < (SELECT count(*) FROM {{part}})) q""",
    "v_embedding": f"SELECT {type_of('label')} AS item_type, vec_id AS item_id, embedding FROM {{embeddings}}",
    "v_edition": """SELECT concat('OL', CAST(l_orderkey % 2000 AS STRING), 'W') AS work_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS
      pos, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity * 10 AS INT) END AS pages,
        CAST(CAST(l_shipdate AS DATE) AS STRING) AS publish_date, CASE l_returnflag WHEN 'A' THEN 'eng' WHEN 'N' THEN 'spa' ELSE 'ger' END AS language,
        CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('978', CAST(l_partkey AS STRING)) END AS isbn_13, concat('0', CAST(l_partkey AS STRING)) AS
      isbn_10, CASE WHEN l_partkey % 4 = 0 THEN -1 ELSE l_partkey END AS cover,
        CASE (l_orderkey % 2000 % 11) + l_partkey % 3 WHEN 0 THEN 'PS-3568.00000000.O243' WHEN 1 THEN ' ps 3552' WHEN 2 THEN 'PZ-0007.00000000.R79'
      WHEN 3 THEN 'PZ-0004.50' WHEN 4 THEN 'QA-0076' WHEN 5 THEN 'BC-0001' WHEN 6 THEN 'BD-0002' WHEN 7 THEN 'HDX 30' WHEN 8 THEN '??' WHEN 9 THEN
      'IX-1' ELSE NULL END AS lcc,
        CASE (l_orderkey % 2000 % 13) + l_partkey % 2 WHEN 0 THEN '821.1' WHEN 1 THEN '813/.54' WHEN 2 THEN '803' WHEN 3 THEN '[Fic]' WHEN 4 THEN
      'j824' WHEN 5 THEN '158.1' WHEN 6 THEN '641.5' WHEN 7 THEN '92 B' WHEN 8 THEN '0.05' WHEN 9 THEN '817' WHEN 10 THEN '[E] 3' ELSE NULL END AS ddc
      FROM {lineitem}""",
    "v_work": """SELECT work_id, n, CASE WHEN n % 17 = 0 THEN '' ELSE concat(' Work ', CAST(n AS STRING)) END AS title, CASE n % 5 WHEN 0 THEN
      'Fiction' WHEN 1 THEN ' Military  HISTORY' WHEN 2 THEN 'Young Adult Fiction' WHEN 3 THEN 'unheard of' ELSE 'cooking' END AS subject,
        CASE WHEN n % 4 = 0 THEN n + 7 ELSE -1 END AS cover, CASE WHEN n % 6 = 0 THEN NULL ELSE concat('About ', CAST(n AS STRING)) END AS
      description, concat('OL', CAST(n % 50 AS STRING), 'A') AS first_author, concat('OL', CAST(n % 7 AS STRING), 'A') AS second_author
        FROM (SELECT DISTINCT concat('OL', CAST(l_orderkey % 2000 AS STRING), 'W') AS work_id, l_orderkey % 2000 AS n FROM {lineitem}) q""",
    "v_author": """SELECT DISTINCT concat('OL', CAST(p_partkey % 50 AS STRING), 'A') AS author_id, CASE WHEN p_partkey % 50 % 10 = 9 THEN ' ' ELSE
      concat('Author ', CAST(p_partkey % 50 AS STRING)) END AS name FROM {part}""",
    "v_reading_log": "SELECT concat('OL', CAST(o_custkey % 2000 AS STRING), 'W') AS work_id, o_orderkey AS pos FROM {orders}",
    "v_export_a": "SELECT p_partkey AS id, p_name AS title, p_retailprice AS popularity, p_partkey % 41 = 0 AS adult, p_partkey % 43 = 0 AS video FROM {part} WHERE p_partkey % 11 <> 0",
    "v_export_b": "SELECT p_partkey AS id, p_name AS title, p_retailprice AS popularity, p_partkey % 41 = 0 AS adult, p_partkey % 43 = 0 AS video FROM {part}",
    "v_relation": f"""SELECT {type_of('f')} AS from_type, IDIV(f, 4) AS from_id, {type_of('t')} AS to_type, IDIV(t, 4) AS to_id, CASE f % 3 WHEN 0
      THEN 'ADAPTATION' WHEN 1 THEN 'DERIVATIVE' ELSE 'COOCCURRENCE' END AS relation,
        CASE f % 2 WHEN 0 THEN 'WIKIDATA' ELSE 'MODEL' END AS source, CAST(1 + f % 4 AS DOUBLE) AS score
        FROM (SELECT p_partkey AS f, (p_partkey * 3 + 1) % (SELECT count(*) FROM {{part}}) AS t FROM {{part}}
              UNION ALL SELECT (p_partkey * 3 + 1) % (SELECT count(*) FROM {{part}}) AS f, p_partkey AS t FROM {{part}} WHERE p_partkey % 10 = 0) q""",
    "v_batch": f"""SELECT p_partkey AS pos, {type_of('p_partkey')} AS item_type, IDIV(p_partkey, 4) AS item_id, concat(p_name, ' II') AS title, CASE
      WHEN p_partkey % 77 = 1 THEN NULL ELSE concat('n-', CAST(p_partkey AS STRING)) END AS slug, p_retailprice AS rating_external
        FROM {{part}} WHERE p_partkey % 10 < 3
        UNION ALL SELECT p_partkey + 10000000 AS pos, {type_of('p_partkey')} AS item_type, IDIV(p_partkey, 4) AS item_id, concat(p_name, ' III') AS
      title, concat('m-', CAST(p_partkey AS STRING)) AS slug, p_retailprice AS rating_external FROM {{part}} WHERE p_partkey % 50 = 0
        UNION ALL SELECT p_partkey + 20000000 AS pos, {type_of('p_partkey')} AS item_type, IDIV(p_partkey, 4) + 5000000 AS item_id, CASE WHEN
      p_partkey % 40 = 3 THEN repeat('x', 501) ELSE p_name END AS title, concat('x-', CAST(p_partkey AS STRING)) AS slug, p_retailprice AS
      rating_external FROM {{part}} WHERE p_partkey % 20 = 3""",
}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Views:
    """The views over one data folder as DataFrames, each built once: ``Views(spark, dir)["v_item"]``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.known:
            self.known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in TABLES else self._likes() if name == "v_like" else self._made(VIEWS[name])
        return self.known[name]

    def _likes(self) -> DataFrame:
        """v_like as its SQL has it: made distinct before the join, as its rows are the square of an item's events (event_id is a key)."""
        return likes_of_items(self["v_fan"], self["v_rating"].select("id", "user_id", *ITEM), ["user_id", "rating_id"])

    def _made(self, sql: str) -> DataFrame:
        text = re.sub(r"IDIV\(([^,()]+), ([^,()]+)\)", r"(\1 div \2)", sql).replace("JSONK(props)", "get_json_object(props, '$.k')")
        return self.spark.sql(text, **{n: self[n] for n in names_in(sql)})


def oracle(sql: str) -> str:
    """The SQL with the views that it names as ``{view}`` in front, for DuckDB."""
    needed: list[str] = []

    def add(text: str) -> None:
        for n in names_in(text):
            if n in VIEWS and n not in needed:
                add(VIEWS[n])
                needed.append(n)

    add(sql)

    def plain(text: str) -> str:
        text = re.sub(r"IDIV\(([^,()]+), ([^,()]+)\)", r"(\1 // \2)", text).replace("JSONK(props)", "json_extract_string(props, '$.k')").replace("AS STRING)", "AS VARCHAR)")
        return re.sub(r"\{(\w+)\}", r"\1", text)

    head = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in needed)
    body = plain(sql).strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
