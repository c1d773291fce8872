"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a tree domain - language - source hold the documents. A token budget goes down from the root: each node
shares its budget among its children in proportion to their weights, a child gets no more than its subtree can supply,
and what a short child leaves over goes to its siblings. Since a node asks its parent only for what its own children
can't supply, a shortage is made good by siblings before ancestors. A leaf can supply its tokens ``max_epochs`` times.

A leaf's budget is filled from its documents in a seeded order, another order in each epoch: whole epochs first, then a
prefix of the last one; the document in which the budget ends is taken in part (``take_tokens``). To find the prefix
no leaf is ever sorted in one task: the order is by digest, documents are summed in ranges of digests, and only the range
in which the budget ends is looked at document by document.

Only DataFrame functions are used. Weights are whole numbers of any scale; a node without a stated weight weighs
``default_weight``, and with weight 0 a node gets nothing. Inputs: null language or source count as the empty text.
Documents without a word supply nothing and aren't selected. Rows that repeat an id are told apart by their text, and
rows alike in both are taken one after the other. An empty table gives an empty selection. Other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.common import cut, lookup, quoted, table

WORD = "[^\\x20\\x09-\\x0D]+"
LEVELS = ("domain", "lang", "source")
SEED = "mix-1"
MAX_EPOCHS = 4
#: Share of all tokens that the mixture is to have, in percent.
BUDGET_PERCENT = 60
#: A range of digests holds about so many documents of a leaf.
RANGE_ROWS = 500

#: Domains of the sources, by number of the source modulo 4; the mixture's production weights.
DOMAINS = ("web", "books", "code", "news")
WEIGHTS = {
    ("domain", "web"): 5,
    ("domain", "books"): 3,
    ("domain", "code"): 1,
    ("domain", "news"): 1,
    ("lang", "en"): 4,
    ("lang", "de"): 2,
    ("lang", "fr"): 2,
    ("lang", "es"): 2,
}
DEFAULT_WEIGHT = 1


def domain_of(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,6})$", 1).try_cast("int"), F.lit(0))
    return F.get(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS))


def weight_of(level: str, name: Column, weights: dict, default: int) -> Column:
    case = None
    for (at, value), w in weights.items():
        if at == level:
            case = (F if case is None else case).when(name == value, F.lit(w))
    return F.lit(default) if case is None else case.otherwise(F.lit(default))


def shares(parent: list, budget: Column, weight: Column, capacity: Column) -> Column:
    """Each child's part of its parent's budget, in whole tokens rounded down.

    Children are filled in order of capacity per weight. ``level`` is what a unit of weight would get if all children
    before were full; it rises up to the first child that isn't filled and falls from there, so its maximum is what a
    unit of weight gets."""
    order = Window.partitionBy(*parent).orderBy(capacity / weight, *LEVELS)
    rest = budget - F.coalesce(F.sum(capacity).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavier = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    return F.struct((rest / heavier).alias("level"), rest.alias("rest"), heavier.alias("weights"))


def budgets(leaves: DataFrame, total: int, weights: dict, default: int) -> DataFrame:
    """Leaves (domain, lang, source, tokens, docs, capacity) that get tokens, with their budget. As many rows as there are names."""
    nodes = leaves
    for n, level in enumerate(LEVELS, 1):
        nodes = nodes.withColumn(f"weight_{n}", weight_of(level, F.col(level), weights, default).cast("long")).filter(f"weight_{n} > 0")
    for n in range(1, len(LEVELS) + 1):
        nodes = nodes.withColumn(f"capacity_{n}", F.sum("capacity").over(Window.partitionBy(*LEVELS[:n])))
    nodes = nodes.withColumn("budget_0", F.least(F.lit(total), F.sum("capacity").over(Window.partitionBy(F.lit(0)))).cast("long"))
    for n in range(1, len(LEVELS) + 1):
        names, parent = LEVELS[:n], list(LEVELS[: n - 1]) or [F.lit(0)]
        children = nodes.groupBy(*names).agg(*(F.first(f"{c}").alias(c) for c in (f"budget_{n - 1}", f"capacity_{n}", f"weight_{n}")))
        padded = children.withColumns({x: F.lit("") for x in LEVELS[n:]})
        at = padded.withColumn("at", shares(parent, F.col(f"budget_{n - 1}"), F.col(f"weight_{n}"), F.col(f"capacity_{n}")))
        best = at.withColumn("best", F.max("at").over(Window.partitionBy(*parent)))
        got = best.select(*names, F.least(F.col(f"capacity_{n}"), F.expr(f"best.rest * weight_{n} div best.weights")).alias(f"budget_{n}"))
        nodes = nodes.join(got, list(names))
    return nodes.select(*LEVELS, "tokens", "docs", F.col("budget_3").alias("budget")).filter("budget > 0")


def order_key(seed: str, epoch: Column, id_text: Column, digest: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), id_text, digest))


def mixed(
    docs: DataFrame,
    weights: dict | None = None,
    default_weight: int = DEFAULT_WEIGHT,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    id_column: str = "doc_id",
    text: str = "text",
    carry: bool = False,
) -> DataFrame:
    """The selected documents: ``id, domain, lang, source, n_tokens, epoch (from 0), take_tokens``. A document comes
    once for each epoch that takes it. With carry, ``row`` holds all its columns."""
    weights = WEIGHTS if weights is None else weights
    source, words = F.coalesce(docs["source"], F.lit("")), F.coalesce(docs[text], F.lit(""))
    whole_row = [F.struct(*map(quoted, docs.columns)).alias("row")] if carry else []
    known = docs.select(
        docs[id_column].alias("id"),
        F.md5(words).alias("t"),
        F.struct(domain_of(source).alias("domain"), F.coalesce(docs["lang"], F.lit("")).alias("lang"), source.alias("source")).alias("leaf"),
        F.regexp_count(words, F.lit(WORD)).cast("long").alias("n_tokens"),
        *whole_row,
    ).filter("n_tokens > 0")
    known = cut(known, "mixing-tokens")
    sizes = cut(known.groupBy("leaf").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).select("leaf.*", "tokens", "docs"), "leaf-sizes")
    leaves = sizes.withColumn("capacity", F.col("tokens") * max_epochs)
    total = (sizes.agg(F.sum("tokens")).first()[0] or 0) * budget_percent // 100
    given = budgets(leaves, total, weights, default_weight)
    plan = cut(
        given.select(
            F.struct(*LEVELS).alias("leaf"),
            F.ceil(F.col("docs") / RANGE_ROWS).alias("ranges"),
            F.expr("budget div tokens").cast("int").alias("whole"),
            F.expr("budget % tokens").alias("part"),
            "docs",
        ),
        "leaf-plan",
    )
    planned = lookup(known, plan, "leaf", "docs")
    keep = ["id", "leaf", "n_tokens", "epoch", "take_tokens"] + ["row"] * carry
    every = planned.filter("whole > 0").withColumns({"epoch": F.explode(F.sequence(F.lit(0), F.col("whole") - 1)), "take_tokens": F.col("n_tokens")})

    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), "t"))
    # eight hex digits as a part of one, times the number of ranges
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2**32))
    last = planned.filter("part > 0").withColumn("key", key).withColumn("at", at)
    sums = last.groupBy("leaf", "at").agg(F.sum("n_tokens").alias("in_range"))
    running = F.sum("in_range").over(Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(sums.withColumn("before", F.coalesce(running, F.lit(0))), "digest-ranges")
    placed = last.join(starts, ["leaf", "at"]).filter("before < part").withColumn("epoch", F.col("whole"))
    full = placed.filter("before + in_range <= part").withColumn("take_tokens", F.col("n_tokens"))
    inner = F.sum("n_tokens").over(Window.partitionBy("leaf", "at").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1))
    edge = placed.filter("before + in_range > part").withColumn("take_tokens", F.least("n_tokens", F.col("part") - F.col("before") - F.coalesce(inner, F.lit(0)))).filter("take_tokens > 0")
    picked = every.select(*keep).unionByName(full.select(*keep)).unionByName(edge.select(*keep))
    return picked.select(F.col("id").alias(id_column), "leaf.*", "n_tokens", "epoch", "take_tokens", *["row"] * carry)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The selected documents with the columns they came with and ``n_tokens, epoch, take_tokens``, which replace
    columns of these names."""
    new = ["n_tokens", "epoch", "take_tokens"]
    picked = mixed(docs, carry=True, **options)
    return picked.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in new), *new)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,6})$', 1), '') AS INTEGER), 0) % 4
           WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'news' END AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), k AS (
  SELECT * FROM d WHERE n_tokens > 0
), l AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(4 * sum(n_tokens) AS BIGINT) AS cap,
         CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 1 END AS wd,
         CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS wl
  FROM k GROUP BY ALL
), c1 AS (
  SELECT domain, wd AS w, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(sum(tokens) AS BIGINT) * 60 // 100 FROM l) AS b FROM l GROUP BY ALL
), a1 AS (
  SELECT *, b - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM c1
), b1 AS (
  SELECT domain, least(cap, CAST(first_value(rest) OVER z * w // first_value(ws) OVER z AS BIGINT)) AS b
  FROM a1 WINDOW z AS (ORDER BY rest / ws DESC, rest DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), c2 AS (
  SELECT domain, lang, wl AS w, CAST(sum(cap) AS BIGINT) AS cap, any_value(b) AS b FROM l JOIN b1 USING (domain) GROUP BY domain, lang, wl
), a2 AS (
  SELECT *, b - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM c2
), b2 AS (
  SELECT domain, lang, least(cap, CAST(first_value(rest) OVER z * w // first_value(ws) OVER z AS BIGINT)) AS b
  FROM a2 WINDOW z AS (PARTITION BY domain ORDER BY rest / ws DESC, rest DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), c3 AS (
  SELECT domain, lang, source, tokens, cap, b FROM l JOIN b2 USING (domain, lang)
), a3 AS (
  SELECT *, b - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / 1, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         count(*) OVER (PARTITION BY domain, lang ORDER BY cap / 1, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM c3
), b3 AS (
  SELECT domain, lang, source, tokens, least(cap, CAST(first_value(rest) OVER z // first_value(ws) OVER z AS BIGINT)) AS b
  FROM a3 WINDOW z AS (PARTITION BY domain, lang ORDER BY rest / ws DESC, rest DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), p AS (
  SELECT k.*, CAST(b // tokens AS INTEGER) AS whole, b % tokens AS part,
         md5(concat_ws(':', 'mix-1', CAST(b // tokens AS INTEGER), coalesce(CAST(doc_id AS VARCHAR), ''), t)) AS key
  FROM k JOIN b3 USING (domain, lang, source) WHERE b > 0
), r AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, n_tokens AS take_tokens
FROM (SELECT *, unnest(range(whole)) AS epoch FROM p)
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, whole AS epoch, CAST(least(n_tokens, part - before) AS BIGINT) AS take_tokens FROM r WHERE before < part
"""
