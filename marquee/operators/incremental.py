"""Work lists by difference, cursors, gaps, gates and links between catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM

MAX_ATTEMPTS = 3
SOURCE_KEY = ["item_type", "source", "external_id"]


def unlinked_targets(targets: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """Targets whose link reaches no item that exists."""
    return targets.join(links.join(items.select(*ITEM), ITEM, "left_semi"), SOURCE_KEY, "left_anti")


def pending_targets(targets: DataFrame, links: DataFrame, items: DataFrame, limit: int, most: int = MAX_ATTEMPTS) -> DataFrame:
    open_targets = unlinked_targets(targets, links, items).filter(~F.col("is_gone") & (F.col("attempts") < most))
    return open_targets.orderBy(F.asc("attempts"), F.desc_nulls_last("vote_count"), F.asc("id")).limit(limit)


def target_progress(targets: DataFrame, links: DataFrame, items: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Per type: all targets, those pending, gone, and without a link after all attempts."""
    missing = unlinked_targets(targets, links, items).select("id").withColumn("missing", F.lit(True))
    all_targets = targets.join(missing, "id", "left").withColumn("missing", F.coalesce("missing", F.lit(False)))
    tired, gone = F.col("attempts") >= most, F.col("is_gone")
    return all_targets.groupBy("item_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("missing") & ~gone & ~tired).alias("pending"), F.count_if(F.col("missing") & gone).alias("gone"), F.count_if(F.col("missing") & ~gone & tired).alias("unlinkable")
    )


def reopen_targets(targets: DataFrame, links: DataFrame) -> DataFrame:
    """Attempts back to 0 where a reachable target that was tried has no link."""
    linked = links.select(*SOURCE_KEY).distinct().withColumn("linked", F.lit(True))
    joined = targets.join(linked, SOURCE_KEY, "left")
    reopens = (F.col("attempts") > 0) & ~F.col("is_gone") & F.col("linked").isNull()
    return joined.withColumn("attempts", F.when(reopens, 0).otherwise(F.col("attempts"))).drop("linked")


def stamp_outcomes(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes (id, outcome): found and not_found are attempts, gone also retires, failed leaves the target alone."""
    joined = targets.join(outcomes, "id", "left")
    tried = F.col("outcome").isin("found", "not_found", "gone")
    return joined.withColumn("attempts", F.when(tried, F.col("attempts") + 1).otherwise(F.col("attempts"))).withColumn("is_gone", F.col("is_gone") | F.coalesce(F.col("outcome") == "gone", F.lit(False))).drop("outcome")


def stalest_items(items: DataFrame, limit: int) -> DataFrame:
    return items.orderBy(F.asc_nulls_first("last_synced_on"), F.asc("item_type"), F.asc("item_id")).limit(limit)


def known_source_ids(links: DataFrame, targets: DataFrame) -> DataFrame:
    return links.select(*SOURCE_KEY).union(targets.select(*SOURCE_KEY)).distinct()


def appeared_ids(today: DataFrame, baseline: DataFrame, known: DataFrame) -> DataFrame:
    """Ids (id) of today's export that are in neither table, without adult titles and videos."""
    new = today.join(baseline.select("id"), "id", "left_anti").join(known.select("id"), "id", "left_anti")
    return new.filter("not adult and not video")


def catalogued(ids: DataFrame, links: DataFrame) -> DataFrame:
    return ids.join(links.select(*SOURCE_KEY), SOURCE_KEY, "left_semi")


def credit_gaps(items: DataFrame, credits: DataFrame, cast: DataFrame, links: DataFrame) -> DataFrame:
    """Items without any credit or cast, and whether an external id could help."""
    bare = items.join(credits.select(*ITEM), ITEM, "left_anti").join(cast.select(*ITEM), ITEM, "left_anti")
    linked = links.select(*ITEM).distinct().withColumn("linked", F.lit(True))
    return bare.join(linked, ITEM, "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


#: Production states of titles that aren't admitted, by type. A canceled series has been shown.
REJECTED_STATUSES = {"MOVIE": ["Canceled", "Rumored"], "SERIES": []}
PAST_DAYS, AHEAD_DAYS = 90, 180


def release_verdict(today, item_type: str = "MOVIE", past_days: int = PAST_DAYS, ahead_days: int = AHEAD_DAYS, rejected: list[str] | None = None) -> Column:
    """The first rule that a landed title fails, or admitted."""
    day = F.try_to_date("release_date", "yyyy-MM-dd")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    now = F.lit(today).cast("date")
    statuses = REJECTED_STATUSES[item_type] if rejected is None else rejected
    return (
        F.when(empty("title"), "no_title")
        .when(F.col("adult"), "adult")
        .when(F.col("video"), "video")
        .when(F.col("status").isin(*statuses), F.concat(F.lit("status:"), "status"))
        .when(empty("release_date"), "no_release_date")
        .when(day.isNull(), "unparseable_release_date")
        .when(day < F.date_sub(now, past_days), "too_old")
        .when(day > F.date_add(now, ahead_days), "too_far_ahead")
        .when(empty("poster") & empty("overview"), "no_poster_or_overview")
        .otherwise("admitted")
    )


def gate_report(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


def advance_cursors(batches: DataFrame, cursors: DataFrame) -> DataFrame:
    """(source, kind, item_type, cursor): the end of the unbroken run of batches (begin_at, end_at, succeeded) that
    starts where the stored cursor ends. A failed batch or a gap stops it; without a stored cursor it starts at the first batch."""
    key = ["source", "kind", "item_type"]
    order = Window.partitionBy(*key).orderBy("begin_at", "end_at")
    rows = batches.join(cursors, key, "left").filter("cursor is null or end_at > cursor")
    previous = F.coalesce(F.lag("end_at").over(order), "cursor", "begin_at")
    joins_on = F.col("succeeded") & (F.col("begin_at") <= F.col("previous"))
    good = rows.withColumn("previous", previous).withColumn("ok", F.min(joins_on.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    moved = good.filter("ok = 1").groupBy(*key).agg(F.max("end_at").alias("moved"))
    return cursors.join(moved, key, "full_outer").select(*key, F.coalesce("moved", "cursor").alias("cursor"))


def coverage_gaps(landed: DataFrame, cursors: DataFrame, until, retention_days: int = 14) -> DataFrame:
    """(source, first_day, last_day, n_days, lost): runs of days after the cursor that never landed, those beyond the
    retention apart, as they can't be fetched any more."""
    end = F.lit(until).cast("date")
    days = cursors.filter(F.date_add("cursor_day", 1) <= end).select("source", F.explode(F.sequence(F.date_add("cursor_day", 1), end)).alias("day"))
    missing = days.join(landed.select("source", "day"), ["source", "day"], "left_anti").withColumn("lost", F.col("day") < F.date_sub(end, retention_days))
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("source", "lost").orderBy("day")))
    return missing.withColumn("island", island).groupBy("source", "lost", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("island")


def anchor_items(bindings: DataFrame, held: DataFrame) -> DataFrame:
    """(item, outcome, qid) for bindings (item, qid or null): missing, ambiguous (left open), unlinked where another item
    of the type holds the qid, else linked."""
    per_item = bindings.groupBy(*ITEM).agg(F.collect_set("qid").alias("q"), F.min("qid").alias("qid"))
    owner = held.select("item_type", "qid", F.col("item_id").alias("owner"))
    joined = per_item.join(owner, ["item_type", "qid"], "left")
    outcome = F.when(F.size("q") == 0, "missing").when(F.size("q") > 1, "ambiguous").when(F.col("owner") != F.col("item_id"), "unlinked").otherwise("linked")
    return joined.select(*ITEM, outcome.alias("outcome"), F.when(outcome == "linked", F.col("qid")).alias("qid"))


def anchor_coverage(items: DataFrame, links: DataFrame, anchors: DataFrame) -> DataFrame:
    linked = links.select(*ITEM).distinct().withColumn("l", F.lit(1))
    anchored = anchors.select(*ITEM).distinct().withColumn("a", F.lit(1))
    joined = items.select(*ITEM).join(linked, ITEM, "left").join(anchored, ITEM, "left")
    counts = joined.groupBy("item_type").agg(F.count("*").alias("n_items"), F.count("l").alias("linked"), F.count("a").alias("anchored"))
    return counts.withColumn("ratio", F.round(F.coalesce(F.try_divide("anchored", "linked"), F.lit(0.0)), 6))


def resolve_qids(statements: DataFrame, anchors: DataFrame, column: str) -> DataFrame:
    """statements with the items that their qid in the column is linked to."""
    return statements.join(anchors.filter("outcome = 'linked'").select(F.col("qid").alias(column), *ITEM), column)


def new_keys(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """The keys of the rows that the known ones don't have, each once."""
    return rows.select(*key).distinct().join(known.select(*key), key, "left_anti")


def relation_edges(statements: DataFrame, anchors: DataFrame, source: str = "WIKIDATA") -> DataFrame:
    """Edges between all items of either end's qid, without an item's edge to itself."""
    ends = anchors.select("qid", *ITEM)
    a = ends.withColumnsRenamed({"qid": "from_qid", "item_type": "from_type", "item_id": "from_id"})
    b = ends.withColumnsRenamed({"qid": "to_qid", "item_type": "to_type", "item_id": "to_id"})
    found = statements.join(a, "from_qid").join(b, "to_qid").filter("from_type <> to_type or from_id <> to_id")
    return found.select("from_type", "from_id", "to_type", "to_id", "relation", F.lit(source).alias("source"), F.lit(1.0).alias("score")).distinct()


def delete_layer(relations: DataFrame, source: str) -> DataFrame:
    return relations.filter(F.col("source") != source)


def relation_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("source", "relation").agg(F.count("*").alias("n_edges"))
