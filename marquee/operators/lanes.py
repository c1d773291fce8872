"""The lanes that keep the catalog current: compositions of differences, gates and upserts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM
from marquee.operators.dumps import THRESHOLDS, select_works
from marquee.operators.incremental import SOURCE_KEY, appeared_ids, catalogued, release_verdict
from marquee.operators.resolve import upsert

GAME_CAP = 2000


def needs_baseline(cursor: date | None, today: date, baseline_landed: bool, most_days: int = 7) -> bool:
    """Whether a lane of daily exports must start anew: no cursor, no export to compare with, or too long a gap."""
    return cursor is None or not baseline_landed or (today - cursor).days > most_days


def release_baseline(today: DataFrame, baseline: DataFrame, cursor: date | None, day: date, baseline_landed: bool) -> DataFrame:
    """The export to compare with: today's own, so that nothing has appeared, where the lane starts anew."""
    return today if needs_baseline(cursor, day, baseline_landed) else baseline


def new_releases(today: DataFrame, baseline: DataFrame, known: DataFrame, details: DataFrame, as_of) -> DataFrame:
    """Details (id, title, status, release_date, poster, overview) of ids that appeared today, with their verdict."""
    fresh = appeared_ids(today, baseline, known).select("id", "adult", "video", "popularity")
    return details.drop("adult", "video").join(fresh, "id").withColumn("verdict", release_verdict(as_of))


def new_release_lane(items: DataFrame, verdicts: DataFrame, columns: list[str]) -> DataFrame:
    """The catalog with the admitted titles in; verdicts carry the items' key, ``pos`` and the columns."""
    return upsert(items, verdicts.filter("verdict = 'admitted'"), ITEM, columns)


def change_lane(items: DataFrame, changed: DataFrame, links: DataFrame, details: DataFrame, columns: list[str], locked: dict[str, str] | None = None) -> DataFrame:
    """The catalog after landed changes (item_type, source, external_id): those of items that it has, with new details."""
    ours = catalogued(changed, links).join(links, SOURCE_KEY).select(*SOURCE_KEY, *ITEM[1:]).distinct()
    batch = details.join(ours, SOURCE_KEY).withColumn("pos", F.lit(0))
    return upsert(items, batch.select(*ITEM, "pos", *columns), ITEM, columns, locked)


def since_cursor(rows: DataFrame, column: str, cursor, key: str, cap: int = GAME_CAP) -> DataFrame:
    """The oldest rows after the cursor, as many as the cap; their latest time is the next cursor. Rows of that time
    beyond the cap come along, as the next run starts after it."""
    later = rows.filter(F.col(column) > (cursor if isinstance(cursor, Column) else F.lit(cursor)).cast("timestamp"))
    edge = later.orderBy(column, key).limit(cap).agg(F.max(column)).first()[0]
    return later.filter(F.col(column) <= F.lit(edge))


def game_lane(rows: DataFrame, column: str, cursor, now, key: str = "external_id", cap: int = GAME_CAP, cold_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows to load, the next cursor as one row ``cursor``): the oldest rows after the cursor, from ``cold_days`` back where there
    is none; without rows the cursor stays."""
    start = F.lit(cursor).cast("timestamp") if cursor is not None else F.lit(now).cast("timestamp") - F.expr(f"interval {cold_days} days")
    found = since_cursor(rows, column, start, key, cap)
    return found, found.agg(F.coalesce(F.max(column), start).alias("cursor"))


def promotion_lane(targets: DataFrame, enumerated: DataFrame) -> DataFrame:
    """Targets after an enumeration (item_type, source, external_id, vote_count): votes refreshed, attempts kept, new ones untried."""
    fresh = enumerated.groupBy(*SOURCE_KEY).agg(F.max("vote_count").alias("new_votes"))
    joined = targets.join(fresh, SOURCE_KEY, "full_outer")
    return joined.select(*SOURCE_KEY, F.coalesce("new_votes", "vote_count").alias("vote_count"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("is_gone", F.lit(False)).alias("is_gone"))


def book_dump_diff(log: DataFrame, editions: DataFrame, known: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    """The works that a dump newly selects."""
    return select_works(log, editions, thresholds).join(known.select("work_id"), "work_id", "left_anti")


def dump_is_covered(edition: str, last_edition: str | None) -> bool:
    """Whether the dump of this edition has been loaded, so that the lane has nothing to do."""
    return last_edition is not None and edition <= last_edition


def next_edition(edition: str, edition_at_end: str, last_edition: str | None) -> str | None:
    """The edition to remember: this one, unless another was published while it was read."""
    return edition if edition == edition_at_end else last_edition
