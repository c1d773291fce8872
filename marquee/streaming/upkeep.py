"""Counts and averages of the community that follow a stream of changes, by signed deltas.

The feed (CHANGES) has a row for each change of a rating, a shelf entry, a follow, a like, a notification or a user, with the row as it
is afterwards; change_id says which of two changes of a row is the later one. State is kept for each user: their rows, and whether
they are banned. A change sends out what its row no longer adds to an aggregate and what it adds now, so an edit is two
signed rows, a hidden rating one, and a ban takes back the scores of all the user's ratings. An erased user (a change of the user that is
gone) takes all their rows along; rows of others that go with them come as changes of their own.

Each batch adds up its own signed rows and writes them as a folder of its number, which a repeated batch replaces: so a batch counts
once. Deltas are sums and counts, so any order of batches comes to the same. ``fold`` makes one folder of those so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marquee.functions.columns import ITEM
from marquee.operators.community import STATUSES
from marquee.sources.shared import latest_fold

#: part: rating, shelf, follow (item_id: the followed), like (item_id: the rating; with an item_type: the item, all of
#: whose ratings by others are liked), note or user. label: a shelf entry's status. counts: whether a
#: rating isn't hidden, or a notification is unread. banned: of users.
CHANGES = "change_id long, user_id long, part string, row string, item_type string, item_id long, label string, score double, counts boolean, gone boolean, banned boolean"
DELTA = "measure string, item_type string, id long, label string, sum double, n long"


def added(user: int, part: str, row: tuple, banned: bool) -> list[tuple]:
    """What a row (item_type, item_id, label, score, counts, gone) adds: (measure, item_type, id, label, sum)."""
    item_type, item_id, label, score, counts, gone = row
    if gone:
        return []
    if part == "rating":
        return [("rating", item_type, item_id, "", score)] if counts and not banned and score is not None else []
    if part == "shelf":
        return [("shelf", "", user, label, 0.0)]
    if part == "follow":
        return [("followers", "", item_id, "", 0.0), ("following", "", user, "", 0.0)]
    if part == "like":
        return [("like", item_type or "", item_id, "", 0.0)]
    return [("unread", "", user, "", 0.0)] if part == "note" and counts else []


class Upkeep(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "part string, row string", "item_type string, item_id long, label string, score double, counts boolean, gone boolean, change_id long")
        self.user = handle.getValueState("user", "banned boolean, gone boolean, change_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        user, out = key[0], []
        banned, erased, last = self.user.get() if self.user.exists() else (False, False, -1)
        for batch in rows:
            for c in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                if c.part == "user":
                    if c.change_id <= last:
                        continue
                    now = (bool(c.banned), bool(c.gone))
                    if now != (banned, erased):
                        for (part, name), v in list(self.rows.iterator()):
                            row = tuple(v[:6])
                            before, after = added(user, part, row, banned) if not erased else [], added(user, part, row, now[0]) if not now[1] else []
                            out += [(*d, -1) for d in before if d not in after] + [(*d, 1) for d in after if d not in before]
                    banned, erased, last = *now, int(c.change_id)
                    self.user.update((banned, erased, last))
                else:
                    name = (c.part, c.row)
                    known = self.rows.getValue(name) if self.rows.containsKey(name) else None
                    if known is not None and c.change_id <= known[6]:
                        continue
                    row = (c.item_type, None if c.item_id is None else int(c.item_id), c.label, c.score, c.counts is None or bool(c.counts), bool(c.gone))
                    before = added(user, c.part, tuple(known[:6]), banned) if known is not None and not erased else []
                    after = added(user, c.part, row, banned) if not erased else []
                    out += [(*d, -1) for d in before if d not in after] + [(*d, 1) for d in after if d not in before]
                    self.rows.updateValue(name, (*row, int(c.change_id)))
        made = pd.DataFrame(out, columns=["measure", "item_type", "id", "label", "sum", "n"])
        made["sum"] = made["sum"].astype("float64") * made["n"].astype("float64")
        yield made.astype({"id": "int64", "n": "int64"})

    def close(self) -> None:
        pass


def totals(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("measure", "item_type", "id", "label").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))


def keep_aggregates(changes: DataFrame, path: str, checkpoint: str):
    """A stream writer that keeps the deltas of a feed (CHANGES) under path."""

    def write(batch: DataFrame, number: int) -> None:
        totals(batch).write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")

    signed = changes.groupBy("user_id").transformWithStateInPandas(Upkeep(), DELTA, "append", "None")
    return signed.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)


def kept(spark: SparkSession, path: str, measure: str) -> DataFrame:
    """(item_type, id, label, sum, n) of a measure: the last fold and the batches after it."""
    upto = latest_fold(spark, f"{path}/folds")
    rows = spark.read.schema(f"{DELTA}, batch long").parquet(f"{path}/deltas").filter(F.col("batch") > (-1 if upto is None else upto)).drop("batch")
    if upto is not None:
        rows = rows.unionByName(spark.read.schema(DELTA).parquet(f"{path}/folds/fold={upto}"))
    return totals(rows.filter(F.col("measure") == measure)).filter("n > 0").drop("measure")


def fold(spark: SparkSession, path: str) -> int:
    """Make one folder of all batches so far; the last batch's number."""
    upto = latest_fold(spark, f"{path}/folds")
    rows = spark.read.schema(f"{DELTA}, batch long").parquet(f"{path}/deltas")
    last = rows.agg(F.max("batch")).first()[0]
    fresh = rows.filter(F.col("batch") > (-1 if upto is None else upto)).drop("batch")
    if upto is not None:
        fresh = fresh.unionByName(spark.read.schema(DELTA).parquet(f"{path}/folds/fold={upto}"))
    if last != upto:
        totals(fresh).filter("n <> 0").write.mode("overwrite").parquet(f"{path}/folds/fold={last}")
    return last


def rating_aggregates(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """As ``community.rating_aggregates``, from the deltas."""
    found = kept(spark, path, "rating").select("item_type", F.col("id").alias("item_id"), F.round((F.col("sum") / F.col("n")).cast("decimal(18,8)"), 2).cast("double").alias("average"), F.col("n").alias("n_scores"))
    return items.select(*ITEM).join(found, ITEM, "left").select(*ITEM, "average", F.coalesce("n_scores", F.lit(0)).alias("n_scores"))


def library_counts(spark: SparkSession, path: str, users: DataFrame) -> DataFrame:
    """As ``community.library_counts``."""
    counts = kept(spark, path, "shelf").groupBy(F.col("id").alias("user_id")).pivot("label", list(STATUSES)).agg(F.sum("n"))
    return users.select("user_id").join(counts, "user_id", "left").fillna(0, list(STATUSES))


def follow_counts(spark: SparkSession, path: str, users: DataFrame) -> DataFrame:
    """As ``community.follow_counts``."""
    out = users.select("user_id")
    for measure in ("followers", "following"):
        out = out.join(kept(spark, path, measure).select(F.col("id").alias("user_id"), F.col("n").alias(measure)), "user_id", "left")
    return out.fillna(0, ["followers", "following"])


def like_counts(spark: SparkSession, path: str) -> DataFrame:
    """As ``community.like_counts``."""
    return kept(spark, path, "like").filter("item_type = ''").select(F.col("id").alias("rating_id"), F.col("n").alias("like_count"))


def unread_counts(spark: SparkSession, path: str) -> DataFrame:
    """(recipient_id, unread) of those who have unread notifications."""
    return kept(spark, path, "unread").select(F.col("id").alias("recipient_id"), F.col("n").alias("unread"))


def table_changes(ratings: DataFrame, library: DataFrame, follows: DataFrame, likes: DataFrame, users: DataFrame, change_id: int) -> DataFrame:
    """Tables as a feed (CHANGES) in which every row is as it is now, all under one change_id. likes: (user_id, rating_id), or (user_id,
    item) of those who like an item's ratings."""
    none = {"item_type": "string", "item_id": "long", "label": "string", "score": "double", "counts": "boolean", "banned": "boolean"}

    def rows(df: DataFrame, user: str, part: str, row, **given) -> DataFrame:
        columns = [given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in none.items()]
        picked = df.select(F.lit(change_id).cast("long").alias("change_id"), F.col(user).alias("user_id"), F.lit(part).alias("part"), row.cast("string").alias("row"), *columns, F.lit(False).alias("gone"))
        return picked.select("change_id", "user_id", "part", "row", "item_type", "item_id", "label", "score", "counts", "gone", "banned")

    if "rating_id" in likes.columns:
        liked = rows(likes, "user_id", "like", F.col("rating_id"), item_id=F.col("rating_id"))
    else:
        liked = rows(likes, "user_id", "like", F.concat_ws("/", *ITEM), item_type=F.col("item_type"), item_id=F.col("item_id"))
    return (
        rows(ratings, "user_id", "rating", F.col("id"), item_type=F.col("item_type"), item_id=F.col("item_id"), score=F.col("score"), counts=~F.col("is_hidden"))
        .unionByName(rows(library, "user_id", "shelf", F.concat_ws("/", *ITEM), label=F.col("status")))
        .unionByName(rows(follows, "follower_id", "follow", F.col("followed_id"), item_id=F.col("followed_id")))
        .unionByName(liked)
        .unionByName(rows(users, "user_id", "user", F.lit(""), banned=F.col("is_banned")))
    )
