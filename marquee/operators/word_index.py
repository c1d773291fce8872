"""A kept inverted index over the words of items: blocks in order of rating, changed by segments, searched from the best block down.

On disk, under one path:

    postings/segment=n/bucket=b (word, best, worst, items): up to BLOCK items of a word, next to each other in the order of ratings;
                                a search reads the buckets of its words, in which rows are sorted by word
    words/segment=n             (word, n): how many items of the segment have the word
    gone/segment=n              (item): items whose entries in older segments don't count any more
    done/segment=n              one row, written last: a segment without it doesn't exist

``update`` writes the changed items' words into a segment of its own, so its work is that of the batch. Rebuild to compact.

All queries are answered at once, in rounds. A query goes down the blocks of its rarest word, four times as many in each round; of its
other words only blocks whose ratings overlap with these are read. It is done when it has k matches rated above the best block left, or
no blocks are left. The order is that of ``catalog.search_order``. Words of items and of queries are those of ``catalog.search_words`` and
``tokens``; an item without words isn't held, a query without words, or with one that no item has, finds nothing. Equal items in a batch count
once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM, tokens
from marquee.operators.catalog import search_words, top_k_per_group
from marquee.sources.shared import new_folder

BLOCK, BUCKETS = 128, 32
#: Words that are handed to the scan as a filter; more are joined.
LISTED_WORDS = 2000
#: Blocks of its rarest word that a query looks at in the first round.
FIRST_BLOCKS, GROWTH = 2, 4
POSTINGS = "word string, best double, worst double, items array<struct<rating:double,item_type:string,item_id:bigint,tf:int,length:int>>, segment int, bucket int"
#: What stands for no rating, below all others.
UNRATED = float("-inf")


def bucket_of(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def word_entries(items: DataFrame) -> DataFrame:
    """(word, rating, item, tf, length) of items (item, title, overview, rating_external)."""
    texts = items.dropDuplicates(ITEM).select(*ITEM, F.coalesce("rating_external", F.lit(UNRATED)).alias("rating"), search_words(items).alias("words"))
    each = texts.select(*ITEM, "rating", F.size("words").alias("length"), F.explode("words").alias("word"))
    return each.groupBy("word", *ITEM).agg(F.first("rating").alias("rating"), F.count("*").cast("int").alias("tf"), F.first("length").alias("length"))


def blocks_of(entries: DataFrame) -> DataFrame:
    """(word, best, worst, items): entries of a word that are next to each other in one sort by range, so that a frequent word's are
    sorted and packed by many tasks."""
    placed = entries.orderBy("word", F.desc("rating"), *ITEM).withColumn("chunk", F.floor(F.monotonically_increasing_id() / BLOCK))
    item = F.struct("rating", "item_type", "item_id", "tf", "length")
    return placed.groupBy("word", "chunk").agg(F.max("rating").alias("best"), F.min("rating").alias("worst"), F.collect_list(item).alias("items")).select("word", "best", "worst", "items")


@dataclass
class WordIndex:
    spark: SparkSession
    path: str

    def segments(self) -> list[int]:
        found = self.spark.read.schema("n long, segment int").parquet(f"{self.path}/done")
        return sorted(r[0] for r in found.select("segment").distinct().collect())

    def _write(self, number: int, items: DataFrame, gone: DataFrame) -> None:
        at, entries = f"segment={number}", word_entries(items)
        blocks = blocks_of(entries).withColumn("bucket", bucket_of("word"))
        # by range, as one word may fill several files
        dealt = blocks.repartitionByRange("bucket", "word", F.desc("best")).sortWithinPartitions("bucket", "word", F.desc("best"))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/{at}")
        entries.groupBy("word").agg(F.count("*").alias("n")).repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{self.path}/words/{at}")
        gone.write.mode("overwrite").parquet(f"{self.path}/gone/{at}")
        self.spark.range(1).select(F.col("id").alias("n")).write.mode("overwrite").parquet(f"{self.path}/done/{at}")

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> int:
        """Put items in as they are now, and take removed ones (item) out, as the next segment; its number."""
        number = self.segments()[-1] + 1
        gone = changed.select(*ITEM) if removed is None else changed.select(*ITEM).unionByName(removed.select(*ITEM))
        self._write(number, changed, gone.distinct())
        return number

    def asked_postings(self, words: DataFrame) -> DataFrame:
        """The blocks of words (word), with their segment. Few words go into the scan as a filter, with their buckets."""
        held = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").filter(F.col("segment").isin(self.segments()))
        few = words.select("word", bucket_of("word").alias("bucket")).distinct().limit(LISTED_WORDS + 1).collect()
        if len(few) <= LISTED_WORDS:
            return held.filter(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("word").isin([r["word"] for r in few]))
        return held.join(words.select("word").distinct(), "word", "left_semi")

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, item, rating_external, rank, place): the k best items that have every word of a query (query_id, q)."""
        folder, segments = new_folder(self.spark, "word-search"), self.segments()

        def cut(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{folder}/{name}")
            return self.spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

        each = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("q")))).alias("word"))
        counts = self.spark.read.schema("word string, n long, segment int").parquet(f"{self.path}/words").filter(F.col("segment").isin(segments))
        counts = counts.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
        asked = each.join(counts, "word", "left").groupBy("query_id").agg(F.min(F.struct("n", "word")).alias("r"), F.count("*").alias("n_words"), F.count("n").alias("n_known"), F.collect_list("word").alias("words"))
        asked = cut(asked.filter("n_known = n_words").select("query_id", F.col("r.word").alias("rarest"), "n_words", "words"), "asked")
        postings = cut(self.asked_postings(asked.select(F.explode("words").alias("word"))), "postings")
        gone = self.spark.read.schema("item_type string, item_id long, segment int").parquet(f"{self.path}/gone").filter(F.col("segment").isin(segments))
        gone = gone.groupBy(*ITEM).agg(F.max("segment").alias("gone_in"))

        # the blocks of a word from the best down, over all segments; a row for each block, without its items
        order = Window.partitionBy("word").orderBy(F.desc("best"), F.desc("worst"), "segment", "place_in_word")
        listed = postings.withColumn("place_in_word", F.xxhash64("items"))
        ladder = cut(listed.select("word", "segment", "best", "worst", "place_in_word", F.row_number().over(order).alias("nth"), F.lead("best").over(order).alias("next_best")), "ladder")
        rare = cut(listed.join(ladder, ["word", "segment", "best", "worst", "place_in_word"]).select("word", "segment", "nth", "worst", "best", "items"), "rare-blocks")

        found, open_queries, low, high, number = [], asked, 0, FIRST_BLOCKS, 0
        while not open_queries.isEmpty():
            mine = open_queries.join(rare.filter((F.col("nth") > low) & (F.col("nth") <= high)).withColumnRenamed("word", "rarest"), "rarest")
            here = mine.select("query_id", "words", "n_words", "rarest", "segment", F.explode("items").alias("i")).select("query_id", "words", "n_words", "rarest", "segment", "i.*")
            alive = here.join(gone, ITEM, "left").filter("gone_in is null or segment >= gone_in").drop("gone_in")
            # the other words' blocks whose ratings overlap with those of this round
            band = mine.groupBy("query_id").agg(F.max("best").alias("top"), F.min("worst").alias("bottom"))
            others = open_queries.join(band, "query_id").select("rarest", F.explode("words").alias("word"), "top", "bottom").filter("word <> rarest").groupBy("word").agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"))
            near = postings.join(others, "word").filter("best >= bottom and worst <= top")
            entries = near.select("word", "segment", F.explode("items").alias("i")).select("word", "segment", "i.item_type", "i.item_id", F.col("i.tf").alias("more"))
            wanted = alive.select("query_id", "segment", *ITEM, F.explode(F.array_except("words", F.array("rarest"))).alias("word"))
            also = wanted.join(entries, ["word", "segment", *ITEM]).groupBy("query_id", "segment", *ITEM).agg(F.count("*").alias("got"), F.sum("more").alias("more"))
            matched = alive.join(also, ["query_id", "segment", *ITEM], "left").filter(F.coalesce("got", F.lit(0)) == F.col("n_words") - 1)
            rank = (F.col("tf") + F.coalesce("more", F.lit(0))) / (1 + F.log("length"))
            found.append(cut(matched.select("query_id", *ITEM, "rating", rank.alias("rank")), f"matches-{number}"))
            so_far = found[0]
            for more in found[1:]:
                so_far = so_far.unionByName(more)
            kth = top_k_per_group(so_far, ["query_id"], [F.desc("rating")], k).filter(F.col("place") == k).select("query_id", F.col("rating").alias("kth"))
            left = ladder.filter(F.col("nth") == high).select(F.col("word").alias("rarest"), "next_best").filter("next_best is not null")
            still = open_queries.join(left, "rarest").join(kth, "query_id", "left").filter("kth is null or kth <= next_best")
            open_queries = cut(still.select(*asked.columns), f"open-{number}")
            low, high, number = high, high * GROWTH, number + 1
        if not found:
            return asked.select("query_id", F.lit("").alias("item_type"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("rating_external"), F.lit(0.0).alias("rank"), F.lit(0).alias("place")).limit(0)
        rated = so_far.withColumn("rating_external", F.when(F.col("rating") > UNRATED, F.col("rating")))
        order = [F.desc("rating"), F.desc(F.round("rank", 6)), F.asc("item_id"), F.asc("item_type")]
        return top_k_per_group(rated, ["query_id"], order, k).select("query_id", *ITEM, "rating_external", "rank", "place")


def build(items: DataFrame, path: str) -> WordIndex:
    """A new index of items (item, title, overview, rating_external) at path."""
    index = WordIndex(items.sparkSession, path)
    index._write(0, items, items.sparkSession.createDataFrame([], "item_type string, item_id long"))
    return index


def opened(spark: SparkSession, path: str) -> WordIndex:
    return WordIndex(spark, path)
