"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are runs of ``window`` words (a shorter item is one window). Every window has shingles of up to
``shingle`` words. A document can contain a window only if it contains all its shingles, so it is enough to join on
one necessary token: the window's rarest shingle, by its count over all documents. The window must then fit around
the place of that shingle (positional bound) and into the document (length bound), and its words are compared with
the document's, exactly.

One pass over the documents keeps the places where a benchmark shingle may occur, found by a bitmap of hashes
of bounded size whatever the benchmark's size; everything after works on these places. A false positive of
the bitmap or of a hash is removed by the comparison of words.

Inputs: a text is lower-cased A-Z and split into words; null has none. A document of no words, or shorter than a
window, can't hold it. Repeated rows of documents get a result each; items of equal words are handled once and all
their ids are reported, an id twice in the benchmark counts once, a null item id isn't reported. An empty benchmark
hits nothing. Other columns aren't read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.bitmaps import bitmap, contained
from marquee.llm.common import cut, lookup, table
from marquee.llm.textbytes import ALNUM, mix, runs, slices, word_hashes, words_of

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
SHINGLE = 5


def word_list(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def shingle_hashes(hashes: np.ndarray, shingle: int, length: int) -> np.ndarray:
    """Of each run of shingle words, for windows of this length."""
    return mix(runs(hashes, shingle) ^ np.uint64(length))


def windows_of(benchmark: DataFrame, window: int, item_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(words, length, classes) for each different window, and (class, ids) for the items of equal words."""
    items = benchmark.select(benchmark[item_column].cast("string").alias("id"), word_list(benchmark[text]).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("class", F.xxhash64(F.array_join("w", " ")))
    classes = cut(items.groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("id"))))).alias("ids"), F.first("w").alias("w")), "item-classes")
    length = F.least(F.size("w"), F.lit(window))
    each = classes.select("class", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda i: F.array_join(F.slice("w", i + 1, length), " "))).alias("words"), length.alias("length"))
    return cut(each.groupBy("words", "length").agg(F.collect_set("class").alias("classes")), "windows"), classes.drop("w")


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(words, offset, h): the shingles of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words_of(batch.column("words"), ALNUM)
            hashes, first = word_hashes(w), w.first()
            rows, offsets, found = [], [], []
            for i, length in enumerate(batch.column("length").to_pylist()):
                h = shingle_hashes(hashes[first[i] : first[i + 1]], min(shingle, length), length)
                rows += [i] * len(h)
                offsets += range(len(h))
                found.append(h)
            h = np.concatenate([np.empty(0, dtype=np.uint64), *found])
            yield pa.RecordBatch.from_arrays([batch.column("words").take(pa.array(rows, pa.int64())), pa.array(offsets, pa.int32()), pa.array(h.view(np.int64))], names=["words", "offset", "h"])

    return windows.select("words", "length").mapInArrow(run, "words string, offset int, h long")


PLACES = "array<struct<h:bigint,length:int,pos:int,begin:int,span:string>>"


def places(docs: DataFrame, bits: np.ndarray, lengths: list[int], shingle: int, id_column: str, text: str) -> DataFrame:
    """(id, n_words, places) for each document: where a shingle of a window may occur, with the words around it."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in slices(batch, "t"):
                w = words_of(part.column("t"), ALNUM)
                hashes, first = word_hashes(w), w.first()
                n_words, h, size, pos, begin, span = np.diff(first), [], [], [], [], []
                raw, a, b = w.data.tobytes(), w.starts.tolist(), w.ends.tolist()
                counts = np.zeros(w.n_docs, dtype=np.int64)
                found: list[tuple[int, int, int, int]] = []
                for length in lengths:
                    k = min(shingle, length)
                    hs = shingle_hashes(hashes, k, length)
                    at = np.flatnonzero(contained(known, hs))
                    at = at[(w.docs[at] == w.docs[at + k - 1]) & (n_words[w.docs[at]] >= length)]
                    found += [(int(w.docs[i]), int(i), length, int(x)) for i, x in zip(at, hs[at].view(np.int64), strict=True)]
                for d, i, length, x in sorted(found):
                    lo = max(int(first[d]), i - length + min(shingle, length))
                    hi = min(int(first[d + 1]), i + length)
                    counts[d] += 1
                    h.append(x)
                    size.append(length)
                    pos.append(i - int(first[d]))
                    begin.append(lo - int(first[d]))
                    span.append(b" ".join(raw[a[j] : b[j]] for j in range(lo, hi)))
                items = pa.StructArray.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(size, pa.int32()), pa.array(pos, pa.int32()), pa.array(begin, pa.int32()), pa.array(span, pa.binary()).cast(pa.string())],
                    names=["h", "length", "pos", "begin", "span"],
                )
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), items)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_words, pa.int64()), lists], names=["id", "n_words", "places"])

    return docs.select(docs[id_column].alias("id"), docs[text].alias("t")).mapInArrow(run, f"id {id_type}, n_words long, places {PLACES}")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, item_ids) for each row of docs: the words inside occurrences of windows, and the items
    with occurring windows, their ids as sorted strings."""
    windows, classes = windows_of(benchmark, window, item_column, text)
    shingles = cut(window_shingles(windows, shingle), "window-shingles")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # window lengths are 1 to window
    seen = cut(places(docs, bitmap(shingles), lengths, shingle, id_column, text).withColumn("row", F.monotonically_increasing_id()), "places")

    each = seen.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    rarity = each.groupBy("h").agg(F.count("*").alias("n"))
    # the necessary token: a window's rarest shingle; a window with a shingle that nowhere occurs doesn't occur
    prefix = shingles.join(rarity, "h", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "h")).alias("p")).filter("p.n > 0")
    tokens = prefix.join(windows, "words").groupBy(F.col("p.h").alias("h")).agg(F.collect_list(F.struct("words", "classes", F.col("p.offset").alias("offset"), F.col("length").alias("size"))).alias("windows"), F.max("p.n").alias("n"))
    joined = lookup(each, cut(tokens, "prefix-tokens"), "h", "n").withColumn("x", F.explode("windows"))
    start = F.col("pos") - F.col("x.offset")
    inside = (start >= 0) & (start + F.col("length") <= F.col("n_words")) & (F.col("length") == F.col("x.size"))
    same = F.array_join(F.slice(F.split("span", " "), start - F.col("begin") + 1, F.col("length")), " ") == F.col("x.words")
    found = cut(joined.filter(inside).filter(same).select("row", start.alias("start"), (start + F.col("length")).alias("end"), F.col("x.classes").alias("classes")), "occurrences")

    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = found.select("row", "start", "end").distinct().select("row", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("more")).groupBy("row").agg(F.sum("more").alias("n_hit"))
    of_class = cut(found.select("row", F.explode("classes").alias("class")).distinct(), "row-classes")
    sizes = of_class.groupBy("class").agg(F.count("*").alias("n"))
    ids = lookup(of_class, cut(classes.join(sizes, "class"), "found-classes"), "class", "n").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    out = seen.select("row", F.col("id").alias(id_column), "n_words").join(hits, "row", "left").join(ids, "row", "left")
    return out.select(id_column, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with all their columns; an id that several rows
    share goes if one of them is hit, and rows of a null id stay."""
    hit = contamination(docs, benchmark, id_column=id_column).filter("n_hit > 0").select(id_column).distinct()
    return docs.join(hit, id_column, "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), i AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0
), v AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS words FROM i
), l AS (
  SELECT DISTINCT n FROM v
), s AS (
  SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, l WHERE len(w) >= n
), o AS (
  SELECT rid, n, p, item_id FROM (SELECT rid, n, p, array_to_string(w[p : p + n - 1], ' ') AS words FROM s) JOIN v USING (n, words)
), h AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, n, p FROM o)) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM o WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
