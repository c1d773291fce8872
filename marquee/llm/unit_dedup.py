"""Line and paragraph hashing: the earliest copy of a unit stays, later ones go.

A text is cut into units (lines, or paragraphs, which end at an empty line), each unit is normalised (lower case, white
space squeezed) and hashed to 128 bits, whatever its length. Digests are counted over all documents; of equal units the first in
the order of (rank, id, start) stays and the others are removed, known by their offsets in code points of the original text.

With ``sentences``, the sentences of a unit of several are hashed too, which finds a passage pasted into the middle of a
line. One of fewer than ``min_words`` words is hashed with the words before it, ``CONTEXT_WORDS`` in all, so that it counts
as repeated only within a longer passage that is; with it go the whole sentences and lines among these words, which the
earlier copy has as well. Sentences of a unit that is removed whole aren't reported by themselves.

Counting needs only the digests. A bitmap of fixed size of the repeated ones then keeps most units, which are unique,
out of the second shuffle, and hot digests are joined apart, so no group of copies meets in one task.

Inputs: null and empty texts have no units, nor has white space. Rows that repeat an id are told apart by an internal row
number, so the copies within later rows go as well; a null rank or id comes last. An empty table gives no rows. Other columns
aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.bitmaps import bitmap, contained
from marquee.llm.common import cut, lookup, table

#: What ends a unit.
ENDS = {"line": re.compile(r"\n+"), "paragraph": re.compile(r"\n\s*\n")}
#: What ends a sentence within a unit: a line's end, or a stop with white space after it.
SENTENCE_END = re.compile(r"\n+|(?<=[.!?])[^\S\n]+")
MIN_WORDS = 8
CONTEXT_WORDS = 25


def spans(text: str, begin: int, end: int, gaps: re.Pattern[str]) -> Iterator[tuple[int, int]]:
    """The pieces of text[begin:end] between the gaps."""
    at = begin
    for gap in gaps.finditer(text, begin, end):
        if gap.start() > at:
            yield at, gap.start()
        at = gap.end()
    if at < end:
        yield at, end


def digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def units_of(text: str, unit: str, sentences: bool, min_words: int) -> Iterator[tuple[int, bool, int, int, bytes]]:
    """(unit's start, whether it is the whole unit, start, end, digest) of all units and sentences with a word."""
    recent: list[tuple[int, list[str]]] = []  # starts and words of the last sentences
    for a, b in spans(text, 0, len(text), ENDS[unit]):
        pieces = [(x, y, w) for x, y in spans(text, a, b, SENTENCE_END) if (w := text[x:y].lower().split())] if sentences else []
        words = [w for _, _, p in pieces for w in p] if sentences else text[a:b].lower().split()
        if words:
            yield a, True, a, b, digest(words)
        for x, y, own in pieces:
            start, context = x, own
            if len(own) < min_words:
                for s, w in reversed(recent):
                    if len(context) >= CONTEXT_WORDS:
                        break
                    if len(context) + len(w) <= CONTEXT_WORDS:
                        start = s
                    context = [*w, *context]
                context = context[-CONTEXT_WORDS:] if len(context) >= CONTEXT_WORDS else []
            recent = [*recent[1 - CONTEXT_WORDS :], (x, own)]
            if context and (len(pieces) > 1 or len(own) < min_words):
                yield a, False, start, y, digest(context)


def units(docs: DataFrame, unit: str, sentences: bool, min_words: int) -> DataFrame:
    """(row, unit, whole, start, end, digest, h) of the units of docs (row, t)."""
    names = ["row", "unit", "whole", "start", "end", "digest", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[tuple]) -> pa.RecordBatch:
            row, of, whole, start, end, digests = zip(*found, strict=True) if found else ((),) * 6
            h = np.frombuffer(b"".join(digests), dtype="<i8")[::2]
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(of, pa.int32()), pa.array(whole, pa.bool_()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digests, pa.binary()), pa.array(h)], names=names)

        for batch in batches:
            found: list[tuple] = []
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found += [(row, *u) for u in units_of(body.as_py() or "", unit, sentences, min_words)]
                if len(found) > 50_000:
                    yield made(found)
                    found = []
            yield made(found)

    return docs.select("row", "t").mapInArrow(run, "row long, unit int, whole boolean, start int, end int, digest binary, h long")


def maybe_in(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose h is set in the bitmap."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(contained(sent.value, batch.column("h").to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def numbered(docs: DataFrame, id_column: str, rank: str | None, text: str) -> DataFrame:
    """(row, id, rank, t), row being a number that stays, as the rows are written once."""
    order = F.col(rank) if rank else F.col(id_column)
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), order.alias("rank"), F.col(text).alias("t")), "numbered")


def removals(rows: DataFrame, unit: str = "line", sentences: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, id, start, end, whole, kept_id, kept_row, kept_start, digest) of the units to remove from numbered rows."""
    found = cut(units(rows, unit, sentences, min_words), "units")
    repeated = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    again = maybe_in(found, bitmap(cut(repeated, "repeated-units")))
    candidates = again.join(rows.select("row", "id", "rank"), "row")
    place = F.struct(F.col("rank").isNull().alias("last"), "rank", F.col("id").isNull().alias("no_id"), "id", "row", "start", "unit", "whole")
    candidates = cut(candidates.select("digest", place.alias("place"), "end"), "unit-candidates")
    firsts = cut(candidates.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1"), "first-units")
    # the same words as a unit and as a sentence of it are one occurrence
    later = lookup(candidates, firsts, "digest", "n").filter("place > first and not (place.row = first.row and place.start = first.start)")
    gone = later.select("place.row", "place.id", "place.unit", "place.start", "end", "place.whole", F.col("first.id").alias("kept_id"), F.col("first.row").alias("kept_row"), F.col("first.start").alias("kept_start"), "digest")
    if sentences:
        gone = gone.withColumn("unit_gone", F.bool_or("whole").over(Window.partitionBy("row", "unit"))).filter("whole or not unit_gone").drop("unit_gone")
    return gone.drop("unit")


def without_units(docs: DataFrame, unit: str = "line", sentences: bool = True, min_words: int = MIN_WORDS, id_column: str = "doc_id", text: str = "text", rank: str | None = None) -> DataFrame:
    """(id, text, removed): the texts without the later copies, and the removed spans of the original text, which don't overlap."""
    rows = numbered(docs, id_column, rank, text)
    gone = removals(rows, unit, sentences, min_words).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def joined_up(done, span):
        last = F.try_element_at(done, F.lit(-1))
        touches = last.isNotNull() & (span["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    joined = rows.join(gone, "row", "left").select("id", "t", F.aggregate(F.coalesce("spans", none), none, joined_up).alias("removed"))
    before = lambda j: F.when(j == 0, 0).otherwise(F.get("removed", j - 1)["end"])
    parts = F.transform(F.sequence(F.lit(0), F.size("removed")), lambda j: F.substring(F.col("t"), before(j) + 1, F.coalesce(F.get("removed", j)["start"], F.length("t")) - before(j)))
    return joined.select(F.col("id").alias(id_column), F.when(F.size("removed") == 0, F.col("t")).otherwise(F.array_join(parts, "")).alias(text), "removed")


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each removed line, or sentence of a line that stays: where it was, and the document that keeps its
    earliest copy."""
    gone = removals(numbered(table(spark, sf_dir, "documents"), "doc_id", None, "text"))
    return gone.select(
        F.col("id").alias("doc_id"), F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), F.when(F.col("whole"), "line").otherwise("sentence").alias("unit"), F.col("kept_id").alias("kept_doc_id"), F.col("kept_start").alias("kept_offset"), F.lower(F.hex("digest")).alias("digest")
    )
