"""Periodic runs of words, caught by online dyadic squares.

A run is a stretch of words with smallest period q, of at least ``min_length`` words and two periods, which no word
next to it continues. It begins with a square: q words that are said again at once.

Words are read in order. Whenever a block of 2**k words is complete, at places that 2**k divides, a catcher begins to watch the
words that follow for the periods of its level: the first half of every square of such a period holds a whole block. Each word
that is appended moves all catchers forward: the last 2**k words are compared, as a suffix, with each catcher's block, and if they
agree, the two places are a period apart. The names of all runs of 2**k words are made from those of
2**(k - 1) (prefix doubling), so a comparison of suffixes is one of two numbers, and all catchers of a level
take their steps together in numpy. Catches of one period on consecutive blocks belong to one stretch; its ends are found by longest
common suffix and prefix, again from the names. Catches of the same stretch merge into one run, whose period is the smallest.

With n words a level compares 2 n pairs, so a text takes n log n steps whatever it says: nothing is capped. The names take 8 n log2(n)
bytes: 160 MB for a text of a million words. Texts are independent, so nothing is shuffled. Names are 64-bit hashes;
two different stretches of words agree by chance once in 2**64 comparisons.

Inputs: null and wordless texts have no runs and an empty collapsed text. Ids are only carried, so null or repeated ones change
nothing, and repeated rows get equal results. Of the query's planted stretches: a null id plants none. Other columns aren't read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import table
from marquee.llm.textbytes import NOT_SPACE, mix, slices, word_hashes, words_of

WORD = "[^\\x20\\x09-\\x0D]+"
MIN_LENGTH = 12
#: Pairs of a block and a place that are compared in one step.
CELLS = 1 << 22
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def names_of(words: np.ndarray, top: int) -> list[np.ndarray]:
    """Names of the 2**k words from each place on, for k up to top: equal if the words are."""
    out = [words]
    for k in range(min(top, max(len(words), 1).bit_length() - 1)):
        last, half = out[-1], 1 << k
        out.append(mix(mix(last[:-half] + np.uint64(2 * k + 1)) + last[half:]))
    return out


def extended(names: list[np.ndarray], at: np.ndarray, period: np.ndarray, back: bool) -> np.ndarray:
    """How far the words from ``at`` on (or before it) go on being those a period later, as the new ends."""
    at = at.copy()
    for k in reversed(range(len(names))):
        name, step = names[k], 1 << k
        while True:
            first = at - step if back else at
            here = np.flatnonzero((first >= 0) & (first + period < len(name)))
            same = here[name[first[here]] == name[first[here] + period[here]]]
            at[same] += -step if back else step
            if k < len(names) - 1 or not len(same):
                break
    return at


def levels(longest: int, min_length: int) -> Iterator[tuple[int, int, int]]:
    """(k, least period, greatest period): 2**(k + 1) - 1 words that recur hold a block of 2**k. In a run of period p so many recur as
    are left of its length without one period."""
    k, todo = 0, range(1, longest // 2 + 1)
    recurring = lambda p: max(min_length, 2 * p) - p
    level = lambda p: (recurring(p) + 1).bit_length() - 2
    at = 1
    while at in todo:
        k, to = level(at), at
        while to + 1 in todo and level(to + 1) == k and to < 2 * min_length:
            to += 1
        if to >= 2 * min_length and recurring(to) == to:
            to = min(longest // 2, (1 << (k + 2)) - 2)
        yield k, at, to
        at = to + 1


def caught(names: list[np.ndarray], k: int, least: int, greatest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, period) of the stretches of consecutive blocks of 2**k words that recur a period later."""
    name, size, width = names[k], 1 << k, greatest - least + 1
    blocks = -(-max(len(name) - least, 0) // size)
    padded = np.zeros((blocks + 1) * size + greatest + 1, dtype=np.uint64)
    padded[: len(name)] = name
    ahead = np.lib.stride_tricks.sliding_window_view(padded, width)[least::size]
    rows = max(1, CELLS // width)
    for at in range(0, blocks, rows):
        to = min(blocks, at + rows)
        p, b = np.nonzero((ahead[at:to] == padded[: blocks * size : size][at:to, None]).T)
        b, p = (b + at) * size, p + least
        inside = b + p < len(name)
        b, p = b[inside], p[inside]
        begins = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (b[1:] != b[:-1] + size)][: len(b)])
        ends = np.r_[begins[1:], len(b)][: len(begins)] - 1
        yield b[begins], b[ends] + size, p[begins]


def runs_in(words: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period. Texts that stand behind each other must be set apart by
    words that occur once; longest is the number of words of the longest of them."""
    steps = list(levels(longest, min_length)) if longest >= min_length else []
    names = names_of(words, max((k for k, _, _ in steps), default=0))
    found = [np.empty((0, 3), dtype=np.int64)]
    for k, least, greatest in steps:
        if k >= len(names):
            break
        for first, last, period in caught(names, k, least, greatest):
            start = extended(names, first, period, back=True)
            length = extended(names, last, period, back=False) + period - start
            good = length >= np.maximum(min_length, 2 * period)
            found.append(np.stack([start, length, period], axis=1)[good])
    each = np.concatenate(found)
    each = each[np.lexsort((each[:, 2], each[:, 1], each[:, 0]))]
    new = np.r_[True, (each[1:, :2] != each[:-1, :2]).any(axis=1)][: len(each)]  # the smallest period of a stretch
    each = each[new]
    return each[np.lexsort((each[:, 2], each[:, 0]))]


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, n_words, runs, collapsed): all runs of each text by start, then period, places counted in words from 0; collapsed is the
    text's words joined by one space, without what any run says after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                w = words_of(part.column("t"), NOT_SPACE, lower=False)
                first, n = w.first(), len(w.starts)
                # a word of its own after each text
                at = np.arange(n) + w.docs
                x = np.empty(n + w.n_docs, dtype=np.uint64)
                x[at] = word_hashes(w)
                x[first[1:] + np.arange(w.n_docs)] = mix(np.arange(w.n_docs, dtype=np.uint64) + np.uint64(0x51ED270B7F4A7C15))
                size = np.diff(first)
                found = runs_in(x, int(size.max(initial=0)), min_length)
                begin = first[:-1] + np.arange(w.n_docs)
                of = np.searchsorted(begin, found[:, 0], "right") - 1
                gone = np.zeros(len(x) + 1, dtype=np.int64)
                np.add.at(gone, found[:, 0] + found[:, 2], 1)
                np.add.at(gone, found[:, 0] + found[:, 1], -1)
                kept = np.flatnonzero(np.cumsum(gone)[at] == 0)
                edges = np.searchsorted(kept, first)
                raw, a, b = w.data.tobytes(), w.starts[kept].tolist(), w.ends[kept].tolist()
                texts = [b" ".join(raw[i:j] for i, j in zip(a[lo:hi], b[lo:hi], strict=True)) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                items = pa.StructArray.from_arrays([pa.array(c) for c in (found[:, 0] - begin[of], found[:, 1], found[:, 2])], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(w.n_docs + 1)), pa.int32()), items)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    id_type = docs.schema[id_column].dataType.simpleString()
    out = docs.select(docs[id_column].alias("id"), docs[text].alias("t")).mapInArrow(run, f"id {id_type}, n_words long, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", id_column)


def planted(text: Column, doc_id: Column) -> Column:
    """The text as the query wants it: where 10 divides crc32 of the id, all words from a drawn place on repeat a drawn period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


#: Pairs of equal words of a text, at most half of it apart, in stretches of one distance.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), c AS (
  -- h: crc32 of the id's digits
  SELECT rid, w, len(w) AS n,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                         lambda x, y: list_reduce(range(8), lambda z, k: xor(z >> 1, (z & 1) * 3988292384), xor(x, y)),
                         CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM d
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a0 FROM c
), p AS (
  SELECT *, 1 + (n - a0) // (3 + (h // 10) % 8) AS p0 FROM a
), x AS (
  SELECT rid, n, i, CASE WHEN a0 IS NULL OR i < a0 THEN w[i + 1] ELSE w[a0 + (i - a0) % p0 + 1] END AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM p)
), e AS (
  SELECT l.rid, l.i, r.i - l.i AS q FROM x AS l JOIN x AS r ON l.rid = r.rid AND l.x = r.x AND r.i > l.i AND 2 * (r.i - l.i) <= l.n
), g AS (
  SELECT rid, q, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g, i FROM e
), s AS (
  SELECT rid, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY rid, q, g
), r AS (
  SELECT rid, start, length, min(q) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY rid, start, length
), b AS (
  SELECT rid, count(*) AS n_runs, max({'l': length, 's': -start, 'p': -period}) AS m,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid
), o AS (
  SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r
), k AS (
  SELECT x.rid, string_agg(x.x, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN o ON o.rid = x.rid AND o.i = x.i WHERE o.i IS NULL GROUP BY x.rid
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-m.s AS BIGINT) AS start, CAST(m.l AS BIGINT) AS length, CAST(-m.p AS BIGINT) AS period,
       CAST(1000 * m.l // -m.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256,
       CAST(len(w) AS BIGINT) AS n_words
FROM d LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
"""
