"""Line dedup: repeated runs of lines, found with a suffix array over line ids built by prefix doubling.

Every line with a word gets a symbol (128 bits of hash of the line, white space squeezed); a document is the sequence
of its symbols. Round k knows, of each suffix whose first 2**k lines occur more than once, the rank of those lines
among all such prefixes; pairing the ranks at i and i + 2**k, sorting the distinct repeated pairs by range and
numbering them gives round k + 1. A suffix whose prefix is unique has its final place in the array and drops out, so
the rounds shrink and end after log2 of the longest repeated run. Suffixes of one rank in round k are an interval of
the array with a longest common prefix of 2**k lines or more, that is, all copies of one run of 2**k lines.

A block is a later copy if its interval holds an earlier position, in the order of (id, text, line). With l the length
of the longest run at i that occurs earlier and 2**k <= l < 2**(k + 1), the blocks of 2**k lines at i and at
i + l - 2**k cover it: so the later blocks of all suffixes make up exactly the maximal repeated runs, and these lines
are deleted. Runs under ``min_lines`` (a power of two) stay, but a line of ``min_words`` or more is deleted by itself.

Only DataFrame functions are used. Hot lines are counted with combining aggregates before they are joined back, with
hot keys apart.

Inputs: null text has no lines and stays null. Lines without a word are in no sequence; they go where they lie within
a deleted run. Rows that share id and text count as one document and are treated alike; a null id ranks first.
Columns besides id and text are carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.common import cut, lookup, quoted, table

SPACE = "[\\x20\\x09-\\x0D]+"
MIN_LINES = 2
MIN_WORDS = 20


def squeezed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACE, " "))


def sequences(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc, k, line, key, words): the lines with words, numbered k within their document."""
    doc = F.struct(docs[id_column].alias("id"), F.xxhash64(docs[text]).alias("t"))
    lines = F.filter(
        F.transform(F.split(docs[text], "\n"), lambda x, i: F.struct(i.alias("line"), squeezed(x).alias("s"))),
        lambda x: x["s"] != "",
    )
    each = docs.select(doc.alias("doc"), F.posexplode(lines).alias("k", "x"))
    key = F.struct(F.xxhash64("x.s").alias("a"), F.xxhash64(F.lit("second"), "x.s").alias("b"))
    return each.select("doc", "k", F.col("x.line").alias("line"), key.alias("key"), (F.length("x.s") - F.length(F.translate("x.s", " ", "")) + 1).alias("words"))


def ranked(keyed: DataFrame, name: str) -> DataFrame:
    """(key, n, first, rank) of the keys that occur more than once; rank follows the order of the keys.

    The keys are distinct here, so sorting them by range meets no hot key, and the number of a row in the sorted
    output is an order-preserving rank without any global window."""
    repeated = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc", "k")).alias("first")).filter("n > 1")
    return cut(repeated.orderBy("key").withColumn("rank", F.monotonically_increasing_id()), name)


def later_blocks(lines: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(doc, k, size, first): the blocks of lines that have an earlier copy, first being the earliest."""
    found, size = [], 1
    tied = cut(lookup(lines.select("doc", "k", "key", "words"), ranked(lines, "line-ranks"), "key", "n").select("doc", "k", "words", "rank", "first").distinct(), "tied-1")
    while True:
        later = F.col("first") < F.struct("doc", "k")
        if size >= min_lines:
            found.append(tied.filter(later).select("doc", "k", F.lit(size).alias("size"), "first"))
        elif size == 1:
            found.append(tied.filter(later & (F.col("words") >= min_words)).select("doc", "k", F.lit(1).alias("size"), "first"))
        ahead = tied.select("doc", (F.col("k") - size).alias("k"), F.col("rank").alias("next"))
        pairs = cut(tied.join(ahead, ["doc", "k"]).select("doc", "k", F.struct("rank", "next").alias("key")), "rank-pairs")
        ranks = ranked(pairs, "pair-ranks")
        size *= 2
        if ranks.isEmpty():
            return reduce(DataFrame.union, found)
        tied = cut(lookup(pairs, ranks, "key", "n").select("doc", "k", F.lit(0).alias("words"), "rank", "first"), f"tied-{size}")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, from_line, to_line, n_lines, first): the maximal runs of lines to delete, by line numbers from 0.

    first is the place of the earliest copy of the run's first block. Runs that touch are one run."""
    if min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    lines = cut(sequences(docs, id_column, text), "line-sequences")
    blocks = later_blocks(lines, min_lines, min_words)
    longest = blocks.groupBy("doc", "k").agg(F.max(F.struct("size", "first")).alias("b")).select("doc", "k", (F.col("k") + F.col("b.size")).alias("end"), "b.first")
    order = Window.partitionBy("doc").orderBy("k")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("k") <= F.col("before"), 0).otherwise(1)).over(order)
    runs = longest.withColumn("before", before).withColumn("run", island).groupBy("doc", "run").agg(F.min("k").alias("k"), F.max("end").alias("end"), F.min_by("first", "k").alias("first"))
    at = lines.select("doc", "k", "line").distinct()
    begins = runs.join(at.withColumnRenamed("line", "from_line"), ["doc", "k"])
    ends = at.select("doc", (F.col("k") + 1).alias("end"), F.col("line").alias("to_line"))
    return begins.join(ends, ["doc", "end"]).select("doc", "from_line", "to_line", (F.col("end") - F.col("k")).alias("n_lines"), "first")


def cleaned(docs: DataFrame, min_lines: int, min_words: int, id_column: str, text: str) -> DataFrame:
    """(row: a struct of the columns of docs, cleaned, n_runs, n_lines): the text without later copies, and how many runs and
    lines with words are gone."""
    runs = repeated_runs(docs, min_lines, min_words, id_column, text)
    of_doc = runs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("from_line", "to_line"))).alias("runs"), F.sum("n_lines").alias("n_deleted"))
    doc = F.struct(docs[id_column].alias("id"), F.xxhash64(docs[text]).alias("t"))
    joined = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), doc.alias("doc")).join(of_doc, "doc", "left")
    split = F.split(F.col("row")[text], "\n")
    # what lies before each run, and after the last
    bounds = F.concat(F.array(F.struct(F.lit(-1).alias("from_line"), F.lit(-1).alias("to_line"))), "runs")
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("runs")),
            lambda j: F.slice("lines", F.get("bounds", j)["to_line"] + 2, F.coalesce(F.get("runs", j)["from_line"], F.size("lines")) - F.get("bounds", j)["to_line"] - 1),
        )
    )
    rest = joined.withColumn("lines", F.when(F.col("runs").isNotNull(), split)).withColumn("bounds", bounds)
    left = F.when(F.col("runs").isNull(), F.col("row")[text]).otherwise(F.array_join(kept, "\n"))
    n_runs = F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long")
    return rest.select("row", left.alias("cleaned"), n_runs.alias("n_runs"), F.coalesce("n_deleted", F.lit(0)).cast("long").alias("n_lines"))


def columns_with(docs: DataFrame, replaced: dict[str, Column]) -> list[Column]:
    """The columns of docs out of ``row``, some of them replaced."""
    return [replaced[c].alias(c) if c in replaced else F.col("row")[c].alias(c) for c in docs.columns]


def without_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the later copies cut out of the text, and two columns more, ``deleted_runs`` and ``deleted_lines`` (lines with
    words), which replace columns of these names."""
    new = {"deleted_runs": F.col("n_runs"), "deleted_lines": F.col("n_lines")}
    kept = docs.select(*(quoted(c) for c in docs.columns if c not in new))
    return cleaned(docs, min_lines, min_words, id_column, text).select(*columns_with(kept, {text: F.col("cleaned")}), *(c.alias(n) for n, c in new.items()))


def left_over(docs: DataFrame, length: str = "n_chars", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the later copies cut out of the text and the length (code points) set anew, where there is such a column;
    documents that lose their last word go."""
    found = cleaned(docs, MIN_LINES, MIN_WORDS, id_column, text).filter((F.col("n_runs") == 0) | F.col("cleaned").rlike("[^\\x20\\x09-\\x0D]"))
    new = {text: F.col("cleaned")}
    if length in docs.columns:
        new[length] = F.when(F.col("n_runs") == 0, F.col("row")[length]).otherwise(F.length("cleaned")).cast(docs.schema[length].dataType)
    return found.select(*columns_with(docs, new))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = without_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "deleted_runs", "deleted_lines", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, text, i, trim(regexp_replace(ls[i], '[\x20\x09-\x0D]+', ' ', 'g')) AS s, ls[i] AS raw
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)
), w AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS k, len(string_split(s, ' ')) AS n FROM l WHERE s <> ''
), p AS (
  SELECT *, lead(s) OVER (PARTITION BY rid ORDER BY k) AS s2 FROM w
), f AS (
  SELECT rid, k, n,
         row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1 AS later1,
         s2 IS NOT NULL AND row_number() OVER (PARTITION BY s, s2 ORDER BY doc_id, k) > 1 AS later2
  FROM p
), x AS (
  SELECT rid, k FROM f WHERE later1 AND n >= 20
  UNION SELECT rid, k FROM f WHERE later2
  UNION SELECT rid, k + 1 FROM f WHERE later2
), r AS (
  SELECT rid, count(*) AS deleted_lines, count(*) FILTER (first) AS deleted_runs
  FROM (SELECT rid, k, coalesce(k - lag(k) OVER (PARTITION BY rid ORDER BY k) <> 1, true) AS first FROM x) GROUP BY rid
), y AS (
  SELECT l.rid, l.i, l.raw, w.k, x.k IS NOT NULL AS gone FROM l LEFT JOIN w USING (rid, i) LEFT JOIN x ON x.rid = w.rid AND x.k = w.k
), z AS (
  SELECT rid, i, raw, CASE WHEN k IS NOT NULL THEN gone ELSE
    coalesce(last_value(CASE WHEN k IS NOT NULL THEN gone END IGNORE NULLS) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    AND coalesce(first_value(CASE WHEN k IS NOT NULL THEN gone END IGNORE NULLS) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) END AS gone
  FROM y
), t AS (
  SELECT rid, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM z GROUP BY rid
)
SELECT doc_id, CAST(coalesce(deleted_runs, 0) AS BIGINT) AS deleted_runs, CAST(coalesce(deleted_lines, 0) AS BIGINT) AS deleted_lines,
       CAST(length(kept) AS BIGINT) AS kept_chars, md5(kept) AS kept_md5
FROM d LEFT JOIN t USING (rid) LEFT JOIN r USING (rid)
"""
