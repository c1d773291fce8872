"""Quality rules as a short-circuit cascade.

Every rule is a predicate that rejects a text. Its cost and its selectivity are measured on a sample, the rules are
ordered by rejections per unit of cost, and one CASE expression tries them in that order: a text that a cheap rule
rejects never reaches a dear one. The order changes the time, never the verdict. Only built-in functions are used.

Words are ``[^\\x20\\x09-\\x0D]+``; null counts as the empty text. Rows are judged one by one, so ties, repeated rows
and null ids change nothing, and columns besides the text are carried along untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import cut, table

SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
BULLET, ELLIPSIS = "^[ \\t]*[-*\\x{2022}]", "(\\.\\.\\.|\\x{2026})[ \\t\\r]*\\z"
#: The begin of a word up to its first letter, of ASCII or any character beyond it.
LETTER_WORD = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0DA-Za-z\\x{80}-\\x{10FFFF}]*+[A-Za-z\\x{80}-\\x{10FFFF}]"

#: How many rows the costs are measured on at most, in expectation. The verdicts cover all rows.
SAMPLE_ROWS = 2000


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def word_chars(text: Column) -> Column:
    return F.length(without(text, SPACES)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(without(text, SYMBOLS))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.length(without(line, SPACES)) > 0)


def n_dup_lines(text: Column) -> Column:
    lines = lines_with_words(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def gram_hashes(found: Column) -> Column:
    """A hash for each window of three words."""
    last = F.size(found) - 3
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(found[i], found[i + 1], found[i + 2])))


def repeated_starts(hashes: Column) -> Column:
    """Ascending positions of the hashes that occur twice or more; null where all differ.

    Sorting keeps it at n log n however often a window repeats."""
    ranked = F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    return let(
        ranked,
        lambda r: F.sort_array(
            F.transform(
                F.filter(
                    r,
                    lambda x, i: ((i > 0) & (F.get(r, i - 1)["h"] == x["h"])) | F.coalesce(F.get(r, i + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )


def covered(starts: Column) -> Column:
    """Positions within the windows of three that begin at the starts."""
    gaps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_repeat_words(found: Column) -> Column:
    starts = let(gram_hashes(found), repeated_starts)
    return F.coalesce(let(starts, covered), F.lit(0)).cast("long")


def n_listed(text: Column) -> Column:
    """Lines that begin with a bullet."""
    return F.size(F.filter(lines_with_words(text), lambda line: line.rlike(BULLET))).cast("long")


def n_cut_off(text: Column) -> Column:
    """Lines that end with an ellipsis."""
    return F.size(F.filter(lines_with_words(text), lambda line: line.rlike(ELLIPSIS))).cast("long")


def n_plain_words(text: Column) -> Column:
    """Words with a letter."""
    return F.regexp_count(text, F.lit(LETTER_WORD)).cast("long")


def longest_word(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, F.length)), F.lit(0)).cast("long")


#: name -> the measure as an expression of the text and its words
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, found: F.size(found).cast("long"),
    "word_chars": lambda text, found: word_chars(text),
    "n_symbols": lambda text, found: n_symbols(text),
    "n_dup_lines": lambda text, found: n_dup_lines(text),
    "n_repeat_words": lambda text, found: n_repeat_words(found),
    "n_lines": lambda text, found: F.size(lines_with_words(text)).cast("long"),
    "n_listed": lambda text, found: n_listed(text),
    "n_cut_off": lambda text, found: n_cut_off(text),
    "n_plain_words": lambda text, found: n_plain_words(text),
    "longest_word": lambda text, found: longest_word(found),
}


@dataclass(frozen=True)
class Rule:
    """rejects gets the measures by name, as columns."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


#: The production rules. The first two are the base rules.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50),
    Rule("symbols", lambda m: m["n_symbols"] * 10 > m["n_words"] * 3),
    Rule("repeated_lines", lambda m: m["n_dup_lines"] * 100 > m["n_lines"] * 40),
    Rule("word_length", lambda m: F.abs(m["word_chars"] * 2 - m["n_words"] * 17) > m["n_words"] * 13),  # 2 to 15 on average
    Rule("bullets", lambda m: m["n_listed"] * 10 > m["n_lines"] * 9),
    Rule("ellipses", lambda m: m["n_cut_off"] * 10 > m["n_lines"] * 3),
    Rule("no_letters", lambda m: m["n_plain_words"] * 10 < m["n_words"] * 7),
    Rule("endless_word", lambda m: m["longest_word"] > 1000),
)
BASE = ("few_words", "repeated_words")


class Inline(Mapping):
    """The measures as expressions of a text and its words, each built where a rule asks for it; known ones are columns."""

    def __init__(self, text: Column, found: Column, known: Mapping[str, Column] | None = None):
        self.text, self.found, self.known = text, found, known or {}

    def __getitem__(self, name: str) -> Column:
        return self.known[name] if name in self.known else MEASURES[name](self.text, self.found)

    def __iter__(self):
        return iter(MEASURES)

    def __len__(self):
        return len(MEASURES)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float
    per_cost: float = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "per_cost", self.rejected / max(self.seconds, 1e-4))


def estimate(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 17, known: tuple[str, ...] = ()) -> list[Estimate]:
    """Each rule's cost and selectivity on a sample, best rejection per cost first; ties by name. Known measures cost nothing.

    An empty table gives every rule no rejections and the order of the names."""
    rows = docs.count()
    part = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).sample(fraction=min(1.0, sample_rows / max(rows, 1)), seed=seed)
    part = part.withColumn("w", words(F.col("t")))
    sample = cut(part.withColumns({f"known_{c}": MEASURES[c](F.col("t"), F.col("w")) for c in known}), "cascade-sample")
    columns = {c: F.col(f"known_{c}") for c in known}

    def timed(rejects: Column) -> tuple[float, float]:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            share = sample.agg(F.avg(rejects.cast("int"))).first()[0]
            runs.append(time.perf_counter() - began)
        return min(runs), share or 0.0

    floor, _ = timed(F.length("t") < 0)
    found = []
    for rule in rules:
        seconds, share = timed(rule.rejects(Inline(F.col("t"), F.col("w"), columns)))
        found.append(Estimate(rule, max(seconds - floor, 0.0), share))
    return sorted(found, key=lambda e: (-e.per_cost, e.rule.name))


def verdict(measures: Mapping[str, Column], order) -> Column:
    """The name of the first rule, in this order, that rejects; null if none does."""
    case = None
    for rule in order:
        case = (F if case is None else case).when(rule.rejects(measures), F.lit(rule.name))
    return F.lit(None).cast("string") if case is None else case


def cascade(docs: DataFrame, rules=RULES, text: str = "text", order=None) -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    order = order or [e.rule for e in estimate(docs, rules, text)]
    t = F.coalesce(docs[text], F.lit(""))
    # all rules want the words, which are found once
    return docs.filter(let(words(t), lambda w: verdict(Inline(t, w), order)).isNull())


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the text (t), its words (w) and the base measures of every row. The steps are columns of their own so that each is
    computed once."""
    base = docs.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("t"))
    steps = base.select("*", word_chars(F.col("t")).alias("word_chars"), n_symbols(F.col("t")).alias("n_symbols"), n_dup_lines(F.col("t")).alias("n_dup_lines"), words(F.col("t")).alias("w"))
    steps = steps.withColumns({"n_words": F.size("w").cast("long"), "h": gram_hashes(F.col("w"))})
    steps = steps.withColumn("starts", repeated_starts(F.col("h"))).drop("h")
    return steps.withColumn("n_repeat_words", F.coalesce(covered(F.col("starts")), F.lit(0)).cast("long")).drop("starts")


#: What the query returns of every row, and so is known before the cascade.
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures are wanted of every row; all others are worked out by the cascade, for the texts that come so far."""
    docs = table(spark, sf_dir, "documents")
    order = [e.rule for e in estimate(docs, known=BASE_MEASURES)]
    m = measured(docs)
    base = {c: F.col(c) for c in BASE_MEASURES}
    base_failed = reduce(lambda a, b: a | b, (rule.rejects(base) for rule in RULES if rule.name in BASE))
    rejected_by = verdict(Inline(F.col("t"), F.col("w"), base), order)
    # a text that fails the base doesn't enter the cascade
    kept = F.when(base_failed, F.lit(False)).otherwise(rejected_by.isNull())
    return m.select("doc_id", *BASE_MEASURES, base_failed.alias("base_failed"), kept.alias("kept"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS a FROM w WHERE len(ws) >= 3
), n AS (
  SELECT rid, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM g WINDOW o AS (PARTITION BY rid ORDER BY i)
), k AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM n WHERE c IS NOT NULL
), r AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n >= 2) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(len(ls) AS BIGINT) AS n_lines,
         len(list_filter(ls, lambda s: regexp_matches(s, '^[ \t]*[-*\x{2022}]'))) AS n_listed,
         len(list_filter(ls, lambda s: regexp_matches(s, '(\.\.\.|\x{2026})[ \t\r]*\z'))) AS n_cut_off,
         len(list_filter(ws, lambda s: regexp_matches(s, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_plain_words,
         coalesce(list_max(list_transform(ws, lambda s: length(s))), 0) AS longest_word,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 40 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_listed > 9 * n_lines OR 10 * n_cut_off > 3 * n_lines
         OR 10 * n_plain_words < 7 * n_words OR longest_word > 1000) AS kept
FROM b
"""
