"""The corpus pipeline: documents through five of the operators, each stage written before the next reads it.

Every stage takes any table with the columns of documents, whatever others it has, and all but the last return the columns they
got. Nulls, empty texts, ties, repeated rows and empty tables have the results that the operators' modules state, of
which each stage says the ones that decide what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import decontaminate, line_runs, mixing, near_copies, quality_cascade
from marquee.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects. Rows are judged one by one; a null text has no words and is rejected."""
    return quality_cascade.cascade(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the later copies of repeated runs of lines; n_chars follows the text. Of equal lines those of the
    smallest id stay, null ids first; rows that share id and text are one document. Documents of which no word is left go."""
    return line_runs.left_over(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id, null ids last; of rows that share it the first."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item. Of rows that share an id all go if one is hit; rows of a
    null id stay."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each epoch that takes a document, with ``n_tokens, epoch, take_tokens``. Ties of the seeded order
    go by id; null languages and sources are the empty name."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Near-duplicates have no SQL; a test compares run() with a plain version over the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
