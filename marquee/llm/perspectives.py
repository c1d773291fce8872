"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as assistant and the others as
named users; the mask holds the spans (code points of the rendered text, end exclusive) that the assistant says, its
end mark included. System messages belong to no participant and are rendered as system in every perspective.

A dialogue is rendered in parts of ``PART_ROWS`` consecutive messages, so a conversation of any length never becomes one
row; the parts in order are the dialogue, and a mask counts from the begin of its part. Places in the dialogue come from one
sort by range over all messages: the number of a message in the sorted table, less that of the conversation's first in
the same range, and the messages that the conversation has in earlier ranges. So a conversation that holds much of
all rows is spread like any other. Only DataFrame functions are used, and the speakers of a hot conversation are
joined apart.

Markers that a message or a name holds are escaped: a backslash is put between ``<`` and ``|``, one more where there are
some, so that no text can begin or end a turn and the original can be had back. Line ends in names are written out as ``\\n`` and
``\\r``, and backslashes doubled, so that different names stay different.

Inputs: messages are ordered by (turn, speaker, text), null turns and null speakers first. Rows alike in all four columns
are one message. A null speaker is called ``<|unknown|>``, which no other name can be, a null text is empty, rows with a
null conversation are a conversation of their own. One in which only the system speaks has no participant and gives no
row, as does an empty table. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.common import cut, lookup, table

PART_ROWS = 128
BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "<|unknown|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def one_line(name: Column) -> Column:
    """The name with its line ends written out, and what stands for them too, so that no two names become one."""
    for raw, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        name = F.replace(name, F.lit(raw), F.lit(written))
    return name


def header(speaker: Column, perspective: Column) -> Column:
    tag = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(BEGIN), tag, F.lit("\n"))


def numbered(messages: DataFrame) -> DataFrame:
    """Distinct messages (conv, turn, speaker, text) with ``place``, their number in the conversation from 0."""
    rows = cut(messages.orderBy("conv", "turn", "speaker", "text").withColumn("id", F.monotonically_increasing_id()), "sorted-messages")
    rows = rows.withColumn("range", F.shiftright("id", 33))
    runs = rows.groupBy("conv", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as ranges
    starts = cut(runs.withColumn("key", F.struct("conv", "range")).withColumn("offset", F.coalesce(before, F.lit(0)) - F.col("first")).select("key", "offset", "n"), "message-runs")
    placed = lookup(rows.withColumn("key", F.struct("conv", "range")), starts, "key", "n")
    return placed.select("conv", "turn", "speaker", "text", (F.col("id") + F.col("offset")).alias("place"))


def perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """(conversation, perspective, part, n_turns, text, mask): mask is an array of (begin, end)."""
    messages = turns.select(F.struct(turns[conversation].alias("id")).alias("conv"), turns[turn].alias("turn"), turns[speaker].alias("speaker"), F.coalesce(turns[text], F.lit("")).alias("text")).distinct()
    placed = numbered(messages)
    named = F.coalesce(one_line(escaped(F.col("speaker"))), F.lit(UNKNOWN))
    said = placed.select("conv", F.floor(F.col("place") / part_rows).alias("part"), F.struct("place", named.alias("speaker"), escaped(F.col("text")).alias("text")).alias("m"))
    parts = cut(said.groupBy("conv", "part").agg(F.sort_array(F.collect_list("m")).alias("messages")), "dialogue-parts")  # part_rows messages at most
    speakers = parts.select("conv", F.explode(F.array_distinct(F.transform("messages", lambda m: m["speaker"]))).alias("s"))
    speakers = speakers.groupBy("conv").agg(F.array_remove(F.collect_set("s"), SYSTEM).alias("speakers"))
    sizes = parts.groupBy("conv").agg(F.count("*").alias("n"))
    seen = lookup(parts, cut(speakers.join(sizes, "conv"), "speakers"), "conv", "n").withColumn("perspective", F.explode("speakers")).drop("speakers")

    pieces = F.transform(
        "messages",
        lambda m: F.struct(
            header(m["speaker"], F.col("perspective")).alias("head"),
            F.concat(m["text"], F.lit(END)).alias("body"),
            (m["speaker"] == F.col("perspective")).alias("learned"),
        ),
    )
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("mask"))

    def step(done: Column, p: Column) -> Column:
        begin = done["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        spoken = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["learned"], F.concat(done["mask"], spoken)).otherwise(done["mask"]).alias("mask"))

    out = seen.withColumn("pieces", pieces)
    return out.select(F.col("conv.id").alias(conversation), "perspective", "part", F.size("messages").cast("long").alias("n_turns"), rendered.alias("text"), F.aggregate("pieces", nothing, step)["mask"].alias("mask"))


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["begin"].cast("string"), m["end"].cast("string"))), ";")
    return made.withColumn("mask", spans)


ORACLE_SQL = r"""
WITH d AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS raw FROM conversations
), m AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, raw) - 1 AS place,
         coalesce(replace(replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<|unknown|>') AS speaker,
         regexp_replace(raw, '<(\\*)\|', '<\1\\|', 'g') AS text
  FROM d
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'
), r AS (
  SELECT m.conv_id, perspective, place // 128 AS part, place, speaker, text,
         concat('<|im_start|>', CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE concat('user name=', speaker) END, chr(10)) AS head,
         concat(text, '<|im_end|>') AS body
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY place) AS upto FROM r
)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
       string_agg(concat(head, body, chr(10)), '' ORDER BY place) AS text,
       coalesce(string_agg(concat(CAST(upto - 1 - length(body) AS BIGINT), '-', CAST(upto - 1 AS BIGINT)), ';' ORDER BY place) FILTER (speaker = perspective), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
