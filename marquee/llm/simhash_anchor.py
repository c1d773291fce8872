"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most two bits. The anchors are the words of the Hamming code of
length 63 over the lower 63 bits, a perfect code with covering radius 1. Two fingerprints that link have a point m
at most one bit from either (half the threshold), and m has an anchor within the radius 1: so both lie within
1 + 1 = 2 bits of one common anchor. A fingerprint is therefore copied to every anchor within 2 bits (one if it is
itself a code word, else 32), which loses no link, and fingerprints are compared only with those at the same anchor.
At most 2 * (1 + 63 + 1953) distinct fingerprints fit within 2 bits of an anchor, so no group is ever unbounded;
copies of one fingerprint are folded into one row before.

Inputs: null and wordless texts have fingerprint zero, and link like any other. Rows with a null id belong to the
group of their fingerprint; a group in which no row has an id has a null component. Repeated rows get equal results.
Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import cut, dealt, lookup, table
from marquee.llm.components import components
from marquee.llm.textbytes import NOT_SPACE, slices, words_of

SEED = 42
THRESHOLD = 2
#: Fingerprints of a task that copies them to their anchors, 32 each.
SPREAD_ROWS = 50_000


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run hashes[first[i]:first[i + 1]]: the bits that are set in over half of it.

    Eight bits are counted at once in the bytes of a word, 255 rows at most before the bytes are spread out."""
    n = np.diff(first)
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    pieces = -(-n[some] // 255)
    owner = np.repeat(np.arange(len(some)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[:-1][some][owner] + 255 * nth
    lanes = np.uint64(0x0101010101010101)
    whole = np.cumsum(pieces) - pieces
    for j in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(j)) & lanes, begin)
        for k in range(8):
            ones = np.add.reduceat((packed >> np.uint64(8 * k)) & np.uint64(255), whole)
            out[some] |= (2 * ones > n[some].astype(np.uint64)).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprints_of(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    w = words_of(texts, NOT_SPACE)
    first = w.first()
    # one space between words, so that a shingle is a slice
    lengths = w.ends - w.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, dtype=np.uint8)
    at = np.flatnonzero(NOT_SPACE[w.data])
    joined[np.repeat(starts - w.starts, lengths) + at] = w.data[at]
    # a shingle begins at every word that has enough words after it in its text; a short text is one shingle
    left = first[1:][w.docs] - np.arange(len(w.docs))
    begins = np.flatnonzero((left >= shingle) | ((np.arange(len(w.docs)) == first[:-1][w.docs]) & (left < shingle)))
    last = begins + np.minimum(shingle, left[begins]) - 1
    raw, h = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((h(raw[a:b], SEED) for a, b in zip(starts[begins].tolist(), ends[last].tolist(), strict=True)), dtype=np.uint64, count=len(begins))
    return majority(hashes, np.searchsorted(begins, first))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the SimHash of every row's whole text as a long."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                fp = fingerprints_of(part.column("t"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], names=["id", "fp"])

    found = docs.select(docs[id_column].alias("id"), docs[text].alias("t")).mapInArrow(run, f"id {id_type}, fp long")
    return found.withColumnRenamed("id", id_column)


def syndrome(low: Column, r: int) -> Column:
    """The XOR of the numbers (from 1) of the set bits among the lower 2**r - 1."""
    total = F.lit(0)
    for b in range(r):
        mask = sum(1 << (i - 1) for i in range(1, 1 << r) if i >> b & 1)
        total = total + F.bit_count(low.bitwiseAND(F.lit(mask))) % 2 * (1 << b)
    return total


def anchors(value: Column, r: int = 6) -> Column:
    """All words of the Hamming code of length 2**r - 1 within two bits of the value's lower bits."""
    low = value.bitwiseAND(F.lit((1 << ((1 << r) - 1)) - 1))
    s = syndrome(low, r)

    def bit(i: Column) -> Column:
        return F.when(i == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (i - 1).cast("int")))

    # pairs i ^ j = s; (0, s) flips one bit only
    pairs = F.filter(F.sequence(F.lit(0), F.lit((1 << r) - 1)), lambda i: i < i.bitwiseXOR(s))
    return F.when(s == 0, F.array(low)).otherwise(F.transform(pairs, lambda i: low.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(s)))))


def distances(some: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing bits between rows of words and one row, or rows."""
    return np.bitwise_count(some ^ one).sum(axis=1, dtype=np.int64)


def forest(values: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges (row, row) that connect what links among distinct fingerprints: a tree grows from a row over all rows it
    reaches, each looked at once, then the next tree. A dense group is used up by its first few rows."""
    out: list[tuple[int, int]] = []
    rest = np.arange(len(values))
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = distances(values[rest], values[at]) <= threshold
            out += [(int(at), int(x)) for x in rest[near]]
            reached += rest[near].tolist()
            rest = rest[~near]
    return out


def links(placed: DataFrame, node: str, words: list[str], threshold: int) -> DataFrame:
    """(a, b): nodes whose fingerprints (the words) are within the threshold and that share an anchor; enough of these
    pairs to connect all of them. placed has a row for each node and anchor."""
    sorted_rows = placed.select("anchor", node, *words).repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(anchor: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            nodes, f = rows[:, 0], rows[:, 1:].view(np.uint64)
            first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.empty(0, dtype=np.int64)
            size = np.diff(np.r_[first, len(anchor)])
            two = first[size == 2]
            two = two[distances(f[two], f[two + 1]) <= threshold]
            more = [(i + a, i + b) for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True) for a, b in forest(f[i : i + n], threshold)]
            e = np.array(more, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(nodes[np.r_[two, e[:, 0]]]), pa.array(nodes[np.r_[two + 1, e[:, 1]]])], names=["a", "b"])

        kept_a, kept = np.empty(0, dtype=np.int64), np.empty((0, 1 + len(words)), dtype=np.int64)
        for batch in batches:
            anchor = np.r_[kept_a, batch.column(0).to_numpy()]
            rows = np.r_[kept, np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)]
            cut_at = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last group may go on
            yield compare(anchor[:cut_at], rows[:cut_at])
            kept_a, kept = anchor[cut_at:], rows[cut_at:]
        yield compare(kept_a, kept)

    return sorted_rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links, the row's own included."""
    prints = cut(fingerprints(docs, id_column, text, shingle), "fingerprints")
    groups = cut(prints.groupBy("fp").agg(F.min(id_column).alias("least"), F.count("*").alias("w")), "fp-groups")
    spread = dealt(groups.select("fp"), SPREAD_ROWS)
    placed = spread.select("fp", F.col("fp").alias("f"), F.explode(anchors(F.col("fp"))).alias("anchor"))
    roots = components(links(placed, "fp", ["f"], THRESHOLD)).withColumnRenamed("node", "fp")
    rooted = cut(groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fp-roots")
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("wr")), "root-names")
    by_fp = cut(lookup(rooted, named, "root", "wr").select("fp", "component_id", "w"), "fp-components")
    return lookup(prints, by_fp, "fp", "w").select(id_column, "fp", "component_id")


def op9_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
