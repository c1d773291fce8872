"""One of each group of near-duplicates: SimHash anchors and bands of minima give candidates, exact similarity decides.

Two texts link if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; groups are what links connect.
Three searches give candidates, whose texts are then compared:

1. Anchors. Texts whose 64-bit SimHashes over the shingles differ in at most two bits meet at an anchor of the Hamming code
   (see ``simhash_anchor``). This takes in copies that are all but equal, and no link of that distance is missed.
2. Bands. At similarity 0.8 some ten bits differ, which no bounded number of anchors reaches. So texts also share a bucket if one of
   24 bands of five minima of the shingles' hashes is equal. Of pairs at exactly 0.8, wherever their words
   differ, 7 in 100,000 share no bucket. In a bucket every text is first compared with the most central one, that whose
   buckets are the fullest, which joins most of what can be joined.
3. What is left: in a bucket that still holds several groups, all texts outside its main group are compared with all its
   texts. In small buckets by pairs; in larger ones block by block within tasks, as products of 0/1 matrices, of which a task
   returns only the links that join groups. So no step writes more rows than some texts times their buckets and blocks.

Inputs: a null text has no words, as has an empty one, and texts without words are copies of each other; a text of one to four
words is one shingle. Rows are told apart by a number they get when they are written, so equal ids of unlike texts both
stay. Of a group the row with the smallest id stays (null ids last), of equal ids the first written. Any columns are
carried, whatever their names and types. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import cut, dealt, lookup, quoted
from marquee.llm.components import components
from marquee.llm.simhash_anchor import SPREAD_ROWS, THRESHOLD, anchors, links, majority
from marquee.llm.textbytes import NOT_SPACE, mix, slices, word_hashes, words_of

#: Similarity of a link, in percent, and words of a shingle.
SIMILAR = 80
SHINGLE = 5
BANDS, BAND_ROWS = 24, 5
#: Buckets up to this size are compared by pairs of rows.
PAIRED = 48
#: Weight of one side of a block, in expectation; a text weighs its shingles, or LEAST_WEIGHT, so that 2000 are a block at most.
BLOCK_WEIGHT, LEAST_WEIGHT = 200_000, 100
#: Columns of the matrices that are multiplied at once.
WIDTH = 4096


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, in order; a text of fewer words is one shingle."""
    w = words_of(texts, NOT_SPACE)
    h, first = word_hashes(w), w.first()
    left = first[1:][w.docs] - np.arange(len(h))
    after = np.r_[h, np.zeros(SHINGLE, dtype=np.uint64)]
    total = np.zeros(len(h), dtype=np.uint64)
    for j in range(SHINGLE):
        total += np.where(left > j, after[j : j + len(h)], np.uint64(0)) * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
    at = np.flatnonzero((left >= SHINGLE) | (np.arange(len(h)) == first[:-1][w.docs]))
    of, s = w.docs[at], mix(total[at])
    order = np.lexsort((s, of))
    of, s = of[order], s[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (s[1:] != s[:-1])][: len(s)]
    return of[new], s[new]


def shingled(rows: DataFrame) -> DataFrame:
    """(row, id, fp, sim, n, keys) of rows (row, id, t): a hash of the text's set of shingles, its SimHash and its size, and the
    keys of its bands (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                of, s = shingle_sets(part.column("t"))
                n = np.bincount(of, minlength=part.num_rows)
                some = np.flatnonzero(n)
                first = np.searchsorted(of, some)
                fp = np.zeros(part.num_rows, dtype=np.uint64)
                keys = np.zeros((len(some), BANDS), dtype=np.uint64)
                if len(some):
                    fp[some] = np.add.reduceat(mix(s), first)
                    for i in range(BANDS * BAND_ROWS):
                        odd, salt = (np.uint64((0x9E3779B97F4A7C15 * (2 * i + k)) % 2**64) for k in (1, 2))
                        least = np.minimum.reduceat((s ^ mix(salt[None])[0]) * (mix(odd[None])[0] | np.uint64(1)), first)
                        keys[:, i // BAND_ROWS] = mix(keys[:, i // BAND_ROWS] + least + np.uint64(i))
                sim = majority(s, np.searchsorted(of, np.arange(part.num_rows + 1)))
                offsets = np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)
                arrays = [part.column("row"), part.column("id"), pa.array(fp.view(np.int64)), pa.array(sim.view(np.int64)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "fp", "sim", "n", "keys"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.select("row", "id", "t").mapInArrow(run, f"row long, id {id_type}, fp long, sim long, n int, keys array<long>")


def pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def may_link(n: Column, n2: Column) -> Column:
    """Sets of too different sizes can't be similar."""
    return F.least(n, n2) * 100 >= F.greatest(n, n2) * SIMILAR


@dataclass
class Texts:
    """bodies (row, t), the row that stands for each group (fp, row), and how the sets of some bodies are found (text number, hash)."""

    bodies: DataFrame
    rows: DataFrame
    sets: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] = shingle_sets

    def of(self, fps: DataFrame, name: str) -> DataFrame:
        """(fp, t) of some groups. Their rows are written before, so that Spark knows the size and broadcasts few."""
        wanted = cut(self.rows.join(fps.select("fp").distinct(), "fp", "left_semi"), f"{name}-rows")
        return cut(self.bodies.join(wanted, "row").select("fp", "t"), f"{name}-texts")


def similar(pairs: DataFrame, texts: Texts, name: str) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    pairs = cut(pairs.select("a", "b").distinct(), f"{name}-pairs")
    known = texts.of(pairs.select(F.explode(F.array("a", "b")).alias("fp")), name)

    def side(x: str) -> DataFrame:
        return known.select(F.col("fp").alias(x), F.col("t").alias(f"t{x}")).join(pairs.groupBy(x).agg(F.count("*").alias("w")), x)

    sets = texts.sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta"):
                (of_a, a), (of_b, b) = sets(part.column("ta")), sets(part.column("tb"))
                of, s = np.r_[of_a, of_b], np.r_[a, b]
                order = np.lexsort((s, of))
                of, s = of[order], s[order]
                shared = np.bincount(of[1:][(of[1:] == of[:-1]) & (s[1:] == s[:-1])], minlength=part.num_rows)
                either = np.bincount(of, minlength=part.num_rows) - shared
                yield part.select(["a", "b"]).filter(pa.array(100 * shared >= SIMILAR * either))

    both = lookup(lookup(pairs, side("a"), "a", "w"), side("b"), "b", "w")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), f"{name}-links")


def anchored(groups: DataFrame) -> DataFrame:
    """(a, b): pairs of groups whose SimHashes are within the threshold, enough to connect all of them."""
    sims = cut(groups.groupBy("sim").agg(F.min("fp").alias("rep"), F.count("*").alias("w")), "sims")
    # what has one SimHash is compared with one of them
    alike = lookup(groups.select("fp", "sim"), sims, "sim", "w").filter("fp <> rep").select(*pair("fp", "rep"))
    spread = dealt(sims.select("sim", "rep"), SPREAD_ROWS)
    placed = spread.select(F.col("rep").alias("fp"), F.col("sim").alias("f"), F.explode(anchors(F.col("sim"))).alias("anchor"))
    return alike.unionByName(links(placed, "fp", ["f"], THRESHOLD).select(*pair("a", "b")))


def joining(few: tuple, all_of: tuple, few_sets: tuple, all_sets: tuple) -> list[tuple[int, int]]:
    """Links (fp, fp) between the few and all texts of a block, given as (fps, sizes, roots) and their sets: of those that are
    similar, enough to connect what they connect."""
    (fa, na, ra), (fb, nb, rb) = few, all_of
    (of_a, a), (of_b, b) = few_sets, all_sets
    known = np.intersect1d(a, b)  # np.unique of either, kept where both have it
    ia, ib = np.isin(a, known), np.isin(b, known)
    of_a, ca = of_a[ia], np.searchsorted(known, a[ia])
    of_b, cb = of_b[ib], np.searchsorted(known, b[ib])
    shared = np.zeros((len(fa), len(fb)), dtype=np.float32)
    for at in range(0, len(known), WIDTH):
        x, y = np.zeros((len(fa), WIDTH), dtype=np.float32), np.zeros((len(fb), WIDTH), dtype=np.float32)
        for m, of, c in ((x, of_a, ca), (y, of_b, cb)):
            here = (c >= at) & (c < at + WIDTH)
            m[of[here], c[here] - at] = 1
        shared += x @ y.T
    found = np.argwhere((100 * shared >= SIMILAR * (na[:, None] + nb[None] - shared)) & (ra[:, None] != rb[None]))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in found:
        p, q = root(int(ra[i])), root(int(rb[j]))
        if p != q:
            parent[p] = q
            out.append((int(fa[i]), int(fb[j])))
    return out


def blockwise(members: DataFrame, texts: Texts) -> DataFrame:
    """(a, b): links between texts of different roots in the same bucket; members (key, fp, n, root, main, total, odd): total and odd
    are the weights of the bucket's texts, and of those outside the main root."""
    rows = members.join(texts.of(members, "block"), "fp")
    here, there = (F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_WEIGHT)).cast("int") for c in ("odd", "total"))
    number = lambda blocks: F.pmod(F.xxhash64("fp"), blocks).cast("int")
    cell = lambda i, j, few: F.struct(i.alias("i"), j.alias("j"), F.lit(few).alias("few"))
    every = F.transform(F.sequence(F.lit(0), here - 1), lambda i: cell(i, number(there), False))
    few = F.transform(F.sequence(F.lit(0), there - 1), lambda j: cell(number(here), j, True))
    cells = F.when(F.col("root") != F.col("main"), F.concat(every, few)).otherwise(every)
    dealt = rows.withColumn("at", F.explode(cells)).select("key", "at.i", "at.j", "at.few", "fp", "n", "root", "t")
    sets = texts.sets

    def run(cell: pa.Table) -> pa.Table:
        found = []
        few = pc.filter(cell, cell.column("few"))
        every = pc.filter(cell, pc.invert(cell.column("few")))
        if few.num_rows and every.num_rows:
            sides = [tuple(x.column(c).to_numpy() for c in ("fp", "n", "root")) for x in (few, every)]
            found = joining(*sides, *(sets(x.column("t").combine_chunks()) for x in (few, every)))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").select(*pair("a", "b"))


def sizes_fit(other: str) -> Column:
    return may_link(F.col("n"), F.col(f"n{other}"))


def linked_groups(members: DataFrame, texts: Texts, also: DataFrame | None = None, may: Callable[[str], Column] = sizes_fit) -> DataFrame:
    """(a, b): links that connect all groups of similar texts. members (key, fp, n, and whatever may wants) are the buckets they share,
    also are pairs (a, b) to compare at once. may(suffix) says if a row and another, whose columns have the suffix, can be similar; of
    a similar pair one bucket must say so."""
    extra = [c for c in members.columns if c not in ("key", "fp", "n")]
    buckets = cut(members.groupBy("key").agg(F.count("*").alias("w")).filter("w > 1").withColumn("size", F.col("w")), "buckets")
    central = F.sum("size").over(Window.partitionBy("fp"))  # a row for each key of a text
    members = cut(lookup(members, buckets, "key", "w").withColumn("center", F.struct(central.alias("fullness"), "fp")), "bucket-members")
    pivots = cut(members.groupBy("key").agg(F.max("center").alias("pivot"), F.count("*").alias("w")), "pivots")
    star = lookup(members, pivots, "key", "w").filter("fp <> pivot.fp").groupBy("fp").agg(F.max("pivot").alias("p")).withColumn("q", F.col("p.fp")).select(*pair("fp", "q"))
    linked = similar(also.unionByName(star) if also is not None else star, texts, "first")

    rooted = members.select("key", "fp", "n", *extra).join(components(linked).withColumnRenamed("node", "fp"), "fp", "left")
    rooted = cut(rooted.withColumn("root", F.coalesce("root", "fp")), "bucket-roots")
    by_root = rooted.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum(F.greatest("n", F.lit(LEAST_WEIGHT))).alias("s"))
    opened = by_root.groupBy("key").agg(F.max_by(F.struct("root", "s"), F.struct("c", "root")).alias("m"), F.count("*").alias("roots"), F.sum("c").alias("w"), F.sum("s").alias("total")).filter("roots > 1")
    opened = cut(opened.select("key", "w", F.col("w").alias("size"), F.col("m.root").alias("main"), "total", (F.col("total") - F.col("m.s")).alias("odd")), "open-buckets")
    largest = opened.agg(F.max("size")).first()[0]
    if largest is None:
        return linked
    rest = cut(lookup(rooted, opened, "key", "w"), "open-members")
    small = rest.filter(F.col("size") <= PAIRED)
    other = small.select("key", *(F.col(c).alias(f"{c}2") for c in ("fp", "n", "root", *extra)))
    met = small.filter("root <> main").join(other, "key").filter((F.col("root") != F.col("root2")) & may("2"))
    later = similar(met.select(*pair("fp", "fp2")), texts, "rest")
    found = linked.unionByName(later)
    return found.unionByName(cut(blockwise(rest.filter(F.col("size") > PAIRED), texts), "block-links")) if largest > PAIRED else found


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest id, of equal ids the first written."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*map(quoted, docs.columns)).alias("doc")), "numbered-documents")
    bodies = rows.select("row", F.col("doc")[id_column].alias("id"), F.coalesce(F.col("doc")[text], F.lit("")).alias("t"))
    prints = cut(shingled(bodies), "shingle-sets")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    groups = cut(prints.groupBy("fp").agg(F.min(order).alias("least"), F.first("sim").alias("sim"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("w")), "fp-groups")
    texts = Texts(bodies.select("row", "t"), groups.select("fp", F.col("least.row").alias("row")))
    members = groups.select("fp", "n", F.explode("keys").alias("key"))
    roots = components(linked_groups(members, texts, anchored(groups))).withColumnRenamed("node", "fp")
    firsts = groups.select("fp", "least").join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    # rows that go are fewer than those that stay
    gone = cut(prints.select("row").join(firsts.select(F.col("least.row").alias("row")), "row", "left_anti"), "gone-rows")
    return rows.join(gone, "row", "left_anti").select("doc.*")
