"""Scoring by a Brown class-based bigram model.

Tokens are words and one end for each text. Every word of the training text gets a class, in two steps as in Brown's own
method. Exchange clustering first assigns units to ``CLASSES`` classes: each of the ``UNITS`` most frequent words is a unit, all other
words share units by their last three bytes. A unit moves to the class that raises the likelihood of the training text's
class bigrams most, until the sweeps are over; half the units may move in a sweep, which keeps neighbours from
swapping for ever. Then every other training word, however many there are, is put by itself into the class that is likeliest
by the classes of its own neighbours. The unit of its last bytes only stands in for a word that training hasn't seen. The end has a
class of its own. One more pass over all texts turns them into these final classes, of which bigrams are counted and scores are summed. The model:

    p(word | previous) = p(class | previous class) * p(word | class)

    p(class | previous) = (N(previous, class) + C p(class)) / (N(previous) + C),  p(class) = (N(class) + 1) / (N + C)
    p(word | class)     = (N(word) + 1) / (N(class) + words of the class + 1), for the end 1

with one share in each class for all its words that training hasn't seen, as in the unigram base.

What Spark counts: words and pairs of units over the whole training part, by combining aggregates. Each occurrence of a rarer word is sent, packed
with the classes around it, to the bucket of its word. A sweep is one pass over the table of pairs; what it returns has a size set by UNITS and CLASSES alone, and
so have the broadcasts: units and classes, and the counts of the ``LOCAL`` most frequent words. Classes and counts of all other
words are joined to the texts. In training none of these holds more than one in LOCAL of the tokens, but a word of held-out texts alone
may be frequent there: so words that are frequent where they are looked up are joined apart.

Inputs: null counts as the empty text, which is one end. A null id is split as crc32 of the empty text. Repeated rows
are scored, and counted, each. Ties of frequency go by hash, of likelihood to the first class. Without training rows all
counts are 0. Words are hashed to 64 bits. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import HOT_PARTS, cut, table
from marquee.llm.textbytes import NOT_SPACE, Words, bytes_of, mix, slices, word_hashes, words_of

UNITS = 8192
SUFFIXES = 1024
LOCAL = 60_000
CLASSES = 32
SWEEPS = 14
BLOCKS = 32
FOLDS, HELD_OUT = 7, 2


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def suffixes(w: Words) -> np.ndarray:
    """A number under SUFFIXES for each word, from its last three bytes."""
    tail = np.zeros(len(w.starts), dtype=np.uint64)
    for back in (1, 2, 3):
        at = w.ends - back
        inside = at >= w.starts
        tail = tail * np.uint64(257) + np.where(inside, w.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(tail) % np.uint64(SUFFIXES)).astype(np.int64)


def folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): how often each word occurs in the texts (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [word_hashes(words_of(part.column("t"), NOT_SPACE)) for part in slices(batch, "t")]
            if keys:
                h, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The LOCAL most frequent words by hash, with their counts, units and, at last, classes; unit 0 is the end, then come the
    ``single`` words that are units of their own, then the suffixes."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    single: int
    classes: np.ndarray | None = None

    @property
    def n_units(self) -> int:
        return 1 + self.single + SUFFIXES

    def look(self, h: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, count, whether the count is known here) of each word."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        here = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)
        unit = suffix + 1 + self.single
        count = np.zeros(len(h), dtype=np.int64)
        if here.any():
            own = self.units[at]
            unit = np.where(here & (own > 0), own, unit)
            count = np.where(here, self.counts[at], 0)
        return unit, count, here


def lexicon(counts: DataFrame) -> Lexicon:
    top = counts.orderBy(F.desc("n"), "h").limit(LOCAL).select("h", "n").toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    units = np.where(np.arange(len(h)) < UNITS, np.arange(len(h)) + 1, 0)
    order = np.argsort(h)
    return Lexicon(h[order], top.column("n").to_numpy()[order], units[order], UNITS)


def sequences(w: Words, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous unit, unit, text) of every token, the end of each text included."""
    first = w.first()
    ends = first[1:] + np.arange(w.n_docs)
    current = np.zeros(len(units) + w.n_docs, dtype=np.int64)
    is_word = np.ones(len(current), dtype=bool)
    is_word[ends] = False
    current[is_word] = units
    return np.r_[0, current[:-1]], current, np.repeat(np.arange(w.n_docs), np.diff(np.r_[-1, ends]))


def blobs(side: int, block: np.ndarray, key: np.ndarray, n: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
    return [(side, b, key[at].tobytes(), n[at].tobytes()) for b in range(BLOCKS) if (at := block == b).any()]


BLOB = pa.schema([("side", pa.int32()), ("block", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())])


def unit_pairs(texts: DataFrame, words: Lexicon) -> DataFrame:
    """Rows (side, block, pairs, counts): all pairs of units in sequence with their counts, once in blocks of the first
    (side 0) and once in blocks of the second (side 1). Pairs are summed before they are packed, so that a block holds
    no more than its pairs of units."""
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for part in slices(batch, "t"):
                w = words_of(part.column("t"), NOT_SPACE)
                before, now, _ = sequences(w, sent.value.look(word_hashes(w), suffixes(w))[0])
                k, n = np.unique((before << 16 | now).astype(np.uint32), return_counts=True)
                keys.append(k)
                counts.append(n)
            if keys:
                k, n = folded(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = batch.column("pair").to_numpy().astype(np.uint32), batch.column("n").to_numpy()
            rows = blobs(0, (k >> 16) % BLOCKS, k, n) + blobs(1, (k & 0xFFFF) % BLOCKS, k, n)
            yield pa.RecordBatch.from_pylist([dict(zip(BLOB.names, r, strict=True)) for r in rows], BLOB)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for side, block, pairs, counts in zip(*(batch.column(c).to_pylist() for c in BLOB.names), strict=True):
                held.setdefault((side, block), []).append((pairs, counts))
        for (side, block), found in held.items():
            yield pa.RecordBatch.from_pylist([dict(zip(BLOB.names, (side, block, b"".join(p for p, _ in found), b"".join(c for _, c in found)), strict=True))], BLOB)

    kind = "side int, block int, pairs binary, counts binary"
    summed = texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return summed.mapInArrow(pack, kind).repartition("side", "block").mapInArrow(merge, kind)


def with_classes(pairs: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each unit with the class of what follows it, and of what comes before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for side, block, keys, counts in zip(*(batch.column(c).to_pylist() for c in BLOB.names), strict=True):
                k, n = np.frombuffer(keys, np.uint32).astype(np.int64), np.frombuffer(counts, np.int64)
                own, other = (k >> 16, k & 0xFFFF) if side == 0 else (k & 0xFFFF, k >> 16)
                size = (len(classes) + BLOCKS - 1) // BLOCKS
                sums = np.bincount(own // BLOCKS * n_classes + classes[other], weights=n, minlength=size * n_classes)
                rows.append({"side": side, "block": block, "pairs": sums.tobytes(), "counts": b""})
            yield pa.RecordBatch.from_pylist(rows, BLOB)

    out = np.zeros((2, len(classes), n_classes))
    for side, block, sums, _ in pairs.mapInArrow(run, "side int, block int, pairs binary, counts binary").collect():
        own = np.arange(block, len(classes), BLOCKS)
        out[side, own] += np.frombuffer(sums).reshape(-1, n_classes)[: len(own)]
    return out[0], out[1]


def plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(between: np.ndarray) -> float:
    return float(plogp(between).sum() - plogp(between.sum(0)).sum() - plogp(between.sum(1)).sum())


def gains(after: np.ndarray, before: np.ndarray, classes: np.ndarray, between: np.ndarray) -> np.ndarray:
    """For each unit and class, what the likelihood gains if the unit, taken out of its class, is put there.

    A unit's pairs with itself, few next to the rest, are counted as pairs with its old class. Only the classes that are found beside a unit
    change a sum, so only these are gone through."""
    n_classes = between.shape[0]
    out = np.empty((len(classes), n_classes))
    totals = between.sum(1), between.sum(0)
    for at in range(0, len(classes), 4096):
        r, l, a = after[at : at + 4096], before[at : at + 4096], classes[at : at + 4096]
        gain = np.zeros((len(a), n_classes))
        for own, other, known, total in ((r, l, between.T, totals[0]), (l, r, between, totals[1])):
            row, beside = np.nonzero(own)
            n = own[row, beside]
            line = known[beside]  # of every class with the one beside the unit, without the unit
            line[np.arange(len(row)), a[row]] -= n
            same = np.flatnonzero(beside == a[row])
            line[same] -= other[row[same]]
            np.maximum(line, 0, out=line)
            change = plogp(line + n[:, None]) - plogp(line)
            if len(row):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                gain[row[first]] += np.add.reduceat(change, first, axis=0)
            each = own.sum(1)
            left = np.repeat(total[None], len(a), axis=0)
            left[np.arange(len(a)), a] -= each
            gain -= plogp(left + each[:, None]) - plogp(left)
        out[at : at + 4096] = gain
    return out


def exchange(pairs: DataFrame, n_units: int, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, counts of class after class) of the likeliest state of all sweeps."""
    classes = np.r_[0, 1 + np.arange(n_units - 1) % (n_classes - 1)]
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for sweep in range(sweeps + 1):
        after, before = with_classes(pairs, classes, n_classes)
        between = np.zeros((n_classes, n_classes))
        np.add.at(between, classes, after)
        reached = likelihood(between)
        if best is None or reached > best[0]:
            best = reached, classes.copy(), between
        if sweep == sweeps:
            break
        gain = gains(after, before, classes, between)
        gain[:, 0] = -np.inf
        to = gain.argmax(1)
        moves = (after.sum(1) > 0) & (to != classes) & (mix(np.arange(n_units, dtype=np.uint64) + np.uint64(1)) % np.uint64(2) == sweep % 2)
        moves[0] = False
        if not moves.any() and sweep:
            break
        classes = np.where(moves, to, classes)
    return best[1], best[2]


OCCURRENCE = np.dtype([("h", "<u8"), ("suffix", "<u2"), ("after", "u1"), ("previous", "u1")])
#: Tokens of training for each bucket of occurrences; the least number of buckets.
BUCKET_TOKENS, BUCKETS = 2_000_000, 64


def occurrences(texts: DataFrame, words: Lexicon, classes: np.ndarray, n_buckets: int) -> DataFrame:
    """Rows (bucket, found): every occurrence of a word that is no unit of its own, packed, with the classes around it, in buckets of words."""
    sent = texts.sparkSession.sparkContext.broadcast((words, classes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon_, of_unit = sent.value
        for batch in batches:
            parts = []
            for part in slices(batch, "t"):
                w = words_of(part.column("t"), NOT_SPACE)
                h, suffix = word_hashes(w), suffixes(w)
                before, now, _ = sequences(w, lexicon_.look(h, suffix)[0])
                each = np.flatnonzero(now > 0)  # places of the words among the tokens
                rare = now[each] > lexicon_.single
                at = each[rare]
                found = np.empty(len(at), dtype=OCCURRENCE)
                found["h"], found["suffix"] = h[rare], suffix[rare]
                found["after"], found["previous"] = of_unit[now[at + 1]], of_unit[before[at]]  # a word is never the last token
                parts.append(found)
            if parts:
                found = np.concatenate(parts)
                bucket = (found["h"] >> np.uint64(20)) % np.uint64(n_buckets)
                order = np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")
                found, bucket = found[order], bucket[order]
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
                packed = [found[x:y].tobytes() for x, y in zip(first, np.append(first[1:], len(found))[: len(first)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "found"])

    return texts.mapInArrow(pack, "bucket int, found binary").repartition(n_buckets, "bucket")


def assigned(found: DataFrame, single: int, classes: np.ndarray, between: np.ndarray) -> DataFrame:
    """(h, n, class) of each word that is no unit of its own: how often it occurs, and its class by the classes around it."""
    sent = found.sparkSession.sparkContext.broadcast((classes, between))
    n_classes = len(between)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_unit, known = sent.value
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, some in zip(batch.column("bucket").to_pylist(), batch.column("found").to_pylist(), strict=True):
                held.setdefault(bucket, []).append(some)
        while held:
            some = np.frombuffer(b"".join(held.popitem()[1]), dtype=OCCURRENCE)
            h = np.ascontiguousarray(some["h"])
            order = np.argsort(h)
            h, first = np.unique(h[order], return_index=True)
            ends = np.r_[first[1:], len(order)]
            for at in range(0, len(h), 4096):
                lo, hi = first[at], ends[min(at + 4096, len(h)) - 1]
                part, starts = some[order[lo:hi]], first[at : at + 4096]
                n = ends[at : at + 4096] - starts
                row = np.repeat(np.arange(len(n)), n)
                sums = [np.bincount(row * n_classes + part[c], minlength=len(n) * n_classes).reshape(-1, n_classes).astype(np.float64) for c in ("after", "previous")]
                old = of_unit[part["suffix"][starts - lo].astype(np.int64) + 1 + single]
                gain = gains(*sums, old, known)
                gain[:, 0] = -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 4096].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(gain.argmax(1).astype(np.int32))], names=["h", "n", "class"])

    return found.mapInArrow(run, "h long, n long, class int")


@dataclass
class Learnt:
    """The words and classes of a model: of its probabilities, in log10, those of each class's words but for their counts."""

    words: Lexicon
    unit_classes: np.ndarray
    in_class: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    ends: int
    tokens: int
    types: int


@dataclass
class Model(Learnt):
    """And the log10 probabilities of class after class."""

    transition: np.ndarray | None = None


def model_of(learnt: Learnt, between: np.ndarray) -> Model:
    n = len(between)
    share = (learnt.class_tokens + 1) / (learnt.tokens + n)
    return Model(**vars(learnt), transition=np.log10((between + n * share[None]) / (between.sum(1, keepdims=True) + n)))


#: Stands in a sequence of classes for a word whose class isn't known yet.
UNKNOWN = 255


def locally(docs: DataFrame, learnt: Learnt, kinds: str) -> DataFrame:
    """docs (t and other columns) with, instead of the text: the class of each word as a byte, UNKNOWN for those that aren't in the lexicon; of
    these words the hash and the class that each has if it is unseen; and the sums over all others. kinds: of the columns besides t."""
    sent = docs.sparkSession.sparkContext.broadcast(learnt)
    names = [c for c in docs.columns if c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        unit_share = -np.log10(m.tokens + m.types + 1)
        for batch in batches:
            for part in slices(batch, "t"):
                w = words_of(part.column("t"), NOT_SPACE)
                h = word_hashes(w)
                at = np.minimum(np.searchsorted(m.words.hashes, h), max(0, len(m.words.hashes) - 1))
                here = m.words.hashes[at] == h if len(m.words.hashes) else np.zeros(len(h), dtype=bool)
                own, docs_of = at[here], w.docs[here]
                classes = np.full(len(h), UNKNOWN, dtype=np.uint8)
                if len(own):
                    classes[here] = m.words.classes[own]
                seen = np.log10(m.words.counts[own] + 1.0) if len(own) else np.zeros(0)
                inner = seen + m.in_class[classes[here]]
                total = lambda x: np.bincount(docs_of, weights=x, minlength=w.n_docs).astype(np.float64)  # noqa: B023, E731
                first = w.first().astype(np.int32)
                n_tokens = np.diff(first).astype(np.int64) + 1
                unseen = m.unit_classes[suffixes(w)[~here] + 1 + m.words.single].astype(np.uint8)
                offsets = np.searchsorted(w.docs[~here], np.arange(w.n_docs + 1)).astype(np.int32)
                packed = lambda at, x: pa.Array.from_buffers(pa.binary(), w.n_docs, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(x.tobytes())])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in names),
                        pa.array(n_tokens),
                        pa.array(np.bincount(docs_of, minlength=w.n_docs).astype(np.int64) + (m.ends > 0)),
                        pa.array(n_tokens * unit_share + total(seen) + np.log10(m.ends + 1)),
                        pa.array(total(inner)),
                        packed(first, classes),
                        packed(offsets, unseen),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[~here].view(np.int64))),
                    ],
                    names=[*names, "n_tokens", "n_known", "base", "inner", "classes", "unseen", "rare"],
                )

    return docs.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base double, inner double, classes binary, unseen binary, rare array<bigint>")


#: Rows of a sample that says which rare words are so frequent that they are joined apart; it decides nothing else.
HOT_SAMPLE = 200_000


def rare_words(local: DataFrame, rest: DataFrame) -> DataFrame:
    """(row, found: pos, n, class) of the rare words of local (row, rare) that training has seen."""
    rare = local.select("row", F.posexplode("rare").alias("pos", "h"))
    total = local.agg(F.sum(F.size("rare"))).first()[0] or 0
    drawn = rare.select("h").sample(min(1.0, HOT_SAMPLE / max(total, 1)), seed=5).groupBy("h").agg(F.count("*").alias("w"))
    hot = [r["h"] for r in drawn.filter(F.col("w") * HOT_PARTS > min(total, HOT_SAMPLE)).collect()]  # some HOT_PARTS at most
    found = rare.filter(~F.col("h").isin(hot)).join(rest, "h") if hot else rare.join(rest, "h")
    if hot:
        few = local.sparkSession.createDataFrame([(h,) for h in hot], "h long").join(rest, "h")
        found = found.unionByName(rare.join(F.broadcast(few), "h"))
    return found.groupBy("row").agg(F.collect_list(F.struct("pos", "n", F.col("class").cast("tinyint").alias("class"))).alias("found"))


def classed(docs: DataFrame, learnt: Learnt, rest: DataFrame) -> DataFrame:
    """docs (t and other columns) with, instead of the text: n_tokens, n_known, base, inner (the log10 of each word in its class, summed) and
    the class of each word as a byte. The words that not every task knows are looked up once."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "t")
    names = [c for c in docs.columns if c != "t"]
    local = cut(locally(docs, learnt, kinds).withColumn("row", F.monotonically_increasing_id()), "local-classes")
    sent = docs.sparkSession.sparkContext.broadcast(learnt.in_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_class = sent.value
        for batch in batches:
            classes, at = bytes_of(batch.column("classes"))
            classes = classes.copy()
            unseen, _ = bytes_of(batch.column("unseen"))
            places = np.flatnonzero(classes == UNKNOWN)
            known, rows = batch.column("found"), np.arange(batch.num_rows)
            size = pc.fill_null(pc.list_value_length(known), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            each, row = known.flatten(), np.repeat(rows, size)
            begin = np.searchsorted(places, at[:-1])  # of a row's rare words among all
            which = begin[row] + each.field("pos").to_numpy().astype(np.int64)
            of, n = unseen.copy(), np.zeros(len(places))
            of[which], n[which] = each.field("class").to_numpy(), each.field("n").to_numpy()
            classes[places] = of
            seen = np.log10(n + 1)
            owner = np.searchsorted(at, places, "right") - 1
            total = lambda x: np.bincount(owner, weights=x, minlength=batch.num_rows).astype(np.float64)  # noqa: B023, E731
            plus = lambda c, x: pa.array(batch.column(c).to_numpy() + x)  # noqa: B023, E731
            filled = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(classes.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), batch.column("n_tokens"), plus("n_known", size), plus("base", total(seen)), plus("inner", total(seen + in_class[of])), filled],
                names=[*names, "n_tokens", "n_known", "base", "inner", "classes"],
            )

    joined = local.drop("rare").join(rare_words(local.select("row", "rare"), rest), "row", "left").drop("row")
    return cut(joined.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base double, inner double, classes binary"), "classed")


def steps(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, row) of every token of rows of classes, the end of each row included."""
    classes, at = bytes_of(column)
    n = len(at) - 1
    ends = at[1:] + np.arange(n)
    current = np.zeros(len(classes) + n, dtype=np.int64)
    is_word = np.ones(len(current), dtype=bool)
    is_word[ends] = False
    current[is_word] = classes
    return np.r_[0, current[:-1]][: len(current)], current, np.repeat(np.arange(n), np.diff(at) + 1)


def class_pairs(classes: DataFrame, n_classes: int) -> np.ndarray:
    """How often each class follows each in the rows (classes), with every word in its final class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_classes * n_classes, dtype=np.int64)
        for batch in batches:
            before, now, _ = steps(batch.column("classes"))
            sums += np.bincount(before * n_classes + now, minlength=len(sums))
        pair = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(sums[pair])], names=["pair", "n"])

    out = np.zeros(n_classes * n_classes)
    for pair, n in classes.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # CLASSES ** 2 rows at most
        out[pair] = n
    return out.reshape(n_classes, n_classes)


def learn(texts: DataFrame) -> tuple[Learnt, DataFrame]:
    """The classes that the texts (t) teach, and the counts and classes (h, n, class) of all words that are no unit of their own."""
    counts = cut(word_counts(texts), "word-counts")
    ends = texts.count()
    words = lexicon(counts)
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pairs = cut(unit_pairs(texts, words), "unit-pairs")
    classes, between = exchange(pairs, words.n_units, CLASSES)
    found = occurrences(texts, words, classes, max(BUCKETS, -(-n // BUCKET_TOKENS)))
    rest = cut(assigned(found, words.single, classes, between), "assigned-words")
    tokens, types = np.zeros(len(between)), np.zeros(len(between))
    tokens[0], types[0] = ends, 1
    own = words.units > 0
    np.add.at(tokens, classes[words.units[own]], words.counts[own])
    np.add.at(types, classes[words.units[own]], 1)
    for c, some, kinds in rest.groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        tokens[c] += some
        types[c] += kinds
    words.classes = np.where(own, classes[words.units], 0)
    others = texts.sparkSession.createDataFrame([(x,) for x in words.hashes[~own].view(np.int64).tolist()], "h long")  # at most LOCAL rows
    for h, c in rest.join(F.broadcast(others), "h").select("h", "class").collect():
        words.classes[np.searchsorted(words.hashes, np.int64(h).view(np.uint64))] = c
    in_class = -np.log10(tokens + types + 1)
    in_class[0] = 0  # the end is alone
    return Learnt(words, classes, in_class, tokens, types, ends, n + ends, v + (ends > 0)), rest


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts (t), and the counts and classes (h, n, class) of all words that are no unit of their own."""
    learnt, rest = learn(texts)
    return model_of(learnt, class_pairs(classed(texts.select("t", F.lit(0).alias("id")), learnt, rest), len(learnt.in_class))), rest


def summed(found: DataFrame, model: Model) -> DataFrame:
    """Rows of ``classed`` with their score instead of inner and the classes."""
    sent = found.sparkSession.sparkContext.broadcast(model.transition)
    names = [c for c in found.columns if c not in ("inner", "classes")]
    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition = sent.value
        for batch in batches:
            before, now, row = steps(batch.column("classes"))
            score = batch.column("inner").to_numpy() + np.bincount(row, weights=transition[before, now], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    return found.mapInArrow(run, f"{kinds}, score double")


def scored(docs: DataFrame, model: Model, rest: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row."""
    found = classed(docs.select(docs[id_column].alias("id"), docs[text].alias("t")), model, rest)
    return summed(found, model).select(F.col("id").alias(id_column), "n_tokens", "n_known", F.col("base").alias("base_score"), "score")


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("t"))
    learnt, rest = learn(docs.filter("not held_out").select("t"))
    found = classed(docs, learnt, rest)
    model = model_of(learnt, class_pairs(found.filter("not held_out"), len(learnt.in_class)))
    return summed(found, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
