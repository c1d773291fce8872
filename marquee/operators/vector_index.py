"""A kept index over item vectors: lists around centres, packed by type, that grows by segments and is searched until a page can be full.

On disk, under one path:

    centres                 (list, centre), probes (pool, probes), parts: written once, when the index is built
    blocks/segment=n/list=l (part, item_type, ids, matrix): packed vectors of one type; a search reads the folders of its lists only
    gone/segment=n          (list, part, item_type, ids): entries of older segments that segment n replaces or removes
    entries/segment=n       (item, list, part): what segment n holds
    done/segment=n          one row, written last: a segment without it doesn't exist

Centres come from k-means over a bounded sample; every vector is put into its nearest list. ``add`` puts new and changed vectors
into a segment of their own by the same centres, without touching what lies there, so its work is that of the batch; a run that
dies before its end leaves nothing that a reader sees. Rebuild to compact.

A search knows from the entries how many vectors of each type a list holds. A query goes through its lists from the nearest on until these
hold the wanted number of the allowed types, and of other types than its own, and at least as many lists as the sample says are needed for the recall
in that pool: neighbours of a rare type lie further out, so it has a number of its own. What is in the lists is compared
exactly. ``exact`` goes through all lists.

Vectors of another width than most, or with a value that is null or no number, are left out, as are those of length zero. Of an item
that a batch holds twice the larger vector (as an array) counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM, TYPES
from marquee.operators.similarity import BLOCK, FIT_VECTORS, KEYED, LIST_ROWS, LISTS, SORTED, TUNE_QUERIES, TUNED_RECALL, centroids, compared, merged, places, small_batches, unit_rows, usable, width_of

#: Neighbours that the number of lists is tuned for.
TUNED_K = 60
#: Queries of one task, in expectation.
QUERY_ROWS = 20_000


def sample_of(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(types by number, unit vectors) of FIT_VECTORS rows at most, those with the smallest hash."""
    rows = vectors.orderBy(F.xxhash64(*ITEM), *ITEM).limit(FIT_VECTORS).select("item_type", "item_id", "embedding").toArrow()
    parts = [unit_rows(b) for b in rows.to_batches() if b.num_rows]
    if not parts:
        return np.empty(0, dtype=np.int8), np.zeros((0, 1))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])


def tuned(kinds: np.ndarray, rows: np.ndarray, centres: np.ndarray, recall: float) -> dict[str, int]:
    """How many lists find this share of the true neighbours in the sample: among all (any), among one type (own) and among the
    other types than one's own (other)."""
    rng = np.random.default_rng(6)
    home = (rows @ centres.T).argmax(axis=1) if len(rows) else np.empty(0, dtype=np.int64)

    def needed(asked: np.ndarray, pool: np.ndarray) -> int:
        asked = rng.choice(asked, min(TUNE_QUERIES, len(asked)), replace=False) if len(asked) else asked
        if not len(asked) or len(pool) < 2:
            return 1
        score = rows[asked] @ rows[pool].T
        score[asked[:, None] == pool[None]] = -np.inf
        n = min(TUNED_K, len(pool) - 1)
        true = np.argpartition(-score, n - 1, axis=1)[:, :n]
        rank = np.argsort(np.argsort(-(rows[asked] @ centres.T), axis=1), axis=1)  # of each list, for each query
        return int(np.quantile(np.take_along_axis(rank, home[pool][true], axis=1), recall, method="higher")) + 1

    every = np.arange(len(rows))
    out = {"any": needed(every, every)}
    for n, t in enumerate(SORTED):
        out[f"own {t}"] = needed(every, every[kinds == n])
        out[f"other {t}"] = needed(every[kinds == n], every[kinds != n])
    return out


@dataclass
class VectorIndex:
    """An index on disk; see ``build`` and ``opened``."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    probes: dict[str, int]
    parts: int

    def segments(self) -> list[int]:
        """The segments that were written to their end, from the first."""
        found = self.spark.read.schema("n long, segment int").parquet(f"{self.path}/done")
        return sorted(r[0] for r in found.select("segment").distinct().collect())

    def _read(self, kind: str, schema: str, segments: list[int]) -> DataFrame:
        return self.spark.read.schema(f"{schema}, segment int").parquet(f"{self.path}/{kind}").filter(F.col("segment").isin(segments))

    def gone(self, segments: list[int]) -> DataFrame:
        """(list, part, item_type, item_id, segment): entries of segments before this one that don't count any more."""
        return self._read("gone", "list int, part int, item_type string, item_id long", segments)

    def entries(self) -> DataFrame:
        """(item, list, part) of every vector that counts."""
        segments = self.segments()
        held = self._read("entries", "item_type string, item_id long, list int, part int", segments)
        # an item is replaced as often as it comes again, so its last entry is the one of its highest segment
        last = held.groupBy(*ITEM).agg(F.max_by(F.struct("list", "part", "segment"), "segment").alias("e"))
        removed = self.gone(segments).groupBy(*ITEM).agg(F.max("segment").alias("gone_in"))
        live = last.join(removed, ITEM, "left").filter("gone_in is null or e.segment >= gone_in")
        return live.select(*ITEM, "e.list", "e.part")

    def counts(self) -> np.ndarray:
        """How many vectors of each type (by number) each list holds."""
        out = np.zeros((max(1, len(self.centres)), len(SORTED)), dtype=np.int64)
        for lst, kind, n in self.entries().groupBy("list", "item_type").agg(F.count("*")).collect():  # lists times types
            out[lst, SORTED.index(kind)] = n
        return out

    def placed(self, vectors: DataFrame) -> DataFrame:
        """vectors (item, embedding), each item once, with its nearest list and its part of the list."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    m = np.array(part.column(2).to_pylist(), dtype=np.float64).reshape(part.num_rows, -1)
                    near = (m @ centres.T).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32))], names=["item_type", "item_id", "embedding", "list"])

        once = usable(vectors, centres.shape[1]).groupBy(*ITEM).agg(F.max("embedding").alias("embedding"))
        kind = vectors.schema["embedding"].dataType.simpleString()
        found = once.select(*ITEM, "embedding").mapInArrow(run, f"item_type string, item_id long, embedding {kind}, list int")
        return found.withColumn("part", F.pmod(F.xxhash64(*ITEM), F.lit(self.parts)).cast("int"))

    def _write(self, number: int, vectors: DataFrame | None, removed: DataFrame) -> None:
        """Segment number: what it replaces, its blocks and entries, then the row that makes it count."""
        at = f"segment={number}"
        removed.write.mode("overwrite").parquet(f"{self.path}/gone/{at}")
        if vectors is not None:
            self._write_vectors(at, vectors)
        self.spark.range(1).select(F.col("id").alias("n")).write.mode("overwrite").parquet(f"{self.path}/done/{at}")

    def _write_vectors(self, at: str, vectors: DataFrame) -> None:
        rows = vectors.repartition("list", "part").sortWithinPartitions("list", "part", "item_type")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [tuple(k) for k in zip(*(batch.column(c).to_pylist() for c in ("list", "part", "item_type")), strict=True)]
                first = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
                for a, b in zip(first[:-1], first[1:], strict=True):
                    for lo in range(a, b, BLOCK):
                        _, ids, m = unit_rows(batch.slice(lo, min(BLOCK, b - lo)))
                        values = [pa.array([keys[a][0]], pa.int32()), pa.array([keys[a][1]], pa.int32()), pa.array([keys[a][2]]), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(values, names=["list", "part", "item_type", "ids", "matrix"])

        blocks = rows.select("item_type", "item_id", "embedding", "list", "part").mapInArrow(run, "list int, part int, item_type string, ids binary, matrix binary")
        blocks.write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/blocks/{at}")
        vectors.select(*ITEM, "list", "part").write.mode("overwrite").parquet(f"{self.path}/entries/{at}")

    def add(self, vectors: DataFrame) -> int:
        """Put new and changed vectors in, as the next segment; its number."""
        number = self.segments()[-1] + 1
        placed = self.placed(vectors).persist()
        known = self.entries().join(placed.select(*ITEM), ITEM, "left_semi").select("list", "part", *ITEM)
        self._write(number, placed, known)
        placed.unpersist()
        return number

    def remove(self, items: DataFrame) -> int:
        """Take items (item_type, item_id) out, as the next segment; its number."""
        number = self.segments()[-1] + 1
        known = self.entries().join(items.select(*ITEM).distinct(), ITEM, "left_semi").select("list", "part", *ITEM)
        self._write(number, None, known)
        return number

    def probed(self, queries: DataFrame, k: int, types: tuple[str, ...] | None, cross: int, exact: bool) -> DataFrame:
        """queries (item, embedding) once for each list that they go through."""
        centres, probes, counts = self.centres, self.probes, self.counts()
        allowed = np.array([types is None or t in types for t in SORTED])
        base = probes["any"] if types is None else max([probes[f"own {t}"] for t in types], default=1)

        def prefix(order: np.ndarray, held: np.ndarray, wanted: int) -> np.ndarray:
            """For each query the number of its nearest lists that hold so many."""
            total = np.cumsum(held[order], axis=1)
            return np.minimum((total < wanted).sum(axis=1) + 1, len(centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    m = np.array(part.column(2).to_pylist(), dtype=np.float64).reshape(part.num_rows, -1)
                    kind = np.array([SORTED.index(t) for t in part.column(0).to_pylist()])
                    order = np.argsort(-(m @ centres.T), axis=1, kind="stable")
                    n = np.maximum(base, prefix(order, counts[:, allowed].sum(axis=1), k + 1))  # one more, for itself
                    for t in np.unique(kind) if cross else []:
                        mine = kind == t
                        others = allowed & (np.arange(len(SORTED)) != t)
                        n[mine] = np.maximum(n[mine], np.maximum(probes[f"other {SORTED[t]}"], prefix(order[mine], counts[:, others].sum(axis=1), cross)))
                    n = np.minimum(len(centres) if exact else n, len(centres)) + np.zeros(part.num_rows, dtype=np.int64)
                    row = np.repeat(np.arange(part.num_rows), n)
                    lists = order[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in range(3)), pa.array(lists.astype(np.int32))], names=["item_type", "item_id", "embedding", "list"])

        kind = queries.schema["embedding"].dataType.simpleString()
        return usable(queries, centres.shape[1]).select(*ITEM, "embedding").mapInArrow(run, f"item_type string, item_id long, embedding {kind}, list int")

    def search(self, queries: DataFrame, k: int, types: tuple[str, ...] | None = None, cross: int = 0, exact: bool = False) -> DataFrame:
        """(item_type, item_id, other_type, other_id, score, place, cross_place): the k nearest vectors of each query (item, embedding),
        itself apart, and the cross nearest of other types, as far as they are in the lists that it goes through."""
        small_batches(self.spark)
        allowed = None if types is None else [SORTED.index(t) for t in types]
        segments = self.segments()
        asked = self.probed(queries, k, types, cross, exact)
        # a list is split by part, and its queries too, so that no task grows with either
        share = max(1, -(-queries.count() // QUERY_ROWS))
        near = self._read("blocks", "part int, item_type string, ids binary, matrix binary, list int", segments)
        if types is not None:
            near = near.filter(F.col("item_type").isin(*types))
        dead = self.gone(segments).select("list", "part", "item_type", "segment", F.col("item_id")).groupBy("list", "part", "item_type", "segment").agg(F.collect_list("item_id").alias("dead"))
        rows = near.select("list", "part", "item_type", "segment", "ids", "matrix").withColumn("dead", F.lit(None).cast("array<long>"))
        rows = rows.unionByName(dead.select("list", "part", "item_type", "segment", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("matrix"), "dead"))
        rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))).withColumn("share", F.pmod(F.xxhash64(*ITEM), F.lit(share)).cast("int"))

        def run(one: pa.Table, other: pa.Table) -> pa.Table:
            names = pa.schema([("item_type", pa.string()), ("item_id", pa.int64()), ("other_type", pa.string()), ("other_id", pa.int64()), ("score", pa.float64())])
            columns = {c: other.column(c).to_pylist() for c in ("item_type", "segment", "ids", "matrix", "dead")}
            blocks, killed = [], {}
            for t, s, ids, matrix, dead_ids in zip(*columns.values(), strict=True):
                if ids is None:
                    killed.setdefault(t, []).append((s, np.array(dead_ids, dtype=np.int64)))
            for t, s, ids, matrix, _ in zip(*columns.values(), strict=True):
                if ids is not None:
                    i = np.frombuffer(ids, np.int64)
                    m = np.frombuffer(matrix).reshape(len(i), -1)
                    keep = np.ones(len(i), dtype=bool)
                    for later, x in killed.get(t, []):
                        keep &= ~np.isin(i, x) if later > s else True
                    blocks.append((np.full(int(keep.sum()), SORTED.index(t), dtype=np.int8), i[keep], m[keep]))
            found = []
            for q in one.select(["item_type", "item_id", "embedding"]).combine_chunks().to_batches(max_chunksize=BLOCK):
                asked_rows = unit_rows(q)
                met = [compared(asked_rows, v, k, cross, allowed) for v in blocks if len(asked_rows[1]) and len(v[1])]
                found += [merged(met, k, cross)] if met else []
            return pa.Table.from_batches(found, names) if found else names.empty_table()

        cells = ["list", "part", "share"]
        met = asked.groupBy(*cells).cogroup(rows.groupBy(*cells)).applyInArrow(run, KEYED)
        return places(met, k, cross)

    def pool(self, anchors: DataFrame, n: int, quota: int) -> DataFrame:
        """Candidates of each anchor (item, embedding) as ``similarity.similar_pool`` gives them, from the index."""
        if quota > 0:
            return self.search(anchors, n, cross=n)
        own = [self.search(anchors.filter(F.col("item_type") == t), n, types=(t,)) for t in TYPES]
        out = own[0]
        for more in own[1:]:
            out = out.unionByName(more)
        return out


def build(vectors: DataFrame, path: str, lists: int = LISTS, recall: float = TUNED_RECALL) -> VectorIndex:
    """A new index of vectors (item, embedding) at path."""
    spark = vectors.sparkSession
    good = usable(vectors, width_of(vectors))
    kinds, sample = sample_of(good)
    centres = centroids(sample, lists)
    probes = tuned(kinds, sample, centres, recall)
    n = good.count()
    parts = max(1, -(-4 * n // (max(1, len(centres)) * LIST_ROWS)))  # a list may be four times as long as the average
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").write.parquet(f"{path}/centres")
    spark.createDataFrame([*probes.items(), ("parts", parts)], "pool string, probes int").write.parquet(f"{path}/probes")
    index = VectorIndex(spark, path, centres, probes, parts)
    index._write(0, index.placed(good), spark.createDataFrame([], "list int, part int, item_type string, item_id long"))
    return index


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """The index at path."""
    centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()]
    probes = dict(map(tuple, spark.read.parquet(f"{path}/probes").collect()))
    return VectorIndex(spark, path, np.array(centres, dtype=np.float64).reshape(len(centres), -1), probes, probes.pop("parts"))


def recall_by_type(found: DataFrame, true: DataFrame) -> DataFrame:
    """(item_type, n, hits): of the true neighbours (item, other), by the other's type, how many were found."""
    pair = [*ITEM, "other_type", "other_id"]
    hits = true.select(*pair).join(found.select(*pair).withColumn("hit", F.lit(1)), pair, "left")
    return hits.groupBy(F.col("other_type").alias("item_type")).agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
