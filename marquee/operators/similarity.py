"""Vector similarity over items: exact nearest neighbours in blocks, pools, diversification, quota."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM, TYPES, franchise_key, source_hash, source_text
from marquee.operators.catalog import top_k_per_group
from marquee.operators.recommend import similar_books, similar_reasons

BLOCK = 2048
CREATORS = ("AUTHOR", "SOURCE_AUTHOR", "DIRECTOR", "CREATOR")
PENALTY, QUOTA, PAGE = 0.25, 3, 10
KEYED = "item_type string, item_id long, other_type string, other_id long, score double"


def unit_rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(types by number, ids, unit vectors) of rows (item_type, item_id, embedding); vectors of length zero, which have
    no cosine, are left out."""
    m = np.array(part.column(2).to_pylist(), dtype=np.float64).reshape(part.num_rows, -1)
    size = np.linalg.norm(m, axis=1)
    ok = size > 0
    kind = np.array([SORTED.index(t) for t in part.column(0).to_pylist()], dtype=np.int8)
    return kind[ok], part.column(1).to_numpy()[ok], m[ok] / size[ok, None]


def width_of(vectors: DataFrame) -> int:
    """The width that most vectors have, of equals the larger; 1 without vectors."""
    found = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "w")).alias("m")).first()["m"]
    return found["w"] if found else 1


def usable(vectors: DataFrame, width: int) -> DataFrame:
    """Vectors of this width whose values are all numbers; what is left out has no cosine with the others."""
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vectors.filter((F.size("embedding") == width) & F.forall("embedding", number))


#: Types in the order of their names, which settles ties.
SORTED = sorted(TYPES)


def best(score: np.ndarray, n: int) -> np.ndarray:
    """Which n columns of each row are the best, of equals the first; columns of -inf never are."""
    n = min(n, score.shape[1])
    if not n:
        return np.zeros(score.shape, dtype=bool)
    edge = -np.partition(-score, n - 1, axis=1)[:, n - 1, None]
    above, tied = score > edge, score == edge
    room = n - above.sum(axis=1, keepdims=True)
    return (above | (tied & (np.cumsum(tied, axis=1) <= room))) & np.isfinite(score)


def compared(queries: tuple, vectors: tuple, k: int, cross: int, allowed: list[int] | None) -> pa.RecordBatch:
    """The k best of one block of vectors for each of a block of queries, and the cross best of other types. Scores are
    rounded first, and ties go by type and id, so that what leaves a block is what a sort of all rows would keep."""
    (qt, qi, qm), (vt, vi, vm) = queries, vectors
    order = np.lexsort((vi, vt))
    vt, vi, vm = vt[order], vi[order], vm[order]
    score = np.round(qm @ vm.T, 6)
    score[(qt[:, None] == vt) & (qi[:, None] == vi)] = -np.inf
    if allowed is not None:
        score[:, ~np.isin(vt, allowed)] = -np.inf
    chosen = best(score, k)
    if cross:
        chosen |= best(np.where(qt[:, None] != vt, score, -np.inf), cross)
    r, c = np.nonzero(chosen)
    names = np.array(SORTED)
    return pa.RecordBatch.from_arrays([pa.array(names[qt[r]]), pa.array(qi[r]), pa.array(names[vt[c]]), pa.array(vi[c]), pa.array(score[r, c])], names=["item_type", "item_id", "other_type", "other_id", "score"])


def merged(found: list[pa.RecordBatch], k: int, cross: int) -> pa.RecordBatch:
    """What several blocks of vectors gave for one block of queries, cut to the k best and the cross best of other types of each query: a
    task holds no more rows of a query for having gone through more blocks."""
    rows = pa.Table.from_batches(found).to_pandas()
    rows = rows.sort_values(["item_type", "item_id", "score", "other_type", "other_id"], ascending=[True, True, False, True, True], ignore_index=True)
    keep = rows.groupby(["item_type", "item_id"], sort=False).cumcount() < k
    if cross:
        foreign = rows[rows["item_type"] != rows["other_type"]]
        first = foreign.groupby(["item_type", "item_id"], sort=False).cumcount() < cross
        keep[first.index[first]] = True
    return pa.RecordBatch.from_pandas(rows[keep], schema=found[0].schema, preserve_index=False)


#: Bytes of rows that a task's Python is handed at once. Rows here are blocks of a megabyte, of which the usual 10,000 would be 10 GB.
BATCH_BYTES = 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES, unless they are smaller."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if held is None or not held.isdigit() or int(held) > BATCH_BYTES or int(held) <= 0:
        spark.conf.set(name, str(BATCH_BYTES))


def packed(rows: DataFrame, name: str) -> DataFrame:
    """Rows (types, ids, matrix) of up to BLOCK unit vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                found = unit_rows(batch.slice(at, BLOCK))
                if len(found[1]):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in found], names=[f"{name}_{c}" for c in ("types", "ids", "matrix")])

    return rows.select("item_type", "item_id", "embedding").mapInArrow(run, ", ".join(f"{name}_{c} binary" for c in ("types", "ids", "matrix")))


def unpacked(types: bytes, ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return np.frombuffer(types, np.int8), i, np.frombuffer(matrix).reshape(len(i), -1)


def places(found: DataFrame, k: int, cross: int = 0) -> DataFrame:
    """found with ``place`` among all and ``cross_place`` among those of other types, the best k and cross of them."""
    order = [F.desc("score"), F.asc("other_type"), F.asc("other_id")]
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy(*ITEM).orderBy(*order)))
    other = F.col("item_type") != F.col("other_type")
    ranked = ranked.withColumn("cross_place", F.when(other, F.row_number().over(Window.partitionBy(*ITEM, other).orderBy(*order))))
    near, far = F.col("place") <= k, F.col("cross_place") <= cross
    # places further down aren't known, as what lies between stayed in the tasks
    return ranked.filter(near | far).withColumns({"place": F.when(near, F.col("place")), "cross_place": F.when(far, F.col("cross_place"))})


def neighbours(queries: DataFrame, vectors: DataFrame, k: int, types: tuple[str, ...] | None = None, cross: int = 0) -> DataFrame:
    """(item_type, item_id, other_type, other_id, score): for each query, the item itself apart, its k nearest vectors and
    the ``cross`` nearest of other types.

    Vectors are dealt over slots, queries go to every slot, and in a slot block meets block as a matrix product, of which
    only the best of each query leave the task; filters by type come before the ranking. This is exact and its work is
    queries times vectors: give it a stated set of queries, or see ``vector_index``. Vectors of another width than most, or with
    a value that is null or no number, are left out on both sides."""
    small_batches(vectors.sparkSession)
    width = width_of(vectors)
    queries, vectors = usable(queries, width), usable(vectors, width)
    allowed = None if types is None else [SORTED.index(t) for t in types]
    slots = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield compared(unpacked(*row[:3]), unpacked(*row[3:]), k, cross, allowed)

    near = packed(vectors, "v").withColumn("slot", F.pmod(F.xxhash64("v_ids"), F.lit(slots)).cast("int"))
    asked = packed(queries, "q").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    met = asked.join(near, "slot").select(*(f"{x}_{c}" for x in "qv" for c in ("types", "ids", "matrix")))
    return places(met.mapInArrow(run, KEYED), k, cross)


#: The index is fitted on FIT_VECTORS vectors at most (those with the smallest hash); every vector is put into it.
FIT_VECTORS, LISTS, LIST_ROWS = 20_000, 64, 50_000
#: As many lists are searched as give TUNE_QUERIES vectors of the sample this share of their true neighbours in the sample.
TUNE_QUERIES, TUNED_RECALL = 400, 0.96


def fit_rows(vectors: DataFrame) -> np.ndarray:
    sample = vectors.orderBy(F.xxhash64(*ITEM), *ITEM).limit(FIT_VECTORS).select("item_type", "item_id", "embedding").toArrow()
    parts = [unit_rows(b)[2] for b in sample.to_batches() if b.num_rows]
    return np.concatenate(parts) if parts else np.zeros((0, 1))


def centroids(rows: np.ndarray, lists: int = LISTS, rounds: int = 12) -> np.ndarray:
    """Centres of unit vectors by spherical k-means."""
    rng = np.random.default_rng(5)
    out = rows[rng.choice(len(rows), min(lists, len(rows)), replace=False)] if len(rows) else rows
    for _ in range(rounds if len(rows) else 0):
        near = (rows @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(size > 0, sums / np.maximum(size, 1e-12), out)
    return out


def probes_for(rows: np.ndarray, centres: np.ndarray, k: int, recall: float = TUNED_RECALL) -> int:
    """How many lists a query has to search, by the sample. Vectors without structure need most of them."""
    if len(rows) < 2:
        return 1
    asked = np.random.default_rng(6).choice(len(rows), min(TUNE_QUERIES, len(rows)), replace=False)
    score = rows[asked] @ rows.T
    score[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-score, axis=1)[:, : min(k, len(rows) - 1)]
    rank = np.argsort(np.argsort(-(rows[asked] @ centres.T), axis=1), axis=1)  # of each list, for each query
    home = (rows @ centres.T).argmax(axis=1)
    needed = np.take_along_axis(rank, home[true], axis=1).ravel()
    return int(np.quantile(needed, recall, method="higher")) + 1


def nearest_lists(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """rows (item, embedding) with ``list``, once for each of the nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                m = np.array(part.column(2).to_pylist(), dtype=np.float64).reshape(part.num_rows, -1)
                n = min(probes, len(centres))
                at_lists = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :n]
                row = np.repeat(np.arange(part.num_rows), n)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in range(3)), pa.array(at_lists.ravel().astype(np.int32))], names=["item_type", "item_id", "embedding", "list"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("item_type", "item_id", "embedding").mapInArrow(run, f"item_type string, item_id long, embedding {kind}, list int")


def ivf_neighbours(queries: DataFrame, vectors: DataFrame, k: int, recall: float = TUNED_RECALL, lists: int = LISTS) -> DataFrame:
    """(item_type, item_id, other_type, other_id, score, place): the k nearest among the vectors in the lists nearest to a
    query, by exact scores; an approximation, as a neighbour in another list is missed.

    Lists come from k-means on a bounded sample, which also says how many of them a query must search for the recall;
    every vector is in its nearest list. A list of more than LIST_ROWS
    vectors is split into parts, to all of which its queries go, so that no list is one task."""
    sample = fit_rows(vectors)
    centres = centroids(sample, lists)
    probes = probes_for(sample, centres, k, recall)
    placed = nearest_lists(vectors, centres, 1)
    parts = placed.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))  # as many rows as lists
    near = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64(*ITEM), F.col("parts")).cast("int")).drop("parts")
    asked = nearest_lists(queries, centres, probes).join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    cells = ["item_type", "item_id", "embedding", "list", "part"]

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        found = []
        blocks = [unit_rows(b) for b in other.select(cells[:3]).combine_chunks().to_batches(max_chunksize=BLOCK) if b.num_rows]
        for q in one.select(cells[:3]).combine_chunks().to_batches(max_chunksize=BLOCK):
            asked_rows = unit_rows(q)
            met = [compared(asked_rows, v, k, 0, None) for v in blocks if len(asked_rows[1])]
            found += [merged(met, k, 0)] if met else []
        names = pa.schema([("item_type", pa.string()), ("item_id", pa.int64()), ("other_type", pa.string()), ("other_id", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(found, names) if found else names.empty_table()

    met = asked.select(*cells).groupBy("list", "part").cogroup(near.select(*cells).groupBy("list", "part")).applyInArrow(run, KEYED)
    return places(met, k).drop("cross_place")


def knn(queries: DataFrame, vectors: DataFrame, k: int, types: tuple[str, ...] | None = None) -> DataFrame:
    return neighbours(queries, vectors, k, types).drop("cross_place")


def similar_pool(anchors: DataFrame, vectors: DataFrame, limit: int = PAGE, quota: int = QUOTA, pool: Callable[[DataFrame, int, int], DataFrame] | None = None) -> DataFrame:
    """Candidates of each anchor: with a quota the nearest of all and the nearest of other types, 6 times the page of
    either; without one only the anchor's own type. pool (anchors, n, quota) looks them up in an index, else the search is exact."""
    n = 6 * limit
    if pool is not None:
        return pool(anchors, n, quota)
    if quota > 0:
        return neighbours(anchors, vectors, n, cross=n)
    own = [knn(anchors.filter(F.col("item_type") == t), vectors.filter(F.col("item_type") == t), n) for t in TYPES]
    out = own[0]
    for more in own[1:]:
        out = out.unionByName(more)
    return out


def ranked_page(pool: pd.DataFrame, limit: int, quota: int, penalty: float) -> pd.DataFrame:
    """One anchor's candidates: picked greedily, a score shrinking by the penalty for each creator or franchise of the
    candidate that was picked before, then cut to the page with room kept for other types. The pool has 12 pages at most."""
    pool = pool.sort_values(["score", "other_type", "other_id"], ascending=[False, True, True], ignore_index=True)
    groups = [set(c) | ({f} if f else set()) for c, f in zip(pool["creators"], pool["franchise"], strict=True)]
    scores = pool["score"].to_numpy(copy=True)
    left, order = list(range(len(pool))), []
    while left:
        # max() keeps the first of equals, which the sorting put first
        best = max(left, key=lambda i: scores[i]) if penalty > 0 else left[0]
        left.remove(best)
        order.append(best)
        for i in left if penalty > 0 else []:
            scores[i] *= max(0.0, 1 - penalty) ** len(groups[i] & groups[best])
    foreign = [p for p, i in enumerate(order) if pool["other_type"][i] != pool["item_type"][i]][: min(max(quota, 0), limit)]
    rest = [p for p in range(len(order)) if p not in foreign][: limit - len(foreign)]
    page = pool.iloc[[order[p] for p in sorted(foreign + rest)]].reset_index(drop=True)
    page["place"] = np.arange(1, len(page) + 1)
    return page[["item_type", "item_id", "other_type", "other_id", "score", "place"]]


def similar(anchors: DataFrame, vectors: DataFrame, items: DataFrame, credits: DataFrame, limit: int = PAGE, quota: int = QUOTA, penalty: float = PENALTY, pool=None) -> DataFrame:
    """The page of similar items of every anchor with a vector; candidates that don't exist are dropped. pool: see ``similar_pool``."""
    # a person and a saga of one name are different groups
    makers = credits.filter(F.col("role").isin(*CREATORS)).groupBy(*ITEM).agg(F.collect_set(F.concat(F.lit("person "), F.col("person_id").cast("string"))).alias("creators"))
    live = items.select(*ITEM, F.concat(F.lit("saga "), franchise_key(F.col("title"))).alias("franchise")).join(makers, ITEM, "left").withColumn("creators", F.coalesce("creators", F.array().cast("array<string>")))
    far = live.withColumnsRenamed({"item_type": "other_type", "item_id": "other_id"})
    found = similar_pool(anchors, vectors, limit, quota, pool).select(*ITEM, "other_type", "other_id", "score").join(far, ["other_type", "other_id"])
    schema = "item_type string, item_id long, other_type string, other_id long, score double, place long"
    return found.groupBy(*ITEM).applyInPandas(lambda p: ranked_page(p, limit, quota, penalty), schema)


def similar_or_else(anchors: DataFrame, vectors: DataFrame, items: DataFrame, credits: DataFrame, item_genres: DataFrame, external: DataFrame, limit: int = PAGE, quota: int = QUOTA, penalty: float = PENALTY, pool=None) -> DataFrame:
    """(item, other, kind, place): the page of similar items of every anchor (item).

    By vector where the anchor has one that finds anything. Without, books show those of their authors and then those of
    their genres; other types what their source calls similar (external: item, other, rank), as far as it exists."""
    asked = anchors.select(*ITEM).distinct()
    by_vector = similar(vectors.join(asked, ITEM, "left_semi"), vectors, items, credits, limit, quota, penalty, pool)
    near = similar_reasons(by_vector).select(*ITEM, "other_type", "other_id", "kind", F.col("place").cast("int").alias("place"))
    rest = asked.join(near.select(*ITEM), ITEM, "left_anti")
    books = similar_books(rest.filter("item_type = 'BOOK'"), items, credits, item_genres, limit)
    live = items.select(F.col("item_type").alias("other_type"), F.col("item_id").alias("other_id"))
    told = external.join(rest.filter("item_type <> 'BOOK'"), ITEM, "left_semi").join(live, ["other_type", "other_id"], "left_semi")
    told = top_k_per_group(told, ITEM, [F.asc("rank"), F.asc("other_type"), F.asc("other_id")], limit).select(*ITEM, "other_type", "other_id", F.lit("EXTERNAL").alias("kind"), "place")
    return near.unionByName(books).unionByName(told)


def embedding_coverage(vectors: DataFrame) -> DataFrame:
    """(item_type, n, covered) for every type."""
    known = vectors.sparkSession.createDataFrame([(t,) for t in TYPES], "item_type string")
    found = vectors.groupBy("item_type").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return known.join(found, "item_type", "left").select("item_type", n.alias("n"), (n > 0).alias("covered"))


def embedding_sources(items: DataFrame, genres: DataFrame) -> DataFrame:
    """(item, text, hash): what an encoder reads of each item."""
    text = source_text(F.col("title"), F.col("original_title"), F.col("genres"), F.col("overview"))
    return items.join(genres, ITEM, "left").select(*ITEM, text.alias("text")).withColumn("hash", source_hash(F.col("text")))


def stale_sources(sources: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Sources without a stored vector of this model and text."""
    return sources.join(stored.filter(F.col("model") == model).select(*ITEM, "hash"), [*ITEM, "hash"], "left_anti")


def hashed_vectors(sources: DataFrame, dim: int = 64) -> DataFrame:
    """(item, embedding): the default encoder, signed counts of hashed words; any encoder of texts can stand in its place."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, dim), dtype=np.float32)
            for i, text in enumerate(batch.column(2).to_pylist()):
                for word in (text or "").lower().split():
                    h = zlib.crc32(word.encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(out), pa.list_(pa.float32()))], names=["item_type", "item_id", "embedding"])

    return sources.select(*ITEM, "text").mapInArrow(run, "item_type string, item_id long, embedding array<float>")


def embedding_pass(sources: DataFrame, stored: DataFrame, model: str, encode: Callable[[DataFrame], DataFrame] = hashed_vectors, dim: int = 64, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(stored, report) after the sources (item, text, hash) that have no vector of this model and text, or with force all, are encoded.

    A vector of another width than dim is refused and the item keeps what it has. report counts items as (outcome, n):
    embedded, refused, unchanged (a source with its vector), other (a vector without a source)."""
    stale = sources if force else stale_sources(sources, stored, model)
    made = encode(stale).join(sources.select(*ITEM, "hash"), ITEM).withColumn("fits", F.size("embedding") == dim)
    fresh = made.filter("fits").select(*ITEM, "embedding", "hash", F.lit(model).alias("model"))
    after = stored.join(fresh.select(*ITEM), ITEM, "left_anti").select(*ITEM, "embedding", "hash", "model").unionByName(fresh)
    encoded = made.select(*ITEM, F.when(F.col("fits"), "embedded").otherwise("refused").alias("outcome"))
    rest = stored.select(*ITEM).join(encoded, ITEM, "left_anti").join(sources.select(*ITEM, F.lit("unchanged").alias("known")), ITEM, "left").select(*ITEM, F.coalesce("known", F.lit("other")).alias("outcome"))
    return after, encoded.unionByName(rest).groupBy("outcome").agg(F.count("*").alias("n"))


def quotas(available: dict[str, int], cap: int, overrides: dict[str, int] | None = None) -> dict[str, int]:
    """Equal shares of the cap for the types; what a short type can't use goes to the others, the last units in the
    order of types. Overrides come first, up to what there is."""
    out = {t: min(max(0, (overrides or {}).get(t, 0)), available.get(t, 0)) for t in TYPES}
    open_types = [t for t in TYPES if t not in (overrides or {})]
    left = max(0, cap - sum(out.values()))
    while left and (open_types := [t for t in open_types if out[t] < available.get(t, 0)]):
        share, odd = divmod(left, len(open_types))
        for n, t in enumerate(open_types):
            more = min(share + (share == 0 and n < odd), available[t] - out[t])
            out[t] += more
            left -= more
    return out


def embedding_candidates(items: DataFrame, cap: int, overrides: dict[str, int] | None = None) -> DataFrame:
    """Up to cap items, each type's best within its quota. Each type is sorted by itself with a limit, so that a task keeps
    no more rows than the quota."""
    available = {r[0]: r[1] for r in items.groupBy("item_type").count().collect()}  # a row for each type
    allowed = quotas(available, cap, overrides)
    order = [F.desc(F.col("overview").isNotNull()), F.desc(F.coalesce("rating_count_external", F.lit(0))), F.desc(F.coalesce("rating_external", F.lit(0.0))), F.asc("item_id")]
    chosen = [items.filter(F.col("item_type") == t).orderBy(*order).limit(allowed[t]) for t in TYPES]
    kept = reduce(DataFrame.unionByName, chosen)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("item_type").orderBy(*order)))
