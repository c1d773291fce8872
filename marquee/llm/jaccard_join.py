"""N-gram Jaccard join: prefix filtering from the rarest shingle on, with length, positional and suffix filters, exact verification.

A text's set are its distinct shingles of five words. Two texts link if their sets' Jaccard similarity is 0.8 or more. All shingles are
ordered from rare to frequent. Sets of n shingles that are similar share one of their first n - ceil(0.8 n) + 1, so it is
enough to join on these.

1. Equal sets are one group from the start. Groups are found by hashes of the sets; a bitmap of bounded size lets the
   texts of sets that occur once through, so only the texts of repeated sets are shuffled, combined before.
2. Counts. Each task packs its shingles for buckets of hashes: 6 bytes of hash, 2 bytes for the text, 8 bytes for each text once. A bucket
   is sorted in one task, of bounded size as the number of buckets follows the number of shingles. Shingles that many texts of one
   task share aren't gathered: their bucket hears of them once, they rank behind all others, by hash, and their texts are spread over all
   buckets. The order needn't be that of the exact counts, only the same for all texts.
3. A shingle of one text only joins nothing. So only the others are sent back to their texts, with their counts; a text with
   enough unique shingles is done here, as most are. The rest have prefixes, and keep their shared shingles for what follows.
4. The join on prefix shingles. Buckets of texts that share one are first compared with the most central text, and
   then, where several groups are left, by pairs that pass the filters or, if they are large, by blocks (see ``near_copies``, which takes
   these steps for its own buckets). Filters of a pair that shares the shingle at places i and j: the smaller set has 0.8 of the larger (length); what
   is left behind i and j can still make the overlap needed (positional); and so can the shared shingles, counted in eight
   ranges of their hashes, the smaller count of each (suffix). Each pair is verified once, by its shared shingles and the number of the unique
   ones.

Inputs: null texts and those without words have no shingles, link with nothing and have their own id as component. A text of one to four words
is one shingle. Rows with a null id belong to the group of their text; a group in which no row has an id has a null component. Repeated
rows get equal results. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.bitmaps import bitmap, contained
from marquee.llm.common import cut, lookup, table
from marquee.llm.components import components
from marquee.llm.near_copies import SIMILAR, Texts, linked_groups, may_link, shingle_sets
from marquee.llm.textbytes import mix, slices

#: Shingles of a bucket in expectation, and buckets at least.
BUCKET_ROWS, BUCKETS = 1 << 22, 32
#: A task packs so many shingles, of so many texts, at once.
PACK_ROWS, PACK_TEXTS = 1 << 22, 1 << 16
#: A shingle in so many texts of a pack isn't gathered in its bucket.
OFTEN = 256
LOW = np.uint64((1 << 48) - 1)
#: The count of a shingle that isn't gathered.
MOST = (1 << 32) - 1
SHARED = np.dtype([("n", "<u4"), ("h", "<u8")])
#: Ranges of the suffix filter.
RANGES = 8


def set_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles (text number, hash) of all texts, and a hash of each text's set (0 without shingles)."""
    of, s = shingle_sets(texts)
    n = np.bincount(of, minlength=len(texts))
    some = np.flatnonzero(n)
    fp = np.zeros(len(texts), dtype=np.uint64)
    if len(some):
        fp[some] = np.add.reduceat(mix(s), np.searchsorted(of, some))
    return of, s, fp


def sizes(docs: DataFrame) -> DataFrame:
    """(id, fp, n) of rows (id, t): the hash of the set, null without shingles, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                of, _, fp = set_hashes(part.column("t"))
                n = np.bincount(of, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64), mask=n == 0), pa.array(n)], names=["id", "fp", "n"])

    return docs.select("id", "t").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long, n long")


def repeated_texts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(fp, t): a text of each set that the bitmap holds."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                of, _, fp = set_hashes(part.column("t"))
                keep = contained(sent.value, fp) & (np.bincount(of, minlength=part.num_rows) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), part.column("t")], names=["fp", "t"]).filter(pa.array(keep))

    return docs.select("t").mapInArrow(run, "fp long, t string").groupBy("fp").agg(F.first("t").alias("t"))


def six_bytes(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.uint64)


PACK = "bucket int, low binary, text binary, fps binary, often binary"


def packed(texts: DataFrame, buckets: int, bits: np.ndarray | None = None) -> DataFrame:
    """The shingles of texts (t), each set once, packed by bucket: the upper bits of the hash. Sets that the bitmap holds are left out.
    Rows of buckets beyond ``buckets`` hold whole hashes of shingles that many texts share."""
    sent = texts.sparkSession.sparkContext.broadcast(bits) if bits is not None else None
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def pack(hashes: list[np.ndarray], texts_of: list[np.ndarray], fps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, of, fp = np.concatenate(hashes), np.concatenate(texts_of), np.concatenate(fps)
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        count = np.diff(np.r_[first, len(h)])
        common = count >= OFTEN
        often, is_often = h[first[common]], np.repeat(common, count)
        rows = []
        if len(often):
            # dealt out evenly, as whole hashes
            x, o = h[is_often], of[is_often]
            to = (mix(o.astype(np.uint64) + x) % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(to).tolist():
                mine = to == b
                rows.append((buckets + b, x[mine].astype("<u8").tobytes(), o[mine], b""))
        x, o = h[~is_often], of[~is_often]
        edges = np.searchsorted(x >> shift, np.arange(buckets + 1).astype(np.uint64))
        told = often >> shift
        for b in range(buckets):
            lo, hi = int(edges[b]), int(edges[b + 1])
            mine = often[told == np.uint64(b)] if len(often) else often
            if hi > lo or len(mine):
                rows.append((b, six_bytes(x[lo:hi]), o[lo:hi], six_bytes(mine)))
        for b, low, o, told_of in rows:
            used, at = np.unique(o, return_inverse=True)
            values = [pa.array([b], pa.int32()), *(pa.array([v], pa.binary()) for v in (low, at.astype("<u2").tobytes(), fp[used].astype("<u8").tobytes(), told_of))]
            yield pa.RecordBatch.from_arrays(values, names=["bucket", "low", "text", "fps", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, texts_of, fps, rows, n_texts = [], [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "t"):
                of, s, fp = set_hashes(part.column("t"))
                if sent is not None:
                    keep = ~contained(sent.value, fp)
                    number = np.cumsum(keep) - 1
                    inside = keep[of]
                    of, s, fp = number[of[inside]], s[inside], fp[keep]
                if rows and (rows + len(s) > PACK_ROWS or n_texts + len(fp) > PACK_TEXTS):
                    yield from pack(hashes, texts_of, fps)
                    hashes, texts_of, fps, rows, n_texts = [], [], [], 0, 0
                hashes.append(s)
                texts_of.append((of + n_texts).astype(np.int32))
                fps.append(fp)
                rows, n_texts = rows + len(s), n_texts + len(fp)
        if rows:
            yield from pack(hashes, texts_of, fps)

    return texts.select("t").mapInArrow(run, PACK)


def shared_shingles(packs: DataFrame, buckets: int) -> DataFrame:
    """(fp, shared): of each set the shingles that others have too, with their counts, as SHARED records; several rows for a set.
    Of a hash the upper bits, by which the buckets are numbered, and the lower 48 are known from here on."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        whole = bucket >= buckets
        columns = {c: [x.as_py() for x in group.column(c)] for c in ("low", "text", "fps", "often")}
        low = [np.frombuffer(x, dtype="<u8") if whole else from_six(x) for x in columns["low"]]
        fp = [np.frombuffer(f, dtype="<u8")[np.frombuffer(t, dtype="<u2")] for f, t in zip(columns["fps"], columns["text"], strict=True)]
        h, fp = np.concatenate(low).astype(np.uint64), np.concatenate(fp).astype(np.uint64)
        if whole:
            n = np.full(len(h), MOST, dtype=np.uint32)
            h = h & LOW | h >> shift << shift
        else:
            order = np.argsort(h, kind="stable")
            h, fp = h[order], fp[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
            count = np.diff(np.r_[first, len(h)])
            often = np.concatenate([from_six(x) for x in columns["often"]])
            count[np.isin(h[first], often)] = MOST
            n = np.repeat(count, np.diff(np.r_[first, len(h)]))
            keep = n > 1
            h, fp, n = h[keep] | np.uint64(bucket) << shift, fp[keep], n[keep].astype(np.uint32)
        order = np.argsort(fp, kind="stable")
        out = np.empty(len(h), dtype=SHARED)
        out["n"], out["h"], fp = n[order], h[order], fp[order]
        first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]][: len(fp)])
        records = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.r_[first, len(fp)] * SHARED.itemsize).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
        return pa.table({"fp": pa.array(fp[first].view(np.int64)), "shared": records})

    return packs.groupBy("bucket").applyInArrow(run, "fp long, shared binary")


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles of the prefix of a set of n."""
    return n - -(-SIMILAR * n // 100) + 1


def prefixes(sets: DataFrame) -> DataFrame:
    """(fp, n, keys, counts, t) of sets (fp, n, shared) that have a shared shingle in their prefix: keys are those (h, place), counts are of shared
    shingles by range of hash, and t holds what verification wants: the set's hash, how many unique shingles it has, and the shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fp, n, parts in zip(batch.column("fp").to_pylist(), batch.column("n").to_pylist(), batch.column("shared").to_pylist(), strict=True):
                s = np.frombuffer(b"".join(parts), dtype=SHARED)
                unique = n - len(s)
                take = int(needed(np.array(n)) - unique)
                if take > 0:
                    h = s["h"][np.lexsort((s["h"], s["n"]))]
                    body = np.r_[np.array([fp, unique], dtype=np.int64).view(np.uint64), np.sort(h)].astype("<u8").tobytes()
                    rows.append((fp, n, [{"key": int(k), "place": unique + i} for i, k in enumerate(h[:take].astype(np.int64))], np.bincount(h % RANGES, minlength=RANGES).tolist(), body))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int64())])), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["fp", "n", "keys", "counts", "t"])

    return sets.mapInArrow(run, "fp long, n long, keys array<struct<key:bigint,place:bigint>>, counts array<int>, t binary")


def whole_sets(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(set number, hash) of bodies from ``prefixes``, in order; unique shingles get hashes of their set's own."""
    of, found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
    for i, raw in enumerate(bodies.to_pylist()):
        x = np.frombuffer(raw, dtype="<u8").astype(np.uint64)
        own = mix(x[0] + np.arange(int(x[1]), dtype=np.uint64))
        both = np.sort(np.r_[x[2:], own])
        of.append(np.full(len(both), i))
        found.append(both)
    return np.concatenate(of), np.concatenate(found)


def may_be_similar(other: str) -> Column:
    """The filters of a pair that shares a prefix shingle; they hold for the first shingle that a similar pair shares."""
    n, m = F.col("n"), F.col(f"n{other}")
    behind = 1 + F.least(n - F.col("place") - 1, m - F.col(f"place{other}") - 1)
    counted = F.aggregate(F.zip_with("counts", f"counts{other}", lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
    enough = lambda overlap: overlap * (100 + SIMILAR) >= SIMILAR * (n + m)
    return may_link(n, m) & enough(behind) & enough(counted)


def jaccard_links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): links that connect all similar sets; docs (id, t), and groups (fp, n, w) of equal sets."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(BUCKETS.bit_length() - 1, int(-(-total // BUCKET_ROWS)).bit_length())
    repeated = cut(groups.filter("w > 1").select(F.col("fp").alias("h")), "repeated-sets")
    bits = bitmap(repeated)
    packs = packed(docs, buckets, bits).unionByName(packed(repeated_texts(docs, bits), buckets))
    found = shared_shingles(packs, buckets).groupBy("fp").agg(F.collect_list("shared").alias("shared"))
    sets = cut(prefixes(found.join(groups.select("fp", "n"), "fp").select("fp", "n", "shared")), "prefix-sets")
    members = sets.select("fp", "n", "counts", F.explode("keys").alias("k")).select("k.key", "fp", "n", "k.place", "counts")
    texts = Texts(sets.select(F.col("fp").alias("row"), "t"), sets.select("fp", F.col("fp").alias("row")), whole_sets)
    return linked_groups(members, texts, may=may_be_similar)


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id reachable over links, its own included."""
    rows = docs.select(docs[id_column].alias("id"), docs[text].alias("t"))
    sized = cut(sizes(rows), "set-sizes")
    groups = cut(sized.filter("n > 0").groupBy("fp").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.count("*").alias("w")), "equal-sets")
    roots = components(jaccard_links(rows, groups)).withColumnRenamed("node", "fp")
    rooted = cut(groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "set-roots")
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("wr")), "root-names")
    by_set = cut(lookup(rooted, named, "root", "wr").select("fp", "component_id", "w"), "set-components")
    linked = lookup(sized.filter("n > 0"), by_set, "fp", "w").select("id", "n", "component_id")
    alone = sized.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT rid, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i, w FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS x FROM g
), n AS (
  SELECT rid, count(*) AS n, sha256(string_agg(x, chr(10) ORDER BY x)) AS k FROM s GROUP BY rid
), r AS (
  SELECT min(rid) AS rid, k, any_value(n) AS n FROM n GROUP BY k
), t AS (
  SELECT s.rid, s.x FROM s JOIN r USING (rid)
), p AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS m FROM t AS a JOIN t AS b ON a.x = b.x AND a.rid < b.rid GROUP BY a.rid, b.rid
), e AS (
  SELECT p.a, p.b FROM p JOIN r AS u ON u.rid = p.a JOIN r AS v ON v.rid = p.b WHERE 100 * p.m >= 80 * (u.n + v.n - p.m)
), y AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), c AS (
  SELECT rid AS a, rid AS b FROM r
  UNION
  SELECT c.a, y.b FROM c JOIN y ON y.a = c.b
), o AS (
  SELECT c.a, min(d.doc_id) AS component_id FROM c JOIN r ON r.rid = c.b JOIN n ON n.k = r.k JOIN d ON d.rid = n.rid GROUP BY c.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE o.component_id END AS component_id
FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN r ON r.k = n.k LEFT JOIN o ON o.a = r.rid
"""
