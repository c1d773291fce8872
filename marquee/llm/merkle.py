"""A Merkle manifest of a dataset: digests of its rows, folded in threes to a root for each source and one for all, with a proof for each row.

A row's leaf is the digest of its columns; the leaves of a source, by id, are the nodes of level 0. Node i of a level has slot i % 3 in
the run of its parent i // 3. At every level the nodes are joined with themselves twice: slot s meets the nodes at slots s + 1 and s + 2
(modulo 3) of its run, whose indices are computed; a node that isn't there is a shorter run. The rows of slot zero, which then hold
their whole run, emit the parents. The level's other product is each node's step: what lies left and right of it in its run.
When every source has one node left, these subroots, by name, go through the same as one tree.

Proofs come from the top down: a node's path is its own step and then its parent's path, so a path is handed on to three nodes at most,
and what is shuffled for all proofs is a fraction of what they hold. Digests travel as 32 bytes.

Places within a source come from one sort of all leaves by range, in which wholly equal rows can be split too; a source of any size takes
part with all its ranges. All join keys are unique on both sides, so none is hot. Every level is cut.

Inputs: a null column is digested as ``-``. Ids ascend with null ids first; of equal ids the smaller leaf comes first, and rows that
are equal throughout have places next to each other in any order (their leaves are equal). A null source is a source of its own, before
all others. A lone leaf is its source's subroot, a lone source's subroot is the root, and a proof without siblings is the digest of nothing. An empty
table gives no rows. Columns that aren't digested aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.common import cut, lookup, table

#: Nodes of a run.
ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:binary,right:binary>"


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def as_text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def framed(value: Column) -> Column:
    """The value with its length in bytes before it, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(framed, values)))


def run_of(left: Column, own: Column, right: Column) -> Column:
    """The digest of a run, from raw digests: of their hex texts, one after the other."""
    return digest(as_text(F.concat(left, own, right)))


def placed(leaves: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """leaves with ``i``, the place in their tree from 0, and ``n``, the tree's size. tree is a struct, so that it can be joined."""
    rows = cut(leaves.orderBy(tree, *order).withColumn("at", F.monotonically_increasing_id()), "sorted-leaves")
    rows = rows.withColumn("key", F.struct(tree, F.shiftright("at", 33).alias("range")))
    runs = cut(rows.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("w")), "leaf-ranges")
    # a row for each tree and range in which it lies; only trees of several ranges have more than one
    all_of = Window.partitionBy(f"key.{tree}").orderBy("key.range")
    before = F.sum("w").over(all_of.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("w").over(all_of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = cut(runs.select("key", "w", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"), total.alias("n")), "leaf-starts")
    return lookup(rows, starts, "key", "w").withColumn("i", F.col("at") + F.col("offset")).drop("key", "at", "offset")


def joined_runs(level: DataFrame) -> DataFrame:
    """The nodes (tree, i, n, d) of a level with ``left`` and ``right``, the digests of their siblings."""
    slot = F.col("i") % ARITY
    for s in range(1, ARITY):
        other = level.select("tree", F.col("i").alias("j"), F.col("d").alias(f"d{s}"))
        level = level.withColumn("j", F.col("i") - slot + (slot + s) % ARITY).join(other, ["tree", "j"], "left").drop("j")
    # slot + s is left of slot if it goes around
    around = [F.when(slot + s >= ARITY, F.col(f"d{s}")) for s in range(1, ARITY)]
    ahead = [F.when(slot + s < ARITY, F.col(f"d{s}")) for s in range(1, ARITY)]
    glued = lambda found: reduce(lambda a, b: F.concat(a, b), [F.coalesce(x, F.lit(b"")) for x in found])
    return level.select("tree", "i", "n", "d", glued(around).alias("left"), glued(ahead).alias("right"))


def folded(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """nodes (tree, i, n, d): the levels with their steps, from the bottom, and the roots (tree, d)."""
    steps, roots = [], [nodes.filter("n = 1").select("tree", "d")]
    rest = nodes.filter("n > 1")
    while not rest.isEmpty():
        steps.append(cut(joined_runs(rest), f"{name}-{len(steps)}"))
        size = F.floor((F.col("n") + ARITY - 1) / ARITY)
        parents = steps[-1].filter(F.col("i") % ARITY == 0).select("tree", F.floor(F.col("i") / ARITY).alias("i"), size.alias("n"), run_of(F.col("left"), F.col("d"), F.col("right")).alias("d"))
        parents = cut(parents, f"{name}-parents-{len(steps)}")
        roots.append(parents.filter("n = 1").select("tree", "d"))
        rest = parents.filter("n > 1")
    return steps, cut(reduce(DataFrame.unionByName, roots), f"{name}-roots")


def paths(steps: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, i, path): the steps of each node of the lowest level to the root of its tree, and then those of the top (tree, path)."""
    known = None
    for level in reversed(steps):
        own = F.array(F.struct("left", "right"))
        mine = level.select("tree", "i", F.floor(F.col("i") / ARITY).alias("j"), "n", own.alias("own"))
        last = mine.filter(F.col("n") <= ARITY).join(tops, "tree")  # their parent is the root
        if known is not None:
            above = known.select("tree", F.col("i").alias("j"), "path")
            last = last.unionByName(mine.filter(F.col("n") > ARITY).join(above, ["tree", "j"]))
        known = cut(last.select("tree", "i", F.concat("own", "path").alias("path")), "paths")
    return known if known is not None else tops.select("tree", F.lit(0).cast("long").alias("i"), "path").limit(0)


def folded_up(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda d, step: run_of(step["left"], d, step["right"]))


def manifest(leaves: DataFrame, tree: str = "source", order: tuple[str, ...] = ()) -> DataFrame:
    """leaves (with the columns ``d``, a raw digest, and tree), with ``subroot``, ``root`` and ``path``, the steps (left, right) to the
    root; the leaves of a tree are ordered by ``order``, then by digest."""
    named = leaves.withColumn("tree", F.struct(F.col(tree).alias("name"))).withColumn("row", F.monotonically_increasing_id())
    rows = cut(placed(named, "tree", [*order, "d", "row"]), "placed-leaves")
    steps, subroots = folded(rows.select("tree", "i", "n", "d"), "source-tree")

    whole = subroots.withColumnRenamed("tree", "below").withColumn("tree", F.struct(F.lit("").alias("name")))
    tops = cut(placed(whole, "tree", ["below", "d"]), "placed-subroots")
    top_steps, roots = folded(tops.select("tree", "i", "n", "d"), "top-tree")
    ends = roots.select("tree", F.array().cast(f"array<{STEP}>").alias("path"))
    top_paths = paths(top_steps, ends)
    found = tops.join(top_paths, ["tree", "i"], "left").select(F.col("below").alias("tree"), F.coalesce("path", F.array().cast(f"array<{STEP}>")).alias("path"))
    sizes = rows.groupBy("tree").agg(F.count("*").alias("w"))
    found = cut(found.join(subroots.withColumnRenamed("d", "subroot"), "tree").join(sizes, "tree"), "subroot-paths")
    root = roots.first()  # the one node at the top
    found = found.withColumn("root", F.lit(root and bytes(root["d"])).cast("binary"))

    lone = found.filter("w = 1").select("tree", F.lit(0).cast("long").alias("i"), "path")
    each = paths(steps, found.select("tree", "path")).unionByName(lone)
    known = cut(rows.select("tree", "i", *leaves.columns).join(each, ["tree", "i"]), "leaf-paths")
    return lookup(known, found.select("tree", "subroot", "root", "w"), "tree", "w").drop("tree", "i")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = leaf([F.col(c) for c in COLUMNS])
    changed = leaf([F.translate("text", "\n", "") if c == "text" else F.col(c) for c in COLUMNS])
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    leaves = cut(docs.select("doc_id", "source", own.alias("d"), F.when(tampered, changed).alias("other")), "leaves")
    found = manifest(leaves, "source", ("doc_id",))
    siblings = F.aggregate("path", F.lit(b""), lambda a, s: F.concat(a, s["left"], s["right"]))
    again = folded_up(F.coalesce("other", "d"), F.col("path"))
    out = found.select("doc_id", "d", "subroot", "root", siblings.alias("siblings"), again.alias("again"))
    return out.select(
        "doc_id",
        as_text(F.col("d")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"),
        as_text(F.col("root")).alias("root"),
        F.sha2(as_text(F.col("siblings")), 256).alias("proof_sha256"),
        as_text(F.col("again")).alias("folded_root"),
        (F.col("again") == F.col("root")).alias("verified"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE b AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS rid, coalesce(source, '') || CASE WHEN source IS NULL THEN 'null' ELSE 'name' END AS tree FROM documents
), f AS (
  SELECT rid, doc_id, source, tree,
         list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')) AS h,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS t,
         replace(text, chr(10), '') AS cut,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                         lambda x, y: list_reduce(range(8), lambda z, k: xor(z >> 1, (z & 1) * 3988292384), xor(x, y)),
                         CAST(4294967295 AS BIGINT)), 4294967295) % 2 = 0 AS even
  FROM b
), l AS (
  SELECT rid, doc_id, source, tree, sha256(array_to_string(h, '') || t) AS leaf,
         CASE WHEN even THEN sha256(array_to_string(h, '') || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) END AS other
  FROM f
), o AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l
), s AS (
  SELECT tree, 0 AS level, i, n, leaf AS d FROM o
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM s WHERE n > 1 GROUP BY tree, level, n, i // 3
), r AS (
  SELECT s.tree, d AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM s JOIN (SELECT DISTINCT tree, source FROM l) USING (tree) WHERE s.n = 1
), t AS (
  SELECT 0 AS level, i, n, subroot AS d FROM r
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY level, n, i // 3
), top AS (
  SELECT d AS root FROM t WHERE n = 1
), nodes AS (
  SELECT tree, level, i, d FROM s WHERE n > 1
), up AS (
  SELECT rid, tree, level, unnest(range(level + 1)) AS lv, o.i FROM o JOIN (SELECT tree, max(level) AS level FROM s GROUP BY tree) USING (tree)
), steps AS (
  SELECT rid, lv, x.i < up.i // CAST(3 ** lv AS BIGINT) AS is_left, x.i, x.d
  FROM up JOIN nodes AS x ON x.tree = up.tree AND x.level = up.lv AND x.i // 3 = up.i // CAST(3 ** (lv + 1) AS BIGINT) AND x.i <> up.i // CAST(3 ** lv AS BIGINT)
  UNION ALL
  SELECT rid, height + k AS lv, t.i < r.i // CAST(3 ** k AS BIGINT), t.i, t.d
  FROM o JOIN r USING (tree), (SELECT unnest(range(20)) AS k) AS ks
  JOIN t ON t.level = k AND t.n > 1 AND t.i // 3 = r.i // CAST(3 ** (k + 1) AS BIGINT) AND t.i <> r.i // CAST(3 ** k AS BIGINT)
), runs AS (
  SELECT rid, lv, coalesce(string_agg(d, '' ORDER BY i) FILTER (is_left), '') AS a, coalesce(string_agg(d, '' ORDER BY i) FILTER (NOT is_left), '') AS z FROM steps GROUP BY rid, lv
), chain AS (
  -- a level at which the run has only the node itself has no siblings but is digested too
  SELECT o.rid, g.lv, coalesce(a, '') AS a, coalesce(z, '') AS z
  FROM o JOIN r USING (tree) CROSS JOIN (SELECT max(level) AS top FROM t) AS m, LATERAL (SELECT unnest(range(height + m.top)) AS lv) AS g
  LEFT JOIN runs ON runs.rid = o.rid AND runs.lv = g.lv
), proofs AS (
  SELECT rid, sha256(string_agg(a || z, '' ORDER BY lv)) AS proof, list({'a': a, 'z': z} ORDER BY lv) AS path FROM chain GROUP BY rid
), done AS (
  SELECT o.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof, coalesce(other, leaf) AS start, coalesce(path, []) AS path
  FROM o JOIN r USING (tree) CROSS JOIN top LEFT JOIN proofs ON proofs.rid = o.rid
), again AS (
  SELECT *, list_reduce(path, lambda x, y: {'a': '', 'z': sha256(y.a || x.z || y.z)}, {'a': '', 'z': start}).z AS folded FROM done
)
SELECT doc_id, leaf, subroot, root, proof AS proof_sha256, folded AS folded_root, folded = root AS verified FROM again
"""
