"""Pages by order statistics: rows kept in ranges of an order, with the number of rows in each.

On disk, under one path: ``rows/range=r`` (all columns and ``nth``, the place in the range) and ``counts`` (range, n, with the columns of the
rows), written last. A page
finds its ranges from the counts and reads nothing else, however far down it is; the total is known without a scan. A page ends
with a mark, from which the next page goes on without counting. A kept order is of one version of its rows: keep it anew
for the next version, under another path.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a range, in expectation.
RANGE_ROWS = 100_000
#: Ranges whose counts are added up before they go to the driver, which gets the counts of single ranges only where a page lies.
CHUNK = 1024


@dataclass
class Pages:
    spark: SparkSession
    path: str

    def _kept(self) -> DataFrame:
        """(range, n, chunk): the counts, and which CHUNK of ranges each is in."""
        found = self.spark.read.parquet(f"{self.path}/counts").select("range", "n").filter("n > 0")
        return found.withColumn("chunk", F.floor(F.col("range") / CHUNK).cast("int"))

    @property
    def counts(self) -> list[int]:
        """Rows of each range, in order; as many numbers as ranges."""
        found = {r["range"]: r["n"] for r in self._kept().collect()}
        return [found.get(r, 0) for r in range(max(found, default=-1) + 1)]

    def _chunks(self) -> list[tuple[int, int]]:
        """(chunk, rows) in order, one for CHUNK ranges."""
        return sorted((r["chunk"], r["n"]) for r in self._kept().groupBy("chunk").agg(F.sum("n").alias("n")).collect())

    def _ranges(self, chunks: list[int]) -> list[tuple[int, int]]:
        return sorted((r["range"], r["n"]) for r in self._kept().filter(F.col("chunk").isin(chunks)).collect())

    def total(self) -> int:
        return sum(n for _, n in self._chunks())

    def _read(self, ranges: list[int]) -> DataFrame:
        columns = StructType.fromJson(json.loads(self.spark.read.parquet(f"{self.path}/counts").first()["columns"]))
        if not ranges:
            return self.spark.createDataFrame([], columns)
        # only the folders of these ranges are listed
        return self.spark.read.schema(columns).option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/range={r}" for r in ranges)).select(*columns.names)

    def _from(self, rank: int, limit: int) -> DataFrame:
        """limit rows from a rank on, by (range, nth)."""

        def met(parts: list[tuple[int, int]], at: int) -> list[tuple[int, int, int, int]]:
            """(part, its first row, its first wanted row, the one after its last) of the parts that hold wanted rows."""
            out = []
            for part, n in parts:
                lo, hi = max(rank, at), min(rank + limit, at + n)
                if lo < hi:
                    out.append((part, at, lo - at, hi - at))
                at += n
            return out

        chunks = met(self._chunks(), 0)
        wanted = met(self._ranges([c for c, *_ in chunks]), chunks[0][1]) if chunks else []
        inside = F.lit(False)
        for r, _, lo, hi in wanted:
            inside = inside | ((F.col("range") == r) & (F.col("nth") >= lo) & (F.col("nth") < hi))
        return self._read([r for r, *_ in wanted]).filter(inside).orderBy("range", "nth")

    def page(self, number: int, limit: int) -> DataFrame:
        """Page number (from 1) of limit rows, with ``total`` and each row's ``mark`` (range, nth)."""
        if number < 1 or limit < 1:
            raise ValueError("pages and limits begin at 1")
        return self._marked(self._from((number - 1) * limit, limit))

    def after(self, mark: tuple[int, int], limit: int) -> DataFrame:
        """The limit rows that follow the row of a mark."""
        chunk = mark[0] // CHUNK
        before = sum(n for c, n in self._chunks() if c < chunk) + sum(n for r, n in self._ranges([chunk]) if r < mark[0])
        return self._marked(self._from(before + mark[1] + 1, limit))

    def _marked(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"total": F.lit(self.total()).cast("long"), "mark": F.struct("range", "nth")}).drop("range", "nth")


def keep(rows: DataFrame, order: list[Column], path: str, range_rows: int = RANGE_ROWS) -> Pages:
    """Keep rows in an order, whose ties must be settled, under path. One sort by range; equal rows may lie in two ranges."""
    spark = rows.sparkSession
    n = rows.count()
    parts = max(1, -(-n // range_rows))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    low = (1 << 33) - 1  # the id is the task's number, then the row's number in the task
    ranged = placed.select("*", F.shiftright("at", 33).cast("int").alias("range"), F.col("at").bitwiseAND(F.lit(low)).alias("nth")).drop("at")
    ranged.write.partitionBy("range").parquet(f"{path}/rows")
    counts = spark.read.schema(ranged.schema).parquet(f"{path}/rows").groupBy("range").agg(F.count("*").alias("n"))
    nothing = spark.range(1).select(F.lit(0).alias("range"), F.lit(0).cast("long").alias("n"))  # the columns are kept without rows too
    counts.unionByName(nothing).withColumn("columns", F.lit(ranged.schema.json())).coalesce(1).write.parquet(f"{path}/counts")
    return Pages(spark, path)
