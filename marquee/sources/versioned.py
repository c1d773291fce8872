"""Tables in versions: a base in buckets of its key, change files over it, and a list of versions that is switched at once.

On disk, under one path:

    base-n, changes-n  Parquet in buckets of the key; a change file holds whole rows as they are from version n on, or only the key of
                       one that is ``gone``
    versions/v=n       one row (base, changes): which files make up version n, written last

What is written for a version belongs to nothing until its row under ``versions`` is there. So a run that dies before that leaves
the table as it was, and readers of older versions are never disturbed. Of two writers of the same version the second fails
and can try again on what the first has left. ``compact`` folds the changes into a new base.

A batch is looked up, and the changes are laid over the base, by joins on the key; the base lies in its buckets already, so it is
never shuffled, and what is written for an upsert is the batch's rows alone. Keys must not be null; rows of a null key are refused.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.operators.resolve import upsert as merged

BUCKETS = 32


def _name(at: str) -> str:
    return f"marquee_{zlib.crc32(at.encode()):08x}_{len(at)}"


def _table(spark: SparkSession, at: str, schema: StructType, key: list[str], buckets: int) -> DataFrame:
    """The bucketed files at a path, by a name in the session's catalog, which is how Spark learns of their buckets."""
    name = _name(at)
    if not spark.catalog.tableExists(name):
        columns, keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), ", ".join(f"`{k}`" for k in key)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{at}'")
    return spark.table(name)


def _write(rows: DataFrame, at: str, key: list[str], buckets: int) -> None:
    name = f"{_name(at)}_new"
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # a task for each bucket, so a file for each
    rows.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).option("path", at).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table, whose files stay


@dataclass
class VersionedTable:
    spark: SparkSession
    path: str
    key: list[str]
    buckets: int
    schema: StructType

    def current(self) -> int:
        found = self.spark.read.schema("base int, changes array<int>, v int").parquet(f"{self.path}/versions").agg(F.max("v")).first()[0]
        if found is None:
            raise ValueError(f"no version under {self.path}")
        return found

    def _files(self, version: int) -> tuple[int, list[int]]:
        row = self.spark.read.schema("base int, changes array<int>").parquet(f"{self.path}/versions/v={version}").first()
        return row["base"], list(row["changes"])

    def _switch(self, version: int, base: int, changes: list[int]) -> int:
        self.spark.createDataFrame([(base, changes)], "base int, changes array<int>").coalesce(1).write.mode("error").parquet(f"{self.path}/versions/v={version}")
        return version

    def base(self, version: int | None = None) -> DataFrame:
        number = self._files(self.current() if version is None else version)[0]
        return _table(self.spark, f"{self.path}/base-{number}", self.schema, self.key, self.buckets)

    def changes(self, version: int | None = None) -> DataFrame | None:
        """The rows that lie over the base, each key as it is at last, with ``gone``; None where there are none."""
        numbers = self._files(self.current() if version is None else version)[1]
        if not numbers:
            return None
        with_flag = StructType([*self.schema.fields]).add("gone", "boolean")
        parts = [_table(self.spark, f"{self.path}/changes-{n}", with_flag, self.key, self.buckets).withColumn("change", F.lit(n)) for n in numbers]
        both = reduce(DataFrame.unionByName, parts)
        if len(parts) == 1:
            return both.drop("change")
        rest = [c for c in both.columns if c not in (*self.key, "change")]
        last = both.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "change").alias("r"))
        return last.select(*self.key, *(F.col("r")[c].alias(c) for c in rest))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, or the current one."""
        version = self.current() if version is None else version
        base, over = self.base(version), self.changes(version)
        if over is None:
            return base
        live = over.filter(~F.col("gone")).select(*self.schema.names)
        return base.join(over.select(*self.key), self.key, "left_anti").select(*self.schema.names).unionByName(live)

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of these keys."""
        version = self.current() if version is None else version
        wanted, over = keys.select(*self.key).distinct(), self.changes(version)
        found = self.base(version).join(wanted, self.key, "left_semi").select(*self.schema.names)
        if over is None:
            return found
        changed = over.join(wanted, self.key, "left_semi")
        return found.join(changed.select(*self.key), self.key, "left_anti").unionByName(changed.filter(~F.col("gone")).select(*self.schema.names))

    def stage(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Write rows (with all columns) and keys of rows that go as the changes of the next version, without switching to it; its number."""
        number = self.current() + 1
        changed = rows.select(*self.schema.names).withColumn("gone", F.lit(False))
        if gone is not None:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.key]
            changed = changed.unionByName(gone.select(*self.key, *empty).withColumn("gone", F.lit(True)))
        good = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.key))
        _write(changed.withColumn(self.key[0], F.when(good, F.col(self.key[0])).otherwise(F.raise_error(F.lit("null key")))), f"{self.path}/changes-{number}", self.key, self.buckets)
        return number

    def commit(self, number: int) -> int:
        """Switch to the version whose changes have been staged."""
        base, changes = self._files(number - 1)
        return self._switch(number, base, [*changes, number])

    def upsert(self, batch: DataFrame, columns: list[str], locked: dict[str, str] | None = None) -> tuple[int, DataFrame]:
        """Put a batch (key, pos, columns) in (see ``resolve.upsert``): the new version, and (key, outcome) of the batch's keys.

        Columns that the batch doesn't have keep their values, and are null in new rows."""
        version = self.current()
        outcome = merged(self.lookup(batch, version), batch, self.key, columns, locked)
        number = self.stage(outcome)
        self.commit(number)
        return number, _table(self.spark, f"{self.path}/changes-{number}", StructType([*self.schema.fields]).add("gone", "boolean"), self.key, self.buckets).select(*self.key).join(
            self.lookup(batch, version).select(*self.key, F.lit("updated").alias("was")), self.key, "left"
        ).select(*self.key, F.coalesce("was", F.lit("created")).alias("outcome"))

    def delete(self, keys: DataFrame) -> int:
        return self.commit(self.stage(self.base().limit(0), keys.select(*self.key).distinct()))

    def compact(self) -> int:
        """A version of the same rows with a base of its own."""
        number = self.current() + 1
        _write(self.read(), f"{self.path}/base-{number}", self.key, self.buckets)
        return self._switch(number, number, [])


def create(rows: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> VersionedTable:
    """A new table of rows, whose keys must differ, as version 0. Its key, buckets and columns are kept beside it."""
    spark = rows.sparkSession
    table = VersionedTable(spark, path, list(key), buckets, rows.schema)
    _write(rows, f"{path}/base-0", table.key, buckets)
    spark.createDataFrame([(table.key, buckets, rows.schema.json())], "key array<string>, buckets int, columns string").coalesce(1).write.parquet(f"{path}/about")
    table._switch(0, 0, [])
    return table


def opened(spark: SparkSession, path: str) -> VersionedTable:
    about = spark.read.parquet(f"{path}/about").first()
    return VersionedTable(spark, path, list(about["key"]), about["buckets"], StructType.fromJson(json.loads(about["columns"])))
