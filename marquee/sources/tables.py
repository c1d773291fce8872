"""The catalog's tables on disk: a folder for each version, items split by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM, TYPES


def write_catalog(rows: DataFrame, path: str, version: int) -> str:
    """Write a new version of a table keyed by item; readers of older versions aren't disturbed."""
    at = f"{path}/version={version}"
    rows.write.partitionBy("item_type").parquet(at)
    return at


def current_version(spark: SparkSession, path: str) -> int:
    """The latest version that has been written to its end: a version's files appear when its write commits."""
    return spark.read.parquet(path).agg(F.max("version")).first()[0]


def read_catalog(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table, or the current one. A filter on item_type reads that type's folder only."""
    return spark.read.parquet(f"{path}/version={current_version(spark, path) if version is None else version}")


#: The four kinds of release dates that become one.
RELEASE_DATES = {"MOVIE": "release_date", "SERIES": "first_air_date", "BOOK": "first_publish_date", "GAME": "release_date"}


def union_types(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of items from a table for each type (id, title, slug, its own date)."""
    parts = [tables[t].select(F.lit(t).alias(ITEM[0]), F.col("id").alias(ITEM[1]), "title", "slug", F.col(RELEASE_DATES[t]).alias("release_date")) for t in TYPES if t in tables]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
