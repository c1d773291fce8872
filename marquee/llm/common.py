"""What the operators share: cutting lineage, joins with hot keys, writing SQL on tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot when it holds more than one in HOT_PARTS of all rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 1000
#: Bytes, as JSON, that are broadcast at most.
HOT_BYTES = 32 << 20
NARROW = {"bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, as in tests on local[n], a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own
    _own = _own or tempfile.mkdtemp(prefix="spark-")
    return _own


_own: str | None = None


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a later stage that loses an executor starts from here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df, which was cut, dealt over as many tasks as there are cores, or more so that none gets over ``rows``: for rows that
    are few and small until they are spread out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def quoted(column: str) -> str:
    """The name as Spark reads it, whatever it holds."""
    return "`" + column.replace("`", "``") + "`"


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The column, null as the empty text."""
    return F.coalesce(df[column], F.lit(""))


def lookup(rows: DataFrame, unique: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join rows with a table of one row per key, where a few keys may hold much of rows.

    weight is a column of ``unique`` that says how many rows have the key. Fewer than HOT_PARTS keys can each hold
    more than one in HOT_PARTS of the total, so the hot keys are few whatever the input's size. Their part of ``unique`` is
    broadcast if it takes HOT_BYTES at most; a larger one is copied to HOT_PARTS salts and joined by key and salt, over which
    the rows of hot keys are dealt. The rest is an ordinary shuffled join without a hot key. Both inputs are read more than
    once: pass tables that were cut. ``how`` is inner or left; weight isn't returned.
    """
    total, most = unique.agg(F.sum(weight), F.max(weight)).first()
    if not total or most * HOT_PARTS <= total:
        return rows.join(unique.drop(weight), key, how)
    is_hot = F.col(weight) * HOT_PARTS > F.lit(total)
    hot = unique.filter(is_hot).drop(weight)
    cold = unique.filter(~is_hot).drop(weight)
    keys = F.broadcast(hot.select(key))  # fewer than HOT_PARTS
    rest = rows.join(keys, key, "left_anti")
    wide = [c for c, kind in hot.dtypes if kind not in NARROW]
    size = hot.agg(F.sum(sum((F.length(F.to_json(F.struct(c))) for c in wide), F.lit(8 * len(hot.columns))))).first()[0] or 0
    if size <= HOT_BYTES:
        return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))
    salts = min(HOT_PARTS, max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.join(keys, key, "left_semi").withColumn("salt number", (F.rand(7) * salts).cast("int"))
    copies = hot.withColumn("salt number", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "salt number"]).drop("salt number").unionByName(rest.join(cold, key, how))
