"""Where tables that outlive a query's stages are kept: the folder in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing uses, in the folder that the driver and all executors share; a temporary one on local[n] without a setting."""
    global _own
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = _own = _own or tempfile.mkdtemp(prefix="spark-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder and read back: they are used more than once."""
    at = new_folder(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def latest_fold(spark: SparkSession, path: str) -> int | None:
    """The highest n of the folders fold=n under path; None where there is none."""
    try:
        found = spark.read.option("basePath", path).schema("fold long").parquet(path)
    except AnalysisException:
        return None
    return found.agg(F.max("fold")).first()[0]
