"""What a task of a search holds at once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marquee.operators import catalog, similarity


def test_blocks_come_in_small_batches(spark, monkeypatch):
    """A batch of packed blocks is bounded by bytes, not by 10,000 rows."""
    monkeypatch.setattr(similarity, "BATCH_BYTES", 1 << 20)
    similarity.small_batches(spark)
    try:
        rows = spark.range(64).coalesce(1).selectExpr("unhex(repeat('00', 262144)) as block")
        sizes = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()
        assert sum(r["n"] for r in sizes) == 64 and max(r["n"] for r in sizes) <= 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_merged_blocks_are_what_one_block_gives():
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (600, 3)).astype(float)  # many ties
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1)
    kinds, ids = rng.integers(0, 4, 600).astype(np.int8), np.arange(600)
    asked = (kinds[:40], ids[:40], m[:40])
    whole = similarity.compared(asked, (kinds, ids, m), 7, 5, None)
    parts = [similarity.compared(asked, (kinds[i::6], ids[i::6], m[i::6]), 7, 5, None) for i in range(6)]
    got = similarity.merged(parts, 7, 5)
    key = lambda b: sorted(tuple(r.values()) for r in b.to_pylist())
    assert key(got) == key(whole) and got.num_rows < sum(p.num_rows for p in parts)


def test_searches_deal_items_before_they_meet(spark, tmp_path):
    """Many items in one small file: no task gets all matches, and no table of texts is broadcast."""
    at = str(tmp_path / "items")
    spark.range(0, 20_000, 1, 1).selectExpr("'BOOK' as item_type", "id as item_id", "double(id % 10) as rating_external", "'small red' as title", "'box' as overview").write.parquet(at)
    asked = spark.createDataFrame([("small", "small"), ("red box", "red box")], "query_id string, q string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # the file is small
    try:
        found = catalog.search(spark.read.parquet(at), asked).withColumn("task", F.spark_partition_id())
        held = [r["count"] for r in found.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(held) == 40_000 and max(held) < 20_000
