"""Pages of an order in very many ranges: few rows reach the driver."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import pages


@pytest.mark.parametrize("chunk", [3, 1024])
def test_pages_over_chunks(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(pages, "CHUNK", chunk)
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 1000).alias("k"))
    kept = pages.keep(rows, [F.asc("k")], str(tmp_path / "p"), range_rows=50)
    assert kept.total() == 1000 and sum(kept.counts) == 1000
    for number, limit in [(1, 30), (4, 170), (6, 170), (7, 170), (1, 2000)]:
        want = list(range((number - 1) * limit, min(number * limit, 1000)))
        assert [r["k"] for r in kept.page(number, limit).collect()] == want
    mark = tuple(kept.page(3, 100).agg(F.max("mark")).first()[0])
    assert [r["k"] for r in kept.after(mark, 400).collect()] == list(range(300, 700))
    ranges = len(kept.counts)
    assert len(kept._chunks()) <= -(-ranges // chunk)
    # the counts that go to the driver don't carry the table's columns
    assert kept._kept().columns == ["range", "n", "chunk"]
