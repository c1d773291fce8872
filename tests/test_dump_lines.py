"""Dumps of several gzip members, read in parts."""

import gzip

import numpy as np
import pytest

from marquee.sources import dump_lines, landed


def written(path, lines, members, end=True):
    """Gzip members that are cut anywhere, also within lines."""
    data = b"\n".join(lines) + (b"\n" if end else b"")
    rng = np.random.default_rng(len(lines) + members)
    cuts = [0, *sorted(rng.integers(0, len(data), members - 1).tolist()), len(data)]
    path.write_bytes(b"".join(gzip.compress(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)))


def dump(n):
    rng = np.random.default_rng(n)
    kinds = [b"/type/edition", b"/type/work", b"/type/author"]
    out = []
    for i in range(n):
        body = b'{"works": [{"key": "/works/OL%dW"}], "title": "%s"}' % (i % 50, bytes(rng.integers(97, 123, int(rng.integers(0, 200)), dtype=np.uint8)))
        out.append(b"\t".join([kinds[i % 3], b"/books/OL%dM" % i, b"1", b"2024", body]))
    return out[:7] + [b"too short", b""] + out[7:]


@pytest.mark.parametrize(("members", "end"), [(1, True), (9, True), (40, False)])
def test_every_line_comes_once_and_in_order(spark, tmp_path, members, end):
    lines = dump(400)
    (tmp_path / "d").mkdir()
    written(tmp_path / "d" / "a.txt.gz", lines, members, end)
    (tmp_path / "d" / "b.txt").write_bytes(b"\n".join(dump(50)))
    want = [tuple(x.decode().split("\t")) for x in [*lines, *dump(50)] if x.count(b"\t") == 4]
    for split in (700, 5000, 1 << 20):
        got = dump_lines.read_lines(spark, str(tmp_path / "d"), split=split)
        assert [tuple(r)[:5] for r in sorted(got.collect(), key=lambda r: r["pos"])] == want
    if members > 1:
        assert len({r["pos"] >> 34 for r in dump_lines.read_lines(spark, str(tmp_path / "d" / "a.txt.gz"), split=700).collect()}) > 3


def test_filters_and_wanted_works_stay_in_the_reader(spark, tmp_path):
    lines = dump(300)
    written(tmp_path / "a.txt.gz", lines, 12)
    wanted = spark.createDataFrame([("OL7W",), ("OL20W",), ("odd",), (None,)], "work_id string")
    works = dump_lines.write_wanted(wanted, str(tmp_path / "wanted"))
    read = dump_lines.read_lines(spark, str(tmp_path / "a.txt.gz"), works, split=2000).filter("kind = '/type/edition'")
    want = [x for x in lines if x.startswith(b"/type/edition") and (b"OL7W" in x or b"OL20W" in x)]
    got = read.collect()
    assert sorted(r["key"] for r in got) == sorted(x.split(b"\t")[1].decode() for x in want) and 0 < len(want) < 10
    # no filter is left for Spark, and so few bodies reach the parser of JSON
    assert "Filter (kind" not in read._jdf.queryExecution().executedPlan().toString()
    editions = landed.parse_edition_records(read, wanted.filter("work_id is not null"))
    assert {r["work_id"] for r in editions.select("work_id").collect()} <= {"OL7W", "OL20W"} and editions.count() == len(want)


def test_what_looks_like_a_member_is_none(spark, tmp_path):
    """Compressed bytes that hold the signature of a member within a stored block."""
    fake = gzip.compress(b"/type/edition\tfake\t1\t2\t{}\n")
    data = b"/type/edition\tk\t1\t2\t{}\n" * 50
    stored = gzip.compress(b"/type/edition\tx\t1\t2\t" + fake[:10] * 200 + b"\n", compresslevel=0)
    (tmp_path / "a.gz").write_bytes(gzip.compress(data) + stored + gzip.compress(data))
    got = dump_lines.read_lines(spark, str(tmp_path / "a.gz"), split=300).collect()
    assert sum(r["key"] == "k" for r in got) == 100 and not any(r["key"] == "fake" for r in got)
