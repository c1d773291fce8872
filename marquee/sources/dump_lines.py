"""A data source for dumps: gzip files in parts, with the filters that make most lines not worth keeping inside the reader.

    spark.dataSource.register(DumpLines)
    spark.read.format("dump_lines").option("path", ...).load().filter("kind = '/type/edition'")

gives (kind, key, revision, modified, body, pos) of lines of five columns by tabs; shorter lines are dropped. pos orders the lines as they lie in
the files, files by name.

A gzip file of several members, as parallel compressors and concatenation make it, is read by a task for each ``split`` bytes: a task
begins at the first member that starts in its bytes (a start counts once its whole member has been decompressed and its checksum
agrees) and goes on over the members that start there. Lines may run from member to member: every task but the first leaves out
what comes before its first line end, and every task reads on to the first line end after its members. A file of one member stays one
task, and other files are cut the same way, by bytes. Memory is that of a buffer and a line.

Filters of equality on kind and key are taken over by the reader. With the option ``works``, a file from ``write_wanted``, only lines come
whose body names a wanted work, which is tested before any JSON is parsed; what passes may still name none, as ids share bits.

Files are opened through pyarrow, so local paths and the stores that it knows can be read; for others see ``landed.read_dump``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SPLIT = 64 << 20
READ, BATCH_LINES, BATCH_BYTES = 1 << 20, 10_000, 16 << 20
SCHEMA = "kind string, key string, revision string, modified string, body string, pos long"
#: Bits of the map of wanted works, at most (32 MB); ids beyond share bits.
MOST_BITS = 1 << 28
WORK_KEY = re.compile(rb'"/works/OL(\d+)W"')


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    path: str
    file: int
    number: int
    start: int
    end: int


def member_chunks(f, start: int) -> Iterator[tuple[int, bytes]]:
    """(where its member starts, decompressed bytes) from a member's start on; what isn't a member ends the file."""
    f.seek(start)
    d, at, left = zlib.decompressobj(31), start, b""
    while True:
        left = left or f.read(READ)
        if not left:
            return
        try:
            out = d.decompress(left, READ)
        except zlib.error:
            if at == start:
                raise
            return
        if out:
            yield at, out
        if d.eof:
            left = d.unused_data
            d, at = zlib.decompressobj(31), f.tell() - len(left)
        else:
            left = d.unconsumed_tail


def first_member(f, start: int, end: int) -> int | None:
    """The first place from start on, before end, where a member starts."""
    at = start
    while at < end:
        f.seek(at)
        window = f.read(min(READ, end - at + 2))
        found = window.find(b"\x1f\x8b\x08")
        if found < 0 or at + found >= end:
            if at + len(window) >= end or not window:
                return None
            at += max(1, len(window) - 2)
            continue
        at += found
        try:
            for member, _ in member_chunks(f, at):
                if member > at:
                    break
            return at
        except zlib.error:
            at += 1
    return None


def plain_chunks(f, start: int) -> Iterator[tuple[int, bytes]]:
    f.seek(start)
    while out := f.read(READ):
        yield f.tell() - len(out), out


def lines_of(chunks: Iterator[tuple[int, bytes]], end: int, whole: bool, sharp: bool) -> Iterator[bytes]:
    """The lines that begin in chunks before end; the first one is left out unless whole. sharp: chunks may lie across the end."""
    skip, carry = not whole, []
    for at, out in chunks:
        past = at >= end
        if sharp and not past and at + len(out) > end:
            # what lies beyond the end comes by itself
            cut = end - at
            pieces = [(False, out[:cut]), (True, out[cut:])]
        else:
            pieces = [(past, out)]
        for beyond, piece in pieces:
            if skip:
                i = piece.find(b"\n")
                if i < 0:
                    continue
                if beyond:
                    return
                piece, skip = piece[i + 1 :], False
            if beyond:
                i = piece.find(b"\n")
                if i < 0:
                    carry.append(piece)
                    continue
                yield b"".join([*carry, piece[:i]])
                return
            rows = piece.split(b"\n")
            if len(rows) > 1:
                yield b"".join([*carry, rows[0]])
                yield from rows[1:-1]
                carry = []
            carry.append(rows[-1])
    last = b"".join(carry)
    if last and not skip:
        yield last


def is_wanted(bits: np.ndarray, number: int) -> bool:
    size = len(bits) * 8
    if number >= size < MOST_BITS:
        return False
    at = number % size
    return bool(bits[at >> 3] >> (at & 7) & 1)


class DumpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split, self.works = options["path"], int(options.get("split", SPLIT)), options.get("works")
        self.only: dict[str, set[bytes]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            names = getattr(f, "attribute", ())
            if isinstance(f, EqualTo | In) and names in (("kind",), ("key",)):
                values = {str(v).encode() for v in ((f.value,) if isinstance(f, EqualTo) else f.value)}
                known = self.only.get(names[0])
                self.only[names[0]] = values if known is None else known & values
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        files = sorted((x for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path) if info.type == pafs.FileType.Directory else [info]
        return [Part(x.path, n, i, at, min(at + self.split, x.size)) for n, x in enumerate(files) for i, at in enumerate(range(0, x.size, self.split))] or [Part("", 0, 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.path)
        bits = None
        if self.works:
            store, at = opened(self.works)
            with store.open_input_stream(at) as f:
                bits = np.frombuffer(f.read(), dtype=np.uint8)
        kinds, keys = self.only.get("kind"), self.only.get("key")
        with fs.open_input_file(partition.path) as f:
            zipped = partition.path.endswith(".gz")
            start = first_member(f, partition.start, partition.end) if zipped and partition.start else partition.start
            if start is None:
                return
            lines = lines_of(member_chunks(f, start) if zipped else plain_chunks(f, start), partition.end, start == 0, not zipped)
            rows, size, base = [], 0, partition.file << 52 | partition.number << 34
            for n, line in enumerate(lines):
                parts = line.split(b"\t", 4)
                if len(parts) < 5 or (kinds is not None and parts[0] not in kinds) or (keys is not None and parts[1] not in keys):
                    continue
                if bits is not None and not any(is_wanted(bits, int(x)) for x in WORK_KEY.findall(parts[4])):
                    continue
                rows.append((*parts, base + n))
                size += len(line)
                if len(rows) >= BATCH_LINES or size >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    *texts, pos = zip(*rows, strict=True)
    names = ["kind", "key", "revision", "modified", "body"]
    decoded = [pa.array([x.decode("utf-8", "replace") for x in t], pa.string()) for t in texts]
    return pa.RecordBatch.from_arrays([*decoded, pa.array(pos, pa.int64())], names=[*names, "pos"])


class DumpLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dump_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DumpReader:
        return DumpReader(dict(self.options))


def write_wanted(works: DataFrame, path: str) -> str:
    """Write the map of wanted works (work_id) to a file for the option ``works``: a bit for each number."""
    numbers = works.select(F.regexp_extract("work_id", "^OL([0-9]+)W$", 1).try_cast("long").alias("n")).filter("n is not null")
    most = numbers.agg(F.max("n")).first()[0] or 0
    size = min(MOST_BITS, (most // 8 + 1) * 8)
    block = 1 << 20

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        flags = np.zeros(block, dtype=bool)
        flags[group.column("bit").to_numpy() % block] = True
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    at = numbers.select((F.col("n") % size).alias("bit")).distinct().withColumn("at", F.floor(F.col("bit") / block))
    out = np.zeros((-(-size // block)) * block // 8, dtype=np.uint8)
    for b, packed in at.groupBy("at").applyInArrow(pack, "at long, bits binary").collect():  # MOST_BITS at most
        out[b * block // 8 : (b + 1) * block // 8] = np.frombuffer(packed, dtype=np.uint8)
    fs, name = opened(path)
    with fs.open_output_stream(name) as f:
        f.write(out[: size // 8].tobytes())
    return path


def read_lines(spark: SparkSession, path: str, works: str | None = None, split: int = SPLIT) -> DataFrame:
    """The lines of a dump; filter on kind or key right away, and the reader does it."""
    spark.dataSource.register(DumpLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("dump_lines").option("path", path).option("split", split)
    return (reader.option("works", works) if works else reader).load()
