"""WARC archives: writing pages with segmented, chunked records, and reading them back.

Writing: a page becomes a response record whose block is an HTTP response with chunked transfer framing. A block over
``segment_bytes`` is cut into a first segment and continuation records. Of pages with equal payloads of at least
``min_revisit_bytes`` the one with the smallest id is the response and the others are revisit records without a payload.
Spark's text writer puts the records down with CRLF CRLF after each, which is what the format asks for, so any file
system that Spark reaches will do.

Reading: the lines of a file pass through a parser in order, with no more in memory than a record. Continuation records
are grouped by origin identifier and put in order by segment number; the segments must be 1 to n without a gap and add
up to the stated total length, and then the chunked framing is decoded. A record that fails is returned with
``problem`` saying why, never dropped.

Inputs: a null html is an empty payload, a null url gives a record without target. A null page id stays null, is never
the response while its payload has a page with an id, and is not referred to. Repeated rows of one id and payload are
alike: all responses if that id is the smallest. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import cut, lookup, new_path, table

DATE = "2024-01-31T00:00:00Z"
SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
EOL = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits give four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%X\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is wrong. Chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(EOL, at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = end + 2
        if body[at + n : at + n + 2] != EOL:
            raise ValueError("chunk without its end")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {re.sub('[\r\n]+', ' ', v)}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block


def page_records(serial: str, page_id: str | None, url: str | None, digest: str, payload: bytes, revisit: bool, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    base = {"WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    origin = f"<urn:page:{serial}>"
    if revisit:
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": origin, "WARC-Profile": PROFILE} | base, HTTP_HEAD + EOL)
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record({"WARC-Type": "response", "WARC-Record-ID": origin} | base, block)
        return
    cuts = range(0, len(block), segment_bytes)
    for n, at in enumerate(cuts, 1):
        total = str(len(block)) if n == len(cuts) else None
        segment = {"WARC-Segment-Number": str(n), "WARC-Segment-Total-Length": total}
        if n == 1:
            kind = {"WARC-Type": "response", "WARC-Record-ID": origin} | base
        else:
            kind = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:page:{serial}:{n}>", "WARC-Segment-Origin-ID": origin, "WARC-Date": DATE, "WARC-Target-URI": url}
        yield record(kind | segment, block[at : at + segment_bytes])


def revisits(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, digest) of the pages to write as revisits."""
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    meta = cut(pages.select("page_id", base32_sha1(payload).alias("digest")).filter(F.length(payload) >= min_revisit_bytes), "digests")
    firsts = cut(meta.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "repeated-digests")
    return cut(lookup(meta, firsts, "digest", "n").filter("least is not null and (page_id is null or page_id > least)").select("page_id", "digest").distinct(), "revisits")


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = 0) -> None:
    """Write an archive of pages (page_id, url, html) to the folder at path, a gzip file for each partition."""
    later = revisits(pages, min_revisit_bytes).select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), F.lit(True).alias("revisit"))
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("digest"))
    rows = rows.join(later, rows["page_id"].eqNullSafe(later["later_id"]) & (rows["digest"] == later["later_digest"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page_id, url, digest, body, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                made = list(page_records(f"{part}-{n}", page_id, url, digest, body, bool(revisit), segment_bytes, chunk_bytes))
                out += made
                size += sum(map(len, made))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = rows.select(F.col("page_id").cast("string"), "url", "digest", "payload", "revisit").mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


RECORD = "kind string, origin string, segment int, total long, page_id string, uri string, stated_digest string, block binary"
NAMES = ["kind", "origin", "segment", "total", "page_id", "uri", "stated_digest", "block"]


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The records in the bytes of one file, as tuples of RECORD."""
    have = b""
    for piece in pieces:
        have += piece
        at = 0
        while True:
            end = have.find(b"\r\n\r\n", at)
            if end < 0:
                break
            first, *lines = have[at:end].decode("utf-8", "surrogateescape").split("\r\n")
            if not first.startswith("WARC/1."):
                raise ValueError(f"not the begin of a WARC record: {first[:40]!r}")
            f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            to = end + 4 + int(f["content-length"])
            if len(have) < to + 4:
                break
            number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
            yield (
                f["warc-type"],
                f.get("warc-segment-origin-id") or f.get("warc-record-id"),
                int(number) if number else None,
                int(total) if total else None,
                f.get("warc-page-id"),
                f.get("warc-target-uri"),
                (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                have[end + 4 : to],
            )
            at = to + 4
        have = have[at:]
    if have.strip():
        raise ValueError(f"the file ends within a record: {have[:40]!r}")


def read_records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """The records of the archives at path that are, or aren't, segments."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                files = batch.column("file").to_numpy()
                at = 0
                while at < len(files):  # a batch may hold the end of a file and the begin of the next
                    same = files[at:] == files[at]
                    n = len(same) if same.all() else int(same.argmin())
                    yield int(files[at]), b"\n".join(batch.column("line").slice(at, n).to_pylist()) + b"\n"
                    at += n

        rest = pieces()
        held = next(rest, None)
        while held:
            name = held[0]

            def one() -> Iterator[bytes]:
                nonlocal held
                while held and held[0] == name:
                    yield held[1]
                    held = next(rest, None)

            rows, size = [], 0
            for r in parsed(one()):
                if (r[2] is not None) == segmented:
                    rows.append(r)
                    size += len(r[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    return lines.mapInArrow(run, RECORD)


TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]


def reassembled(segments: DataFrame) -> DataFrame:
    """One row for each origin identifier: the blocks in order of their numbers, or the problem with them."""
    grouped = segments.groupBy("origin").agg(
        *(F.max(c).alias(c) for c in ("total", "page_id", "uri", "stated_digest")),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.length(p["block"]))
    problem = (
        F.when(numbers != F.sequence(F.lit(1), F.size("parts")), F.lit("segments missing or repeated"))
        .when(F.col("total").isNull(), F.lit("no total length"))
        .when(F.col("total") != length, F.lit("segments don't add up to the total length"))
    )
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    return grouped.select(F.lit("response").alias("kind"), "page_id", "uri", "stated_digest", block.alias("block"), problem.alias("problem"))


def decoded(blocks: DataFrame) -> DataFrame:
    """Blocks with their payloads in place of the framing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, problems = [], []
            for kind, block, problem in zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist(), batch.column("problem").to_pylist(), strict=True):
                payload = None
                if problem is None and kind == "response":
                    try:
                        payload = payload_of(block)
                    except ValueError as e:
                        problem = str(e)
                payloads.append(payload)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("kind", "page_id", "uri", "stated_digest")), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())],
                names=["kind", "page_id", "uri", "stated_digest", "payload", "problem"],
            )

    return blocks.mapInArrow(run, "kind string, page_id string, uri string, stated_digest string, payload binary, problem string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(kind, page_id, uri, stated_digest, payload, problem) of the responses and revisits in the archives at path."""
    whole = read_records(spark, path, segmented=False).select("kind", "page_id", "uri", "stated_digest", "block", F.lit(None).cast("string").alias("problem"))
    return decoded(whole.unionByName(reassembled(read_records(spark, path, segmented=True))))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = new_path(spark, "archive")
    write_warc(pages, path)
    payload = F.col("payload")
    digest = F.when(F.col("kind") == "response", base32_sha1(payload)).otherwise(F.col("stated_digest"))
    back = cut(read_warc(spark, path).select("kind", F.col("page_id").cast("long").alias("page_id"), F.length(payload).cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "problem"), "read-back")
    responses = back.filter("kind = 'response'")
    later = back.filter("kind = 'revisit'").drop("payload_bytes")
    sizes = later.groupBy("payload_digest").agg(F.count("*").alias("n"))
    targets = responses.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"))
    resolved = lookup(later, cut(targets.join(sizes, "payload_digest"), "targets"), "payload_digest", "n", "left")
    both = responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(resolved)
    return both.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "problem")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT page_id, payload_bytes,
         list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST(concat('0x', substr(h, 5 * (i // 4) + 1, 5)) AS INTEGER) >> (15 - 5 * (i % 4))) % 32 AS INTEGER), 1)),
           lambda a, b: concat(a, b)) AS payload_digest
  FROM p
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM q
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN least IS NULL OR page_id <= least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN least IS NULL OR page_id <= least THEN NULL ELSE least END AS refers_to,
       CAST(NULL AS VARCHAR) AS problem
FROM m
"""
