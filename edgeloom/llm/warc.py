"""WARC archives with an index beside them.

Pages with equal payloads keep one full ``response`` record, that of the largest ``page_id`` (and of those the
largest url); the others become ``revisit`` records that name it. That is decided before anything is written.
Each task writes one ``.warc.gz`` file, a gzip member per record, and its index rows: file, offset, length,
url and digest. Reading selects index rows first, sorts them by file and offset, joins neighbouring
byte ranges, and reads each joined range at once.

Defined results: a null html is an empty payload; a null ``page_id`` counts as the smallest and is written
without a number; of rows that repeat a page id and payload one is the response, the others revisit it, however
the rows are partitioned; payloads under ``least_bytes`` are never revisits; an empty table gives no file; a url's control
characters are percent-encoded in the record and unchanged in the index; other columns, of any name, are ignored;
a page of any size is one record and one task's memory holds a batch of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import storage

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges closer than this are read as one, up to the second size.
GAP, READ = 65_536, 8_000_000
#: Bytes of a file that one reading task takes, about, and how many tasks there are at most before that grows.
SPAN, READERS = 4_000_000, 50_000
#: Repeated rows that one row stands for until they are dealt out.
CHUNK = 10_000

INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64())])
RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def record_id(page_id: int | None, digest: bytes) -> str:
    """A record's UUID: eight bytes of the digest, then the page's id."""
    number = "none" if page_id is None else f"{page_id & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{digest[:8].hex()}-{number}>"


def page_of(record: str) -> int | None:
    number = record.rstrip(">").rpartition("-")[2]
    return None if number == "none" else int.from_bytes(bytes.fromhex(number), "big", signed=True)


def encode_record(page_id, url, payload: bytes | None, size: int, digest: bytes, refers_to: int | None) -> bytes:
    """One gzip member: the record with its HTTP head, and the payload; without one it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = payload is None
    block = http if revisit else http + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        *([f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def decode_record(member: bytes) -> dict:
    """What a record says; the digest of a payload that is there is checked."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "record_type": kind, "payload_bytes": size, "payload_digest": digest,
        "refers_to": page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "url": fields.get("WARC-Target-URI", ""), "payload": payload if kind == "response" else None,
    }


def _decided(pages: DataFrame, least_bytes: int) -> DataFrame:
    """A row a record: ``page_id, url, html, sha1, size, keeper, revisit``; ``html`` is null in revisits.

    Who is the response of a payload is settled on narrow rows and then looked up, so no join or partitioning
    decides it: the largest (page_id, url) among the rows of that payload. Rows that are equal in all of these are
    one row with a count; all but one of them become rows of their own again without their html, dealt out anew.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("size"))
    # nulls in keys, so that joins on them are plain equalities
    keys = {"k": F.coalesce("page_id", F.lit(0)), "k_none": F.col("page_id").isNull(), "u": F.coalesce("url", F.lit("")), "u_none": F.col("url").isNull()}
    by = [*keys, "sha1", "size"]
    rows = rows.select(*(c.alias(n) for n, c in keys.items()), "html", "sha1", "size")
    counted = rows.drop("html").groupBy(*by).agg(F.count("*").alias("n"))
    order = F.struct((~F.col("k_none")).alias("named"), "k", (~F.col("u_none")).alias("linked"), "u")
    groups = counted.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.sum("n").alias("all"), F.max(order).alias("top")).where("all > 1").select("sha1", "top")
    met = counted.join(groups, "sha1").withColumn("first", order == F.col("top"))
    keeper = F.when(F.col("top.named"), F.col("top.k"))
    met = met.select(*by, "n", "first", keeper.alias("keeper"))
    once = rows.groupBy(*by).agg(F.first("html").alias("html"))
    found = once.join(met.drop("n"), by, "left").withColumn("revisit", F.coalesce(~F.col("first"), F.lit(False)))
    found = found.withColumns({"html": F.when(~F.col("revisit"), F.col("html")), "keeper": F.when(F.col("revisit"), F.col("keeper"))})
    # the other rows of a repeated one
    more = met.where("n > 1").select(*by, "keeper", F.explode(F.sequence(F.lit(2), F.col("n"), F.lit(CHUNK))).alias("at"), "n")
    more = more.repartition("sha1", "k", "at").select(*by, "keeper", F.explode(F.sequence("at", F.least(F.col("at") + CHUNK - 1, F.col("n")))))
    more = more.select(*by, F.lit(None).cast("string").alias("html"), "keeper", F.lit(True).alias("revisit"))
    found = found.select(*by, "html", "keeper", "revisit").unionByName(more)
    if least_bytes:  # small payloads that repeat are all responses
        small = rows.where(F.col("size") < least_bytes)
        found = found.where(F.col("size") >= least_bytes).unionByName(small.select(*by, "html", F.lit(None).cast("long").alias("keeper"), F.lit(False).alias("revisit")))
    page_id, url = F.when(~F.col("k_none"), F.col("k")), F.when(~F.col("u_none"), F.col("u"))
    return found.select(page_id.alias("page_id"), url.alias("url"), "html", "sha1", "size", "keeper", "revisit")


def write_warcs(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` and return the index, kept as a table."""
    rows = _decided(pages, least_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        name, index = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", []

        def fill(stream):
            at, batch = 0, first
            while batch is not None:
                for page_id, url, page, sha1, size, keeper, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    digest = bytes.fromhex(sha1)
                    member = encode_record(page_id, url, None if revisit else page.encode(), size, digest, keeper)
                    stream.write(member)
                    index.append((name, at, len(member), url, base64.b32encode(digest).decode(), page_id))
                    at += len(member)
                batch = next(batches, None)

        storage.publish(folder, name, task.taskAttemptId(), fill)
        for start in range(0, len(index), 10_000):
            columns = zip(*index[start : start + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX, strict=True)], schema=INDEX)

    index = rows.mapInArrow(write, "file string, offset long, length long, url string, digest string, page_id long")
    return storage.cut(index, "warc-index")


def ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Join sorted (offset, length) places: yields (first place, places, bytes) of each read."""
    start, n = 0, 0
    while start < len(places):
        begin, end, n = places[start][0], sum(places[start]), 1
        while start + n < len(places):
            at, length = places[start + n]
            if at - end > GAP or at + length - begin > READ:
                break
            end, n = max(end, at + length), n + 1
        yield start, n, end - begin
        start += n


def read_warcs(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` place, as RECORD."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.countDistinct("file").alias("files")).first()
    span = max(SPAN, -(-size.bytes // READERS))
    part = F.floor(F.col("offset") / span)
    spread = index.select("file", "offset", "length").repartition(size.bytes // span + size.files + 1, F.col("file"), part).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(files):
                end = at
                while end < len(files) and files[end] == files[at]:
                    end += 1
                system, path = storage.open_folder(folder)
                places = list(zip(offsets[at:end], lengths[at:end], strict=True))
                with system.open_input_file(f"{path}/{files[at]}") as source:
                    for start, n, size in ranges(places):
                        begin = places[start][0]
                        raw = source.read_at(size, begin)
                        found = [decode_record(raw[o - begin : o - begin + m]) for o, m in places[start : start + n]]
                        if not payloads:
                            found = [x | {"payload": None} for x in found]
                        yield pa.RecordBatch.from_pylist(found, schema=RECORD)
                at = end

    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"
    return spread.mapInArrow(read, schema)


def archive_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages, read all back, and tell each record's kind and payload."""
    folder = storage.new_folder(pages.sparkSession, "warc")
    records = read_warcs(write_warcs(pages, folder, least_bytes), folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
