"""Legacy web-archive conversion: ARC files to WARC files, and reading both.

* ``read_arc`` parses ARC files of version 1 (five header fields) and
  version 2 (ten fields).  The version block of each file says which; every
  record is cut by its declared length, never by searching for the next one.
* ``convert`` synthesises what WARC needs and ARC lacks: record identifiers
  (a UUID of the archive's name and the record's offset, so a repeated run
  gives the same ones), ISO timestamps, record types, content types, block and
  payload digests.  Equal payloads of at least ``min_bytes`` are stored
  once: the record of smallest rank is the response, the others revisit it.
* ``read_warc`` parses WARC files by their declared lengths.

Files are written by Spark's text writer with the record terminator as line
separator, so every Spark file system works, and a lost task's files are never
seen.  An archive is one task's stream and is inflated as it is read;
``convert`` aims at ``FILE_BYTES`` of payload per file.

A null payload is an empty one.  Null ids and urls are written as absent and
read back as null.  A header line that can't be parsed gives a row that has
only ``problem`` set, and parsing goes on at the next line; a record that ends
early keeps what there is and has ``problem`` set.  Records are never dropped:
repeated rows are written each.  No input gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20

# Fixed values of the formats.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_END, WARC_END = "\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ID_HEADER = "X-Record-Key"
ARC_DATE = re.compile(rb"\d{8,14}$")


def files_for(total_bytes: int) -> int:
    return max(1, -(-int(total_bytes) // FILE_BYTES))


def _as_text(df: DataFrame, run, end: str, folder: str) -> str:
    """Write the binary column ``record`` that ``run`` yields; a file per partition."""
    (df.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder))
    return folder


def write_arc(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str) -> str:
    """Write rows as gzipped ARC files, one a partition, version 1 and 2 in turn; returns ``folder``."""
    rows = pages.select(F.col(id_col).cast("string").alias("k"), F.col(url_col).alias("u"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("p"))
    rows = rows.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = None
        for batch in batches:
            out = []
            for k, u, p, part in zip(*(c.to_pylist() for c in batch.columns)):
                if version is None:
                    version = "12"[part % 2]
                    block = f"{version} 0 example\n{ARC_FIELDS[version]}\n".encode()
                    out.append(_arc_record(version, f"filedesc://part-{part}.arc", "0.0.0.0", "text/plain", block))
                payload = p.encode()
                http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        + (f"{ID_HEADER}: {k}\r\n" if k is not None else "")
                        + f"Content-Length: {len(payload)}\r\n\r\n").encode()
                out.append(_arc_record(version, u if u else "-", "192.0.2.1", "text/html", http + payload))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return _as_text(rows, run, ARC_END, folder)


def _arc_record(version: str, url: str, ip: str, mime: str, block: bytes) -> bytes:
    url = re.sub(r"\s", "%20", url)
    more = {"1": "", "2": "200 - - 0 part.arc "}[version]
    return f"{url} {ip} 20080430204825 {mime} {more}{len(block)}\n".encode() + block


def opened(content: bytes) -> BinaryIO:
    """A stream of an archive's bytes, inflated as it is read if it is gzipped."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def parse_arc(stream: BinaryIO) -> Iterator[dict]:
    """Records of one ARC file: offset, url, ip, date, mime, block, problem."""
    at, fields = 0, 5
    while line := stream.readline():
        start, at = at, at + len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        first = line.startswith(b"filedesc://")
        part = line.rsplit(b" ", (5 if first else fields) - 1)
        if first and len(part) == 5 and not ARC_DATE.match(part[2]):
            part = line.rsplit(b" ", 9)    # a version block whose own line has ten fields
        if len(part) not in (5, 10) or not part[-1].isdigit() or not ARC_DATE.match(part[2]):
            yield {"offset": start, "problem": f"not a header line: {line[:80]!r}"}
            continue
        size = int(part[-1])
        block = stream.read(size)
        at += len(block)
        if first:
            fields = {b"1": 5, b"2": 10}.get(block[:1], 5)
        else:
            yield {"offset": start, "url": _text(part[0]), "ip": _text(part[1]), "date": _text(part[2]),
                   "mime": _text(part[3]), "block": block,
                   "problem": None if len(block) == size else f"{size} bytes declared, {len(block)} there"}


def _text(raw: bytes) -> str | None:
    return None if raw == b"-" else raw.decode("utf-8", "replace")


def http_payload(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload); no head if it isn't an HTTP message."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[:end + 4], block[end + 4:]
    return b"", block


def _key(head: bytes) -> str | None:
    m = re.search(rb"\r\n" + ID_HEADER.encode() + rb": ([^\r\n]*)", head)
    return m[1].decode() if m else None


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += 200 + len(row.get("block") or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .filter(~F.col("path").rlike(r"/[._][^/]*$")).select("path", "content"))


ARC_SCHEMA = ("record_id string, key string, url string, ip string, date string, mime string, "
              "payload_bytes bigint, payload_digest string, block binary, problem string")


def read_arc(spark: SparkSession, folder: str, with_blocks: bool = True) -> DataFrame:
    """Records of all ARC files in ``folder``; ``block`` is null without ``with_blocks``."""
    schema = pa.schema([("record_id", pa.string()), ("key", pa.string()), ("url", pa.string()),
                        ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("block", pa.binary()), ("problem", pa.string())])

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = path.rsplit("/", 1)[-1]
                for r in parse_arc(opened(content.as_py())):
                    if "block" in r:
                        head, payload = http_payload(r["block"])
                        r |= {"key": _key(head), "payload_bytes": len(payload),
                              "payload_digest": hashlib.sha256(payload).hexdigest()}
                        if not with_blocks:
                            r["block"] = None
                    r["record_id"] = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{r.pop('offset')}')}"
                    yield r

    return _files(spark, folder).mapInArrow(lambda batches: _batches(rows(batches), schema), ARC_SCHEMA)


def revisits(records: DataFrame, rank: Column, min_bytes: int = 100) -> DataFrame:
    """(record_id, refers_to) of the records whose payload an earlier one has.

    Of equal payloads of at least ``min_bytes`` the record of smallest
    ``rank`` (nulls last, then the smallest record id) is kept.  Digests are
    pre-aggregated before they are shuffled, and only digests that several
    records have are joined back.
    """
    large = records.filter((F.col("payload_bytes") >= min_bytes) & F.col("problem").isNull()).select(
        "payload_digest", "record_id", F.struct(rank.isNull(), rank, F.col("record_id")).alias("place"))
    first = (large.groupBy("payload_digest").agg(F.min("place").alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("payload_digest", F.col("first.record_id").alias("refers_to")))
    return (large.join(first, "payload_digest").filter("record_id <> refers_to")
            .select("record_id", "refers_to"))


def convert(records: DataFrame, refers: DataFrame, total_bytes: int, folder: str) -> str:
    """Write ARC ``records`` (with blocks) as gzipped WARC files; returns ``folder``.

    ``refers`` names the records that become revisits.  A row with ``problem``
    and no block becomes a metadata record that says so.
    """
    n = files_for(total_bytes)
    rows = (records.repartition(n, "record_id").join(refers, "record_id", "left")
            .select("record_id", "url", "ip", "date", "mime", "payload_digest", "block", "problem", "refers_to")
            .withColumn("part", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for batch in batches:
            out, size = [], 0
            for r in map(_row, _rows(batch)):
                if not opened:
                    opened = True
                    info = b"format: WARC File Format 1.1\r\n"
                    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo {r['record_id']}')}"
                    out.append(_warc("warcinfo", name, "20080430204825", info,
                                     [("Content-Type", "application/warc-fields")]))
                out.append(_converted(r))
                size += len(out[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return _as_text(rows, run, WARC_END, folder)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i) for i in range(batch.num_columns)))


def _row(values: tuple) -> dict:
    names = ("record_id", "url", "ip", "date", "mime", "payload_digest", "block", "problem", "refers_to", "part")
    return {n: v.as_py() for n, v in zip(names, values)}


def _converted(r: dict) -> bytes:
    if r["block"] is None:
        return _warc("metadata", r["record_id"], None, (r["problem"] or "").encode(), [("Content-Type", "text/plain")])
    head, _ = http_payload(r["block"])
    http = bool(head)
    more = [("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
            ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"),
            ("Content-Type", "application/http; msgtype=response" if http else r["mime"])]
    if r["refers_to"]:
        return _warc("revisit", r["record_id"], r["date"], head,
                     [*more, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{r['refers_to']}>")])
    return _warc("response" if http else "resource", r["record_id"], r["date"], r["block"],
                 [*more, ("WARC-Truncated", "unspecified" if r["problem"] else None)])


def _warc(kind: str, record_id: str, date: str | None, block: bytes, more: list[tuple[str, str | None]]) -> bytes:
    d = (date or "").ljust(8, "0")[:14]
    d = (d + "000000")[:14] if date else "19700101000000"
    iso = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", iso), *more,
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def parse_warc(stream: BinaryIO) -> Iterator[dict]:
    """Records of one WARC file: offset, headers (lower-case names), block, problem.

    What stands where a record should begin is skipped, and reported, up to the next
    line that begins one.
    """
    at, lost = 0, None
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        headers: dict[str, str] = {}
        if line.startswith(b"WARC/"):
            while (more := stream.readline()).strip():
                at += len(more)
                k, _, v = more.partition(b":")
                headers[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
            at += len(more)
        if not headers.get("content-length", "").isdigit():
            if lost is None:
                yield {"offset": start, "headers": {}, "block": None, "problem": f"not a record: {line[:80]!r}"}
            lost = start
            continue
        lost = None
        size = int(headers["content-length"])
        block = stream.read(size)
        at += len(block)
        yield {"offset": start, "headers": headers, "block": block,
               "problem": None if len(block) == size else f"{size} bytes declared, {len(block)} there"}


def read_warc(spark: SparkSession, folder: str, with_blocks: bool = False) -> DataFrame:
    """Records of all WARC files in ``folder``.

    ``payload_bytes`` and ``payload_digest`` are computed from the payload
    that is there; ``declared_digest`` is the header's, ``digest_ok`` says whether
    the block has the digest that its header gives.
    """
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()),
                        ("url", pa.string()), ("key", pa.string()), ("refers_to", pa.string()),
                        ("declared_digest", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("digest_ok", pa.bool_()),
                        ("block", pa.binary()), ("problem", pa.string())])

    def rows(batches):
        for batch in batches:
            for content in batch.column(1):
                for r in parse_warc(opened(content.as_py())):
                    h = r["headers"]
                    head, payload = http_payload(r["block"] or b"")
                    digest = f"sha256:{hashlib.sha256(r['block'] or b'').hexdigest()}"
                    yield {"record_id": h.get("warc-record-id", "").strip("<>") or None, "type": h.get("warc-type"),
                           "date": h.get("warc-date"), "url": h.get("warc-target-uri"), "key": _key(head),
                           "refers_to": h.get("warc-refers-to", "").strip("<>") or None,
                           "declared_digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                           "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(),
                           "digest_ok": h.get("warc-block-digest") in (None, digest),
                           "block": r["block"] if with_blocks else None, "problem": r["problem"]}

    names = ("record_id string, type string, date string, url string, key string, refers_to string, "
             "declared_digest string, payload_bytes bigint, payload_digest string, digest_ok boolean, "
             "block binary, problem string")
    return _files(spark, folder).mapInArrow(lambda batches: _batches(rows(batches), schema), names)
