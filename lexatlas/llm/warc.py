"""WARC archives: a writer with revisit records and a splittable reader of gzipped archives.

Archives are opened by pyarrow file systems, so a path is a URI of a local or shared folder or of an object
store that pyarrow knows (file, s3, gs, hdfs).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexatlas.llm.common import pa_schema, salted_join, short_batches
from lexatlas.session import cut, shared_dir

MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 18
SPLIT_BYTES = 16 << 20
# Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-page:{}>"
REQUIRED = (b"warc-type", b"warc-record-id", b"content-length")


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path inside it. ``file:/x`` and plain paths are local."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: object, url: str | None, payload: bytes, refers_to: object) -> bytes:
    """One gzip member holding one record. A revisit carries the response's header, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    header = {
        "WARC-Type": kind,
        "WARC-Record-ID": RECORD_ID.format(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join(url.split()) if url else "urn:x-none",
        "WARC-Payload-Digest": "sha1:" + payload_digest(payload),
        **({"WARC-Profile": PROFILE, "WARC-Refers-To": RECORD_ID.format(refers_to)} if kind == "revisit" else {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in header.items()).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(lines + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per page into gzipped archives under ``folder``; returns their manifest (path, bytes, records).

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest id is a
    response, the others are revisits that refer to it; smaller payloads are all responses. A null payload
    is empty, a null url is written as ``urn:x-none``, a null id counts as the smallest and is written as
    ``None``. Rows that repeat id and payload are all responses if that id is the largest.

    Every task writes archives of its own under a name used once, and the manifest lists those of the tasks
    that have ended well: what a lost executor leaves behind is not in it and is never read. No pages
    give no archives.
    """
    spark = pages.sparkSession
    short_batches(spark)
    source = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("n"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    key = F.sha2(F.col("payload").cast("binary"), 256)
    long_enough = F.octet_length("payload") >= least_bytes
    narrow = cut(source.filter(long_enough).select(key.alias("sha"), "n"))
    groups = narrow.groupBy("sha").agg(F.max("n").alias("first"), F.count("*").alias("size")).filter("size > 1").drop("size")
    marked = salted_join(source.withColumn("sha", F.when(long_enough, key)), groups, ["sha"], ["n", "url"], "left")
    revisit = F.col("sha").isNotNull() & F.col("first").isNotNull() & ~F.col("n").eqNullSafe(F.col("first"))
    rows = marked.select("id", "url", "payload", F.when(revisit, F.col("first").cast("string")).alias("refers_to"))
    types = pa_schema(spark, "path string, bytes long, records long")
    located(folder)[0].create_dir(located(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, size, records = None, 0, 0
        for batch in batches:
            for id_, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to"))):
                out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                member = record("response" if refers_to is None else "revisit", id_, url, payload.encode(), refers_to)
                out.write(member)
                size, records = size + len(member), records + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([size]), pa.array([records])], schema=types)

    return cut(rows.mapInArrow(write, "path string, bytes long, records long"))


def parse_header(head: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """The named fields of a record's header, lower-cased, and where its block starts; None if this is no record."""
    end = head.find(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in head[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if any(r not in fields for r in REQUIRED) or not fields[b"content-length"].isdigit():
        return None
    return fields, end + 4


class Range:
    """Bytes of a file from ``start`` on, read in blocks as they are asked for."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.base, self.data, self.ended = file, start, b"", False
        file.seek(start)

    def more(self) -> bool:
        block = b"" if self.ended else self.file.read(READ_BYTES)
        self.ended = not block
        self.data += block
        return bool(block)

    def drop(self, n: int) -> None:
        self.data, self.base = self.data[n:], self.base + n


class Header:
    """Finds the end of a record's header in content that comes in parts. Every line is looked at once."""

    def __init__(self):
        self.seen, self.whole, self.lines = b"", False, 0

    def fits(self, part: bytes) -> bool:
        """Whether the content so far, with ``part`` added, begins a record: a version line, then fields up to a blank line."""
        if self.whole:
            return True
        *lines, self.seen = (self.seen + part).split(b"\r\n")
        for line in lines:
            if self.lines and not line:
                self.whole = True
                return True
            if not (b":" in line if self.lines else line.startswith(b"WARC/1.")):
                return False
            self.lines += 1
        return bool(self.lines) or self.seen[:7] == b"WARC/1."[: len(self.seen)]


def read_member(source: Range) -> tuple[bytes, int] | None:
    """Decode the gzip member at the front of ``source``: content and compressed size; None if it is no whole record.

    Decoding goes on while the content looks like a header, of any length, and to the end of the member
    once that is whole, so false magic costs one block at most.
    """
    unpacker, parts, fed, header = zlib.decompressobj(31), [], 0, Header()
    while not unpacker.eof:
        if fed >= len(source.data) and not source.more():
            return None
        try:
            parts.append(unpacker.decompress(source.data[fed : fed + READ_BYTES]))
        except zlib.error:
            return None
        fed = min(len(source.data), fed + READ_BYTES)
        if not header.fits(parts[-1]):
            return None
    return b"".join(parts), fed - len(unpacker.unused_data)


def records_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, header fields, block) of the records whose member starts in [start, end).

    Looks for gzip magic; a candidate counts only if its first bytes decode to a record header with the
    required fields and the block has the stated length. After a record the search goes on at its end.
    Not told apart: an archive that lies uncompressed inside a stored block of another member.
    """
    source = Range(file, start)
    while True:
        at = source.data.find(MAGIC)
        while at < 0:
            source.drop(max(0, len(source.data) - len(MAGIC) + 1))
            if source.base >= end or not source.more():
                return
            at = source.data.find(MAGIC)
        source.drop(at)
        if source.base >= end:
            return
        found = read_member(source)
        if found is None:
            source.drop(1)
            continue
        content, size = found
        parsed = parse_header(content)
        if parsed is None or len(content) < parsed[1] + int(parsed[0][b"content-length"]):
            source.drop(1)
            continue
        fields, block = parsed
        length = int(fields[b"content-length"])
        yield source.base, fields, content[block : block + length]
        source.drop(size)


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """A row per record of the archives in ``files`` (path, bytes): path, offset, record_type, record_id,
    target_uri, refers_to, payload_digest, payload_bytes and, with ``payloads``, payload.

    Every file is cut into ranges of ``split_bytes``; ranges are dealt over the tasks, and the task of a
    range owns the records that start in it, reading past its end to finish the last one. payload_bytes is
    the length stated by the HTTP header inside the block (so a revisit has that of the payload it stands
    for), else that of the block. Missing fields are null. Empty files and files without records give no rows.
    """
    short_batches(spark)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = cut(files.select("path", "bytes", F.explode(starts).alias("start")))
    n = max(1, ranges.count())
    dealt = ranges.repartition(n, "path", "start")
    schema = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long"
    schema += ", payload binary" if payloads else ""
    types = pa_schema(spark, schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, inside = located(path)
                held, weight = [], 0
                with store.open_input_file(inside) as file:
                    for offset, fields, block in records_in(file, start, start + split_bytes):
                        row = _described(path, offset, fields, block)
                        held.append(row if payloads else row[:-1])
                        weight += len(row[-1]) if payloads else 1
                        if len(held) >= 1000 or weight >= READ_BYTES * 16:
                            yield _batch(held, types)
                            held, weight = [], 0
                if held:
                    yield _batch(held, types)

    return dealt.mapInArrow(rows, schema)


def checked(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` of :func:`read_archives` (path and any others), written, if every archive in the manifest ``files`` gave as many as it holds.

    Otherwise an error names archives that did not.
    """
    rows = cut(rows)
    read = rows.groupBy("path").agg(F.count("*").alias("read"))
    counts = files.join(read, "path", "left").select("path", "records", F.coalesce("read", F.lit(0)).alias("read"))
    if off := counts.filter("records <> read").take(5):
        raise ValueError("records missing or read twice: " + ", ".join(f"{r.path} holds {r.records}, read {r.read}" for r in off))
    return rows


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)


def _described(path: str, offset: int, fields: dict[bytes, bytes], block: bytes) -> tuple:
    def text(name: bytes) -> str | None:
        return fields[name].decode("utf-8", "replace") if name in fields else None

    payload, size = block, len(block)
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                size = int(value)
    digest = text(b"warc-payload-digest")
    return (path, offset, text(b"warc-type"), text(b"warc-record-id"), text(b"warc-target-uri"), text(b"warc-refers-to"),
            digest.removeprefix("sha1:") if digest else None, size, payload)


def page_of(record_id: str) -> Column:
    """The page id inside a record id written by :func:`record`; null where there is none."""
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
