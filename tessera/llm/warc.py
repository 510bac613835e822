"""WARC archives with an embedded Zstandard dictionary.

An archive is one leading skippable frame (magic 0x184D2A5D) that holds the
dictionary, then one Zstandard frame per record, each compressed alone with
that dictionary, so that any record can be read by its offset. Among records
with equal payloads the one with the smallest id is a `response`; the others
are `revisit` records that name it and carry no payload.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import fresh_path, lean_batches, qualified

#: Fixed values of the WARC/1.1 and WARC-Zstandard formats.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The records' date where none is given.
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def classify(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """pages with payload, digest and refers_to (null for responses)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    digests = pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    shared = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("shared"), "first")
    revisits = digests.join(shared, F.col("digest") == F.col("shared")).where("id is not null and id <> first").select(F.col("id").alias("again"), F.col("digest").alias("same"), "first").distinct()
    full = pages.withColumns({"payload": payload, "digest": F.sha2(payload, 256)})
    return full.join(revisits, (F.col(id_col) == F.col("again")) & (F.col("digest") == F.col("same")), "left").withColumn("refers_to", F.col("first"))


def train_dictionary(pages: DataFrame, payload_col: str, samples: int = 1000, sample_bytes: int = 1 << 16, size: int = 112_640) -> bytes:
    """A dictionary from a bounded sample of the records: of distinct payloads about `samples`, chosen by hash.

    Payloads are trained on as they are archived, with the WARC and HTTP heads
    that all records have in common, some as revisits; ids, URIs and dates, which
    differ from row to row, have a stand-in. A payload of up to `sample_bytes` is taken whole, of a longer one sixteen
    segments spread evenly from its start to its end. The sample depends on
    the payloads alone, not on their order or on how often each occurs. Empty
    if there are no payloads; with too few to train on, their bytes serve as a
    raw dictionary.
    """
    full = pages.select(F.col(payload_col).cast("binary").alias("p")).where(F.length("p") > 0).withColumn("h", F.xxhash64("p"))
    n = full.agg(F.approx_count_distinct("h")).first()[0]
    some = full.where(F.pmod(F.xxhash64("h"), F.lit(max(1, n // samples))) == 0)
    part = sample_bytes // 16
    spread = f"transform(sequence(0, 15), i -> substring(p, 1 + cast(floor(i * (length(p) - {part}) / 15) as int), {part}))"
    pieces = F.expr(f"case when length(p) <= {sample_bytes} then array(p) else {spread} end")
    found = some.select("h", F.struct(pieces.alias("pieces"), F.sha2("p", 256).alias("digest")).alias("s")).groupBy("h").agg(F.min("s").alias("s"))
    told = []
    for h, (first, *rest), digest in sorted((r.h, [bytes(x) for x in r.s.pieces], r.s.digest) for r in found.toLocalIterator()):
        told += [record(h, None, first, digest, None, DATE), *rest]
        if len(told) % 16 == 0:
            told.append(record(h, None, b"", digest, h, DATE))
    if not told:
        return b""
    try:
        return zstandard.train_dictionary(size, told, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(told)[:size]


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def _safe(value) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def _name(page_id, digest: str) -> str:
    """A record's id: rows with one page_id and different payloads have different ones."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest[:32]}>"


def _page_of(name: str | None) -> int | None:
    number = None if name is None else name[len("<urn:page:") : -1].partition(":")[0]
    return None if number in (None, "none") else int(number)


def record(page_id, uri, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id, digest)), ("WARC-Date", date)]
    if uri:
        fields.append(("WARC-Target-URI", _safe(uri)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to, digest)), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", min_revisit_bytes: int = 100, archive_bytes: int = 1 << 30, level: int = 3, date: str | Column = DATE) -> DataFrame:
    """Write every page as a record into archives under `path` (a URI that pyarrow and all executors reach; a path without a scheme is taken as Spark takes it); returns the manifest.

    A task writes archives under names of its own attempt, and just those of
    committed tasks enter the manifest, so that a lost or repeated task leaves
    no record twice. A null payload is empty; payloads under
    `min_revisit_bytes` are always responses, as are all rows with a null id
    or with the smallest id itself. Repeated rows are records each; rows alike in id and payload
    are copies of one record and share its record id. A payload
    is held whole, by the task that writes it. `date`: the records' date, one
    for all or a timestamp column's (UTC). Ids are whole numbers; columns that
    are not named are left out, so their names cannot clash. An empty table
    gives an empty manifest.
    """
    spark = pages.sparkSession
    lean_batches(spark)
    path = qualified(spark, path)
    dictionary = train_dictionary(pages, payload_col)
    shipped = spark.sparkContext.broadcast(dictionary)  # 110 KB at most
    when = F.lit(date) if isinstance(date, str) else F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.col(uri_col) if uri_col else F.lit(None).cast("string")
    rows = classify(pages.select(F.col(id_col).cast("long").alias("page_id"), uri.alias("uri"), F.col(payload_col).alias("body"), when.alias("date")), "page_id", "body", min_revisit_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        given = zstandard.ZstdCompressionDict(shipped.value) if shipped.value else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=given)
        context = TaskContext.get()
        out, done, n, size, number = None, [], 0, 0, 0
        for batch in batches:
            for page_id, uri, payload, digest, refers_to, told in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{number:03d}-{uuid.uuid4().hex[:12]}.warc.zst"
                    out, n, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    out.write(frame := dictionary_frame(shipped.value))
                    size, number = len(frame), number + 1
                frame = packer.compress(record(page_id, uri, payload.encode(), digest, refers_to, told))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{path}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    manifest = rows.select("page_id", "uri", "payload", "digest", "refers_to", "date").mapInArrow(write, MANIFEST)
    where = f"{path}/manifest"
    manifest.write.parquet(where)
    return spark.read.schema(MANIFEST).parquet(where)


def records_of(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, record) for each record of an archive; a leading dictionary frame is used and skipped."""
    held, at, ended = b"", 0, False

    def more() -> bool:
        nonlocal held, ended
        got = stream.read(chunk)
        ended = not got
        held += got
        return not ended

    while len(held) < 8 and more():
        pass
    given = None
    if len(held) >= 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", held[4:8])[0]
        while len(held) < 8 + size and more():
            pass
        body = held[8 : 8 + size]
        if body[:4] == struct.pack("<I", 0xFD2FB528):
            body = zstandard.ZstdDecompressor().decompress(body)
        given = zstandard.ZstdCompressionDict(body) if body else None
        held, at = held[8 + size :], 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=given)
    while held or more():
        frame, parts, used = unpacker.decompressobj(), [], 0
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                rest = frame.unused_data
                used += len(held) - len(rest)
                held = rest
                break
            used += len(held)
            held = b""
            if not more():
                raise ValueError(f"archive ends within the record at {at}")
        yield at, b"".join(parts)
        at += used


def parse(raw: bytes) -> tuple:
    """(page_id, uri, payload_bytes, payload_digest, record_type, refers_to), checked against the stored payload."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    digest = field["warc-payload-digest"].removeprefix("sha256:")
    if field["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {field['warc-record-id']} does not match its digest")
    return _page_of(field["warc-record-id"]), field.get("warc-target-uri"), size, digest, field["warc-type"], _page_of(field.get("warc-refers-to"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record of the archives in the manifest; payloads of responses are checked against their digests."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if "long" in x else pa.string()) for n, x in zip(names, RECORDS.split(", "))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, where = pa.fs.FileSystem.from_uri(path)
                rows = []
                with fs.open_input_stream(where, compression=None) as stream:
                    for offset, raw in records_of(stream):
                        rows.append((*parse(raw), path, offset))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages, then read the archives back."""
    return read_archives(write_archives(pages, path or fresh_path(pages.sparkSession, "warc")))
