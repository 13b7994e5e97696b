"""WARC archives as a chunked record table.

A payload is never one value of a Python task: it is cut into rows
``(record_id, chunk_no, chunk)``, written chunk by chunk into WARC/1.1 files
(one gzip member per record) and read back the same way, every chunk row
carrying the SHA-256 of the payload so far. The digest of the last chunk row
is the payload's digest.

Files live in a folder that all executors share (any URI that pyarrow can
open: file, hdfs, s3, gs). A task writes under a name of its own attempt and
renames it when complete, so a retried task replaces its file and readers,
who list ``*.warc.gz`` only, never see half of one.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_batches

# Field names and record types of WARC/1.1. Fields that start
# with WARC-Payload-Length and WARC-Source-Id are extensions of this writer.
VERSION = b"WARC/1.1"
CRLF = b"\r\n"

CHUNK = 256 * 1024
MIN_SHARED = 100  # payloads below this many bytes are always stored
SALTS = 256
CHUNK_SCHEMA = ("record_id string, source_id long, record_type string, refers_to long, payload_bytes long, "
                "chunk_no int, chunk binary, digest_so_far string, declared_digest string, is_last boolean")


def with_record_types(pages: DataFrame, id_col: str, payload_col: str, min_shared: int = MIN_SHARED) -> DataFrame:
    """``source_id, payload, payload_bytes, payload_digest, record_type,
    refers_to`` per row of ``pages`` (other columns are dropped).

    Of rows with equal payloads of at least ``min_shared`` bytes, those with
    the smallest id are responses and the others revisits of that id. A null
    payload is empty. A row without an id becomes a revisit if an equal
    payload has one, else a response.

    The smallest id per digest is aggregated per (digest, salt) and again per
    digest; it goes back to exactly the salts that hold rows of the digest,
    so a payload shared by a third of all rows is joined in many tasks.
    """
    p = pages.select(F.col(id_col).cast("long").alias("source_id"),
                     F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = (p.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
          .withColumn("payload_digest", F.sha2("payload", 256))
          .withColumn("salt", F.pmod(F.xxhash64("source_id"), F.lit(SALTS)).cast("int")))
    shared = p.where(F.col("payload_bytes") >= min_shared)
    first = (shared.groupBy("payload_digest", "salt").agg(F.min("source_id").alias("first_id"), F.count("*").alias("n"))
                   .groupBy("payload_digest")
                   .agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
                   .where(F.col("n") > 1)
                   .select("payload_digest", "first_id", F.explode("salts").alias("salt")))
    same = F.col("first_id").isNull() | F.col("source_id").eqNullSafe(F.col("first_id"))
    return (p.join(first.hint("shuffle_hash"), ["payload_digest", "salt"], "left")
             .select("source_id", "payload", "payload_bytes", "payload_digest",
                     F.when(same, "response").otherwise("revisit").alias("record_type"),
                     F.when(~same, F.col("first_id")).alias("refers_to")))


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """The payloads of ``with_record_types`` as chunk rows. An empty payload
    and a revisit (which stores none) have one empty chunk."""
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    n = F.greatest(F.ceil(stored / chunk_bytes), F.lit(1)).cast("int")
    return (records.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"), (n - 1).alias("last_no"))
                   .select("source_id", "record_type", "refers_to", "payload_bytes", "payload_digest",
                           "chunk_no", (F.col("chunk_no") == F.col("last_no")).alias("is_last"),
                           F.when(stored > 0, F.substring("payload", F.col("chunk_no") * chunk_bytes + 1,
                                                          F.lit(chunk_bytes))).otherwise(F.lit(b"")).alias("chunk")))


def record_uri(source_id: int | None, payload_digest: str) -> str:
    """The record's id: a UUID made from the row's id (without one: from its payload)."""
    name = f"{source_id}" if source_id is not None else f"payload:{payload_digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _header(row: dict) -> bytes:
    stored = row["payload_bytes"] if row["record_type"] == "response" else 0
    fields = [("WARC-Type", row["record_type"]),
              ("WARC-Record-ID", record_uri(row["source_id"], row["payload_digest"])),
              ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", f"urn:page:{'' if row['source_id'] is None else row['source_id']}"),
              ("Content-Type", "text/html; charset=utf-8"),
              ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
              ("WARC-Payload-Length", str(row["payload_bytes"]))]
    if row["source_id"] is not None:
        fields.append(("WARC-Source-Id", str(row["source_id"])))
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_uri(row["refers_to"], row["payload_digest"])),
                   ("WARC-Refers-To-Target-URI", f"urn:page:{row['refers_to']}")]
    fields.append(("Content-Length", str(stored)))
    return VERSION + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields) + CRLF


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    if colon and not rest.startswith("//"):  # Hadoop prints file:/x for file:///x
        uri = f"{scheme}://{rest}"
    return pafs.FileSystem.from_uri(uri if colon else f"file://{uri}")


def write_warc(chunks: DataFrame, folder: str, level: int = 3) -> int:
    """Write chunk rows (those of a record adjacent and in order, as
    ``chunk_table`` makes them) to ``folder``, one archive per task; returns
    the number of records. One job over ``chunks``."""
    bounded_batches(chunks.sparkSession, rows=64, mb=16)
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)  # also there when no record is

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, base = _open(folder)
        tmp = f"{base}/.{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex}.tmp"
        n, gz, out = 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(tmp, compression=None)
                if row["chunk_no"] == 0:
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(gz.compress(_header(row)))
                    n += 1
                out.write(gz.compress(row["chunk"]))
                if row["is_last"]:
                    out.write(gz.compress(CRLF + CRLF) + gz.flush())
        if out is not None:
            out.close()
            fs.move(tmp, f"{base}/records-{ctx.partitionId():06d}.warc.gz")
        yield pa.RecordBatch.from_pydict({"records": pa.array([n], pa.int64())})

    return chunks.mapInArrow(write, "records long").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


class _Members:
    """Bytes of a file of gzip members, decompressed in bounded pieces."""

    def __init__(self, stream, block: int = 1 << 18):
        self.stream, self.block, self.gz, self.raw, self.buf = stream, block, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.block)
                if not self.raw:
                    return False
            piece = self.gz.decompress(self.raw, self.block)
            self.raw = self.gz.unconsumed_tail
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            if piece:
                self.buf += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buf.find(mark)) < 0:
            if not self.more():
                if self.buf.strip():
                    raise ValueError("truncated WARC record header")
                return None
        out, self.buf = self.buf[:at], self.buf[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self.more():
                raise ValueError("truncated WARC record")
        out, self.buf = self.buf[:n], self.buf[n:]
        return out


def _records(stream, chunk_bytes: int) -> Iterator[tuple]:
    m = _Members(stream)
    while (head := m.until(CRLF + CRLF)) is not None:
        lines = head.split(CRLF)
        if lines[0] != VERSION:
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        f = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        left, no, sha = int(f["content-length"]), 0, hashlib.sha256()
        target = f.get("warc-refers-to-target-uri", "").removeprefix("urn:page:")
        fixed = (f["warc-record-id"], int(f["warc-source-id"]) if "warc-source-id" in f else None, f["warc-type"],
                 int(target) if target else None, int(f["warc-payload-length"]))
        declared = f["warc-payload-digest"].removeprefix("sha256:")
        while True:
            chunk = m.take(min(left, chunk_bytes))
            left -= len(chunk)
            sha.update(chunk)
            yield (*fixed, no, chunk, sha.hexdigest(), declared, left == 0)
            no += 1
            if left == 0:
                break
        if m.take(4) != CRLF + CRLF:
            raise ValueError("WARC record without its end")
        m.buf = m.buf.lstrip(b"\r\n") if m.buf[:2] == CRLF else m.buf


def read_warc(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK, batch_bytes: int = 8 << 20) -> DataFrame:
    """The chunk rows of all archives in ``folder``.

    ``record_id, source_id, record_type, refers_to, payload_bytes, chunk_no,
    chunk, digest_so_far, declared_digest, is_last``; ``payload_bytes`` and
    ``declared_digest`` are of the full payload also for a revisit. One
    archive is one task; memory is bounded by ``batch_bytes`` and the chunk.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
                  .select("path"))
    files = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(),
             pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, types)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _open(path)
                rows, size = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for row in _records(stream, chunk_bytes):
                        rows.append(row)
                        size += len(row[6]) + 400
                        if size >= batch_bytes:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(read, CHUNK_SCHEMA)


def roundtrip(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html",
              chunk_bytes: int = CHUNK) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` and return the chunk rows read back."""
    write_warc(chunk_table(with_record_types(pages, id_col, payload_col), chunk_bytes), folder)
    return read_warc(pages.sparkSession, folder, chunk_bytes)


def digests(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk row: ``source_id, payload_bytes,
    payload_digest, record_type, refers_to``. A response's digest is the one
    computed while reading; a response whose bytes do not hash to the digest
    that its header declares fails the job."""
    last = chunks.where("is_last")
    ok = (F.col("record_type") == "revisit") | (F.col("digest_so_far") == F.col("declared_digest"))
    digest = F.when(ok, F.col("declared_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload digest differs from the header of "), F.col("record_id"))))
    return last.select("source_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
