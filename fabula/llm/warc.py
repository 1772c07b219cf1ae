"""WARC archives by way of a table of chunks.

A payload travels as rows ``(record, chunk, data)`` of bounded size, never as one value. Each row carries the SHA-1 of
the payload so far, so a reader checks every prefix and the last chunk's digest is the payload's. Writers stream chunks
into archives, one gzip member for each record, and readers inflate them piece by piece into chunk rows again.

A payload's first copy in the archive sense is the response, later ones are revisits without a body that name it. Which
is which follows from digests alone: one small row for each record, pre-aggregated by digest; the join back is salted,
since one payload may be a third of all records.

Edge cases: a null payload is an empty one; a null record id makes a response, or a revisit if an equal payload has an
id; rows with equal id and payload are the same record written twice, both of them responses if they are the latest; an
empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import materialise, new_folder, partitions
from fabula.llm.token_store import filesystem

CHUNK_BYTES = 64 << 10
#: Bytes of an archive, after compression, before the next record begins a new one.
ARCHIVE_BYTES = 256 << 20
SALTS = 16
CHUNKS = (
    "record_id bigint, uri string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "chunk int, last boolean, data binary, digest string"
)
HEAD = ("record_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32(hex_digest: Column) -> Column:
    """Base32 of 160 bits given as 40 hexadecimal digits: five of those are four characters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def four(i: int) -> list[Column]:
        bits = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        five = lambda s: F.shiftright(bits, s).bitwiseAND(F.lit(31))
        return [alphabet.substr(five(s) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*(c for i in range(8) for c in four(i)))


def plan_records(df: DataFrame, id_col: str, payload_col: str, uri_col: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Decides each record's type. ``record_id, uri, data`` and HEAD's other columns, a row for each row of ``df``.

    Of records with equal payloads of ``min_bytes`` or more, the one with the largest id is the response."""
    data = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("bigint").alias("record_id"), uri.alias("uri"), data.alias("data"))
    rows = rows.select("*", F.octet_length("data").cast("bigint").alias("payload_bytes"), F.sha1("data").alias("h"))
    latest = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("h", "payload_bytes")
        .agg(F.max("record_id").alias("latest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND latest IS NOT NULL")
        .select("h", "payload_bytes", "latest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("record_id", "uri"), F.lit(SALTS)).cast("int"))
    joined = salted.join(latest, ["h", "payload_bytes", "salt"], "left")
    later = F.col("latest").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("latest"))
    return joined.select(
        "record_id",
        "uri",
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("latest")).alias("refers_to"),
        "payload_bytes",
        base32(F.upper("h")).alias("payload_digest"),
        F.when(~later, F.col("data")).alias("data"),
    )


def chunk_rows(df: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """HEAD's columns on a record's first chunk only, and on each chunk ``chunk, last, data, digest``.

    A record's chunks follow each other. A record without a body is one chunk without data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            heads = [batch.column(c).to_pylist() for c in HEAD]
            for i, data in enumerate(batch.column("data")):
                head, body = tuple(h[i] for h in heads), data.as_buffer() if data.is_valid else pa.py_buffer(b"")
                sha, none = hashlib.sha1(), (head[0], *[None] * (len(HEAD) - 1))
                for k in range(max(1, -(-body.size // chunk_bytes))):
                    part = body.slice(k * chunk_bytes, min(chunk_bytes, body.size - k * chunk_bytes)).to_pybytes()
                    sha.update(part)
                    rows.append((*(none if k else head), k, (k + 1) * chunk_bytes >= body.size, part, base64.b32encode(sha.digest()).decode()))
                    size += len(part)
                    if size > 4 << 20:
                        yield _arrow(rows)
                        rows, size = [], 0
            if rows:
                yield _arrow(rows)

    return df.select(*HEAD, "data").mapInArrow(run, CHUNKS)


_KINDS = [("record_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("digest", pa.string())]


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _KINDS, strict=True)], [n for n, _ in _KINDS])


class _Archive:
    """An archive being written: one gzip member for each record, moved to its place when complete."""

    def __init__(self, folder: str, partition: int, part: int, level: int):
        self.files, base = filesystem(folder)
        self.part, self.level, self.size, self.records = part, level, 0, 0
        self.name, self.to = (f"{x}/part-{partition:06d}-{part:04d}.warc.gz" for x in (folder, base))
        self.temp = f"{self.to}.{uuid.uuid4().hex}"
        self.files.create_dir(base, recursive=True)
        self.out = self.files.open_output_stream(self.temp, compression=None)

    def begin(self, head: tuple) -> None:
        record_id, uri, kind, refers_to, n, digest = head
        self.gzip = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
        lines += [f"WARC-Target-URI: {''.join(uri.split())}"] if uri else []
        lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
        if kind == "revisit":
            lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else n}", "", ""]
        self.add("\r\n".join(lines).encode())
        self.records += 1

    def add(self, data: bytes) -> None:
        self._put(self.gzip.compress(data))

    def end(self) -> None:
        self._put(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.files.move(self.temp, self.to)
        return self.name, self.records, self.size


def _urn(record_id: int | None) -> str:
    return f"<urn:fabula:{'null' if record_id is None else record_id}>"


def write_archives(records: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, level: int = 1) -> DataFrame:
    """Writes the records of ``plan_records`` and returns a written table ``path, records, bytes`` of the archives.

    The chunks stay where their record is: cutting a payload and streaming it into an archive is one narrow step."""
    chunks = chunk_rows(records, chunk_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, done, partition = None, [], TaskContext.get().partitionId()
        for batch in batches:
            heads = [batch.column(c).to_pylist() for c in HEAD]
            for i, (k, last, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk", "last", "data")), strict=True)):
                if k == 0:
                    if archive and archive.size >= ARCHIVE_BYTES:
                        done.append(archive.close())
                        archive = _Archive(folder, partition, archive.part + 1, level)
                    archive = archive or _Archive(folder, partition, 0, level)
                    archive.begin(tuple(h[i] for h in heads))
                archive.add(data)
                if last:
                    archive.end()
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    return materialise(chunks.select(*HEAD, "chunk", "last", "data").mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


class ArchiveReader:
    """Streams an archive: ``records()`` yields a header and an iterator over its payload's chunks, which must be used
    up before the next record. Holds a chunk and the inflater's window."""

    def __init__(self, path: str, chunk_bytes: int = CHUNK_BYTES):
        files, at = filesystem(path)
        self.raw, self.chunk_bytes, self.held = files.open_input_stream(at, compression=None), chunk_bytes, b""
        self.rest, self.inflate = b"", None

    def _more(self) -> bool:
        """Inflates some more; False at the end. A new gzip member begins where the last one ended."""
        while True:
            if not self.rest:
                self.rest = self.raw.read(self.chunk_bytes)
                if not self.rest:
                    return False
            self.inflate = self.inflate or zlib.decompressobj(31)
            data = self.inflate.decompress(self.rest, self.chunk_bytes)
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.inflate = None
            if data:
                self.held += data
                return True

    def _line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                return None
        line, self.held = self.held[:at], self.held[at + 2 :]
        return line

    def _body(self, n: int) -> Iterator[bytes]:
        while n > 0:
            size = min(n, self.chunk_bytes)
            while len(self.held) < size:
                if not self._more():
                    raise EOFError("an archive ends inside a record")
            part, self.held = self.held[:size], self.held[size:]
            n -= size
            yield part

    def records(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        while (first := self._line()) is not None:
            if not first:
                continue  # the empty lines after a record
            if not first.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {first[:80]!r}")
            head = {}
            while line := self._line():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.lower()] = value.strip()
            body = self._body(int(head["content-length"]))
            yield head, body
            for _ in body:
                pass


def read_chunks(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The archives' records as chunk rows: ``record_id, uri, record_type, refers_to, payload_bytes, payload_digest,
    chunk, last, data, digest``, the digest being that of the record's own body up to this chunk.

    A response whose body doesn't have the digest or length that its header states is an error."""

    def number(urn: str | None) -> int | None:
        found = (urn or "").strip("<>").rpartition(":")[2]
        return int(found) if found not in ("", "null") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            rows, size = [], 0
            for head, body in ArchiveReader(path, chunk_bytes).records():
                fields = (number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], number(head.get("warc-refers-to")), int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"))
                sha, total, part, k = hashlib.sha1(), 0, next(body, b""), 0
                while True:
                    sha.update(part)
                    total, after = total + len(part), next(body, None)
                    digest = base64.b32encode(sha.digest()).decode()
                    rows.append((*fields, k, after is None, part, digest))
                    size += len(part) + 200
                    if size > 4 << 20:
                        yield _arrow(rows)
                        rows, size = [], 0
                    if after is None:
                        break
                    part, k = after, k + 1
                if fields[2] == "response" and (digest, total) != (fields[5], fields[4]):
                    raise ValueError(f"{path}: record {fields[0]} isn't what its header says")
            if rows:
                yield _arrow(rows)

    return archives.select("path").repartition(2 * partitions(archives.sparkSession), "path").mapInArrow(run, CHUNKS)


def archive_folder(spark) -> str:
    return new_folder(spark, "warc")

