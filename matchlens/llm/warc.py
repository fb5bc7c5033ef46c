"""WARC archives: writing, normalising of whole-file gzip streams, and reading by offset.

An archive that is one gzip stream cannot be read from the middle. The normaliser inflates such a
stream once, front to back, rewrites every record as a gzip member of its own, and writes an index
of where each member lies, so that any part of the archive can be read alone afterwards. Records
whose payload another record carries are turned into revisits while they pass by.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.common import lookup, new_folder, stored

#: Bytes read from an archive at a time.
BLOCK = 1 << 20
#: Profile of revisits to records of equal payload: a fixed value of the format.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry this date, so that a repeated task writes the same bytes.
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str, page: str, payload_digest: str, n_bytes: int, body: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record: headers, a blank line, the block, two line ends."""
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page)}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("X-Page-ID", page), ("X-Payload-Length", str(n_bytes)),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, refers_to)}>"), ("X-Refers-To-Page-ID", refers_to),
            ("WARC-Profile", SAME_PAYLOAD),
        ]
    headers += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


class Inflated:
    """The bytes of a gzip file, of one member or many, read front to back in blocks."""

    def __init__(self, stream):
        self.stream, self.buffer, self.inflater = stream, bytearray(), None

    def _more(self) -> bool:
        data = self.stream.read(BLOCK)
        if not data:
            if self.inflater is not None and not self.inflater.eof:
                raise ValueError("the gzip stream ends early")
            return False
        while data:
            if self.inflater is None or self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            self.buffer += self.inflater.decompress(data)
            data = self.inflater.unused_data
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("a record header ends early")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a record ends early")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of a gzip file; one record is held at a time."""
    source = Inflated(stream)
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while line := source.line():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, source.take(int(headers["content-length"]))


class ArchiveFile:
    """A file that appears under its name only when it is complete, whichever attempt writes it."""

    def __init__(self, uri: str):
        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.files.open_output_stream(self.draft, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.files.move(self.draft, self.path)


def _uri(folder: str) -> str:
    return folder if "://" in folder else ("file://" + folder.removeprefix("file:") if folder.startswith(("/", "file:")) else folder)


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", level: int = 1) -> DataFrame:
    """Write `pages` as archives of one gzip stream each, a file per task; list what was written.

    Returns (file, seq, id, payload_bytes, payload_digest). File names hold the attempt, so
    that the list, once stored, names exactly the files of the tasks that it came from. A null
    payload is empty. The list must be stored before use: it is made by writing.
    """
    folder = _uri(folder)
    kind = pages.schema[id_col].dataType.simpleString()
    fields = [("file", "string"), ("seq", "long"), ("id", kind), ("payload_bytes", "long"), ("payload_digest", "string")]
    types = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = out = None
        squeeze, seq = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(start, 256), []
                for page, address, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if out is None:
                        context = TaskContext.get()
                        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
                        out = ArchiveFile(name)
                    body = text or b""
                    sha = digest(body)
                    out.write(squeeze.compress(record("response", (address or "").replace("\r", " ").replace("\n", " "), str(page), sha, len(body), body)))
                    rows.append((name, seq, page, len(body), sha))
                    seq += 1
                if rows:
                    columns = zip(zip(*rows, strict=True), fields, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, (_, k) in columns], [f[0] for f in fields])
        if out is not None:
            out.write(squeeze.flush())
            out.close()

    base = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("binary").alias("payload"))
    return base.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields))


def revisits(listed: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(file, seq, refers_to) for the listed records that are to be revisits.

    Of the records with equal payloads of at least `least_bytes` bytes, the one with the smallest id
    is the response (its repeated rows too), all others revisit it. Records without an id are
    responses. The rows of a payload that a third of all records share are dealt over tasks.
    """
    rows = listed.where(F.col("payload_bytes") >= least_bytes).where(F.col("id").isNotNull())
    first = rows.groupBy("payload_digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1").select("payload_digest", "refers_to"), "firsts")
    told = lookup(rows.select("file", "seq", "id", "payload_digest"), first, "payload_digest", ["file", "seq"])
    return told.where(F.col("refers_to") < F.col("id")).select("file", "seq", "refers_to")


def normalise(files: DataFrame, folder: str, decisions: DataFrame | None = None, level: int = 6) -> DataFrame:
    """Rewrite whole-stream archives with a member per record, and write their offset indexes.

    `files` has a column `file` of archive names, `decisions` (file, seq, refers_to) the records to
    turn into revisits. A task per archive reads it once, in blocks, with one record and the archive's
    decisions in memory.
    Returns the index, a row per record: (file, offset, length, seq, id, record_type), offsets and lengths of
    the compressed members. Beside ``x.warc.gz`` lies ``x.warc.gz.idx`` with the same rows as text.
    """
    folder = _uri(folder)
    spark = files.sparkSession
    if decisions is None:
        decisions = spark.createDataFrame([], "file string, seq long, refers_to long")
    fields = pa.schema([
        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()), ("id", pa.string()), ("record_type", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, told in zip(batch.column("file").to_pylist(), batch.column("told"), strict=True):
                yield from rewritten(name, told)

    def rewritten(name: str, told: pa.Scalar) -> Iterator[pa.RecordBatch]:
        refers = dict(zip(*(told.values.field(f).to_pylist() for f in ("seq", "refers_to")), strict=True)) if told.is_valid else {}
        files_, path = fs.FileSystem.from_uri(name)
        target, rows = f"{folder}/{name.rsplit('/', 1)[1]}", []
        out, index, offset = ArchiveFile(target), ArchiveFile(target + ".idx"), 0
        with files_.open_input_stream(path, compression=None) as stream:
            for seq, (headers, body) in enumerate(records(stream)):
                to = refers.get(seq)
                kind = headers["warc-type"] if to is None else "revisit"
                sha, page = headers["warc-payload-digest"].removeprefix("sha1:"), headers["x-page-id"]
                plain = record(
                    kind, headers["warc-target-uri"], page, sha, int(headers["x-payload-length"]),
                    body if to is None else b"", None if to is None else str(to),
                )
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = squeeze.compress(plain) + squeeze.flush()
                out.write(member)
                index.write(f"{offset} {len(member)} {kind} {page} {sha}\n".encode())
                rows.append((target, offset, len(member), seq, page, kind))
                offset += len(member)
                if len(rows) == 1024:
                    yield _record_batch(rows, fields)
                    rows = []
        out.close()
        index.close()
        if rows:
            yield _record_batch(rows, fields)

    told = decisions.groupBy("file").agg(F.collect_list(F.struct(F.col("seq"), F.col("refers_to"))).alias("told"))
    names = stored(files.select("file").distinct(), "names")
    each = names.join(told, "file", "left").select("file", "told").repartition(max(1, names.count()))  # a task per archive
    return each.mapInArrow(run, "file string, offset long, length long, seq long, id string, record_type string")


def read_records(index: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """Read the records of an offset index back, each range of an archive by itself.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) as the
    archives say; a response's length and digest are taken from its payload and must agree with its headers.
    """
    slot = F.floor(F.col("offset") / F.lit(range_bytes))
    ranges = index.groupBy("file", slot.alias("slot")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"))
    schema = pa.schema([
        ("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                files_, path = fs.FileSystem.from_uri(name)
                rows = []
                with files_.open_input_file(path) as file:
                    file.seek(start)
                    for headers, body in records(_Part(file, end - start)):
                        rows.append(_told(headers, body))
                        if len(rows) == 64:
                            yield _record_batch(rows, schema)
                            rows = []
                if rows:
                    yield _record_batch(rows, schema)

    spread = ranges.select("file", "start", "end").repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")


class _Part:
    """The next `n` bytes of a file."""

    def __init__(self, file, n: int):
        self.file, self.left = file, n

    def read(self, size: int) -> bytes:
        data = self.file.read(min(size, self.left))
        self.left -= len(data)
        return data


def _told(headers: dict[str, str], body: bytes) -> tuple:
    sha, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
    if headers["warc-type"] == "response" and (len(body), digest(body)) != (size, sha):
        raise ValueError(f"record of page {headers['x-page-id']} does not match its digest")
    page = headers["x-page-id"]
    return None if page == "None" else page, size, sha, headers["warc-type"], headers.get("x-refers-to-page-id"), headers["warc-target-uri"], body


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def archive(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write `pages` to archives in the shared folder, normalise them, and read the result back.

    One row per row of `pages`, as `read_records` gives them. Null payloads are empty, a null URL is
    an empty one, a null id stays null and is always a response. Repeated rows and ids are records of
    their own. Other columns and their names play no part. An empty table gives an empty one.
    """
    listed = stored(write_monolithic(pages, new_folder(spark, "whole"), id_col, url, payload), "listed")
    index = stored(normalise(listed, new_folder(spark, "members"), revisits(listed, least_bytes)), "index")
    return read_records(index)
