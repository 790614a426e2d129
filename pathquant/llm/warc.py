"""WARC archives and a normaliser for monolithic gzip.

A monolithic archive is one gzip stream over all its records: no record can be read without inflating all
before it. The normaliser inflates the stream once, rewrites every record as a gzip member of its own and
writes a sidecar index (record id, offset, length), by which records are then read alone and in parallel.

Files are written under a name of their own and then moved into place, so that a task that is run again,
or twice, leaves one whole file. They go to the shared folder through the file system of its URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathquant.llm.common import shared_path, stored

ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
INDEX = "archive string, record string, offset long, length long"
SALTS = 32  # tasks over which pages of one payload meet the group's first page
READ_BYTES = 32 << 20  # bytes of members that one task reads, about


def filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class Moved:
    """A file to write that appears under its name when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.own)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.own, self.path)
        else:
            self.fs.delete_file(self.own)


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response, or with refers_to a revisit, which has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or 'urn:none')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    return fields, rest[: int(fields["Content-Length"])]


def inflated(stream):
    """Chunks of a gzip stream of one member or several."""
    engine = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
            else:
                break


def records(chunks):
    """Whole records of a stream of chunks; holds one record and one chunk at a time."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(re.search(rb"(?im)^content-length:\s*(\d+)", held[:end])[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends inside a record")


def _write(folder: str, level: int):
    def run(batches):
        from pyspark import TaskContext

        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        n = 0
        with Moved(path) as out:
            engine = zlib.compressobj(level, zlib.DEFLATED, 31)
            while batch is not None:
                for page_id, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5))):
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    out.write(engine.compress(record(page_id.as_py(), url.as_py(), payload, base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers_to.as_py())))
                    n += 1
                batch = next(batches, None)
            out.write(engine.flush())
        yield pa.RecordBatch.from_pydict({"archive": [path], "records": pa.array([n], pa.int64())})

    return run


def write_monolithic(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, level: int = 1) -> DataFrame:
    """Writes an archive of one gzip stream per partition; returns (archive, records).

    Of records with equal payloads of min_payload bytes at least, that of the smallest id is the response and
    the others revisit it. A null html is an empty payload. A null id never becomes the first of a group
    that has ids; in a group without any, all are responses. Rows that repeat the smallest id are responses too.
    A payload is held whole by the task that writes it, however long. An empty table writes no archive. Other columns
    are not read. Pages of one payload are spread over SALTS tasks; only groups of more than one page meet them there.
    """
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    groups = rows.where(F.octet_length("html") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    salt, salts = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rows = rows.withColumn("salt", salt).join(groups.withColumn("salt", salts), ["digest", "salt"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return stored(rows.mapInArrow(_write(folder, level), "archive string, records long"), "warc-manifest")


def _normalise(folder: str, level: int):
    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = source.rpartition("/")[2]
                target, index = f"{folder}/{name}", f"{folder}/{name}.idx"
                fs, path = filesystem(source)
                lines, offset = [], 0
                with fs.open_input_stream(path, compression=None) as stream, Moved(target) as out:
                    for data in records(inflated(stream)):
                        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = engine.compress(data) + engine.flush()
                        out.write(member)
                        lines.append(f"{target}\t{re.search(rb'WARC-Record-ID: <([^>]*)>', data)[1].decode()}\t{offset}\t{len(member)}\n")
                        offset += len(member)
                with Moved(index) as out:
                    out.write("".join(lines).encode())
                yield pa.RecordBatch.from_pydict({"archive": [target], "index": [index], "records": pa.array([len(lines)], pa.int64())})

    return run


def normalise(archives: DataFrame, folder: str, *, level: int = 1) -> DataFrame:
    """Rewrites monolithic archives (column archive) with a member per record; returns (archive, index, records).

    An archive whose members are whole records already comes out with the same records. An archive without
    records comes out empty, with an empty index; one that ends inside a record is an error.
    """
    names = stored(archives.select("archive").distinct(), "warc-archives")
    tasks = max(1, names.count())  # one archive is one stream: the unit of work
    return stored(names.repartitionByRange(tasks, "archive").mapInArrow(_normalise(folder, level), "archive string, index string, records long"), "warc-normalised")


def _read(batches):
    opened: tuple = (None, None)
    for batch in batches:
        got = []
        for archive, _, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            if opened[0] != archive:
                fs, path = filesystem(archive)
                opened = (archive, fs.open_input_file(path))
            fields, block = parse(zlib.decompress(opened[1].read_at(length, offset), 31))
            http, _, payload = block.partition(b"\r\n\r\n")
            kind, ident, refers = fields["WARC-Type"], fields["WARC-Record-ID"][len(ID) + 1 : -1], fields.get("WARC-Refers-To")
            size = len(payload) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", http)[1])
            digest = base32_sha1(payload) if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")
            got.append((int(ident) if ident else None, size, digest, kind, int(refers[len(ID) + 1 : -1]) if refers else None))
        columns = list(zip(*got)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_records(spark, folder: str) -> DataFrame:
    """Reads every record by the sidecar indexes. Digest and size of a response come from its payload itself."""
    index = spark.read.schema(INDEX).csv(f"{folder}/*.idx", sep="\t", quote="")
    n, size = index.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = min(max(1, n), max(2 * spark.sparkContext.defaultParallelism, size // READ_BYTES))
    return index.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_gzip_normaliser(spark, sf_dir):
    folder = shared_path(spark, "warc")
    written = write_monolithic(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/monolithic")
    done = normalise(written, f"{folder}/members")
    if done.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_records(spark, f"{folder}/members")


#: The digest in base 32: five bits at a time, out of two neighbouring hexadecimal digits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) || '0' AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((16 * (instr('0123456789abcdef', substr(d, 5 * i // 4 + 1, 1)) - 1) + instr('0123456789abcdef', substr(d, 5 * i // 4 + 2, 1)) - 1) >> (3 - 5 * i % 4)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
