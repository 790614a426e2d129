"""Block-gzip files as Spark data sources: lines of text, and framed messages.

A block-gzip file is a row of gzip members of at most 64 KiB of data, each with its own size in its header. So it is an
ordinary gzip file, files can be joined by appending them, and a reader can begin at any member. Messages come in
groups: a count, then as many messages, each after its length; the first message of a group is a tag that says what the others
are. A group begins a member, which says so in its header, so that a large file is read by several tasks. Files whose
members don't say so are read by one task each.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pathquant.sources import messages

#: The header of a member up to its extra fields, and of the field with its size.
MAGIC, SIZE_FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
GROUP_FIELD = b"GS\x00\x00"  # an extra field without data: a group begins here
DATA = 60_000  # bytes of a member, at most
END = MAGIC + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00\x1b\x00\x03\x00" + bytes(8)  # an empty member, which ends a file
GROUP = 1_000  # messages of a group at most
SPLIT = 16 << 20  # bytes of a file that a task reads, about


def filesystem(uri: str):
    """(file system, path) of a folder or file by its URI; a path without a scheme is a local one."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    uri = re.sub(r"^file:/+", "/", uri)
    return (LocalFileSystem(), uri) if "://" not in uri else FileSystem.from_uri(uri)


# ---- members


def member(data: bytes, begins_group: bool = False, level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = SIZE_FIELD + b"\x00\x00" + (GROUP_FIELD if begins_group else b"")
    size = 12 + len(extra) + len(body) + 8
    extra = SIZE_FIELD + struct.pack("<H", size - 1) + extra[6:]
    return MAGIC + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


def header(data: bytes) -> tuple[int, int, bool] | None:
    """(size of the member, bytes of its header, whether a group begins) of the member that data begins with; None if none does."""
    if len(data) < 18 or data[:4] != MAGIC:
        return None
    (extra,) = struct.unpack_from("<H", data, 10)
    at, size, group = 12, 0, False
    while at + 4 <= min(len(data), 12 + extra):
        name, (length,) = data[at : at + 2], struct.unpack_from("<H", data, at + 2)
        if name == SIZE_FIELD[:2] and length == 2 and at + 6 <= len(data):
            size = struct.unpack_from("<H", data, at + 4)[0] + 1
        group |= name == GROUP_FIELD[:2]
        at += 4 + length
    return (size, 12 + extra, group) if size else None


class Members:
    """The members of an open file, from a place on."""

    HEAD = 64  # bytes that hold a header

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(min(n, self.size - place))

    def header(self, place: int):
        return header(self.at(place, self.HEAD)) if place < self.size else None

    def first(self, start: int, end: int) -> int | None:
        """The first place from start on, before end, at which a member begins: it and those after it fit together."""
        place, kept = start, b""
        while place < end:
            data = kept + self.at(place, 1 << 16)
            low = data.find(MAGIC)
            while low >= 0:
                found = place - len(kept) + low
                if found >= end:
                    return None
                after, good = found, 0
                while good < 4 and after < self.size and (h := self.header(after)):
                    after, good = after + h[0], good + 1
                if good == 4 or after == self.size:
                    return found
                low = data.find(MAGIC, low + 1)
            kept = data[-3:]
            place += 1 << 16
        return None

    def data(self, place: int) -> tuple[bytes, int, bool]:
        """Data of the member at a place, the next place, and whether a group begins with it."""
        h = self.header(place)
        if h is None:
            raise ValueError(f"no block-gzip member at byte {place}")
        raw = self.at(place, h[0])
        return zlib.decompress(raw[h[1] : -8], -15), place + h[0], h[2]


# ---- groups of messages


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def groups(tag: bytes, rows: Iterator[bytes]) -> Iterator[bytes]:
    """Groups of messages, with their tag."""
    held: list[bytes] = []
    for row in rows:
        held.append(row)
        if len(held) == GROUP:
            yield varint(len(held) + 1) + b"".join(varint(len(m)) + m for m in (tag, *held))
            held = []
    if held:
        yield varint(len(held) + 1) + b"".join(varint(len(m)) + m for m in (tag, *held))


class _Stream:
    """Bytes of consecutive members, up to a group that another task reads."""

    def __init__(self, members: Members, start: int, end: int):
        self.members, self.place, self.end, self.held, self.at = members, start, end, b"", 0

    def more(self, whole: bool = True) -> bool:
        """Adds the next member; between groups (whole) not one at or after the end in which a group begins."""
        if self.place >= self.members.size:
            return False
        if whole and self.place >= self.end and self.members.header(self.place)[2]:
            return False
        data, self.place, _ = self.members.data(self.place)
        self.held, self.at = self.held[self.at :] + data, 0
        return True

    def number(self) -> int:
        out = shift = 0
        while True:
            while self.at >= len(self.held):
                if not self.more(False):
                    raise ValueError("a file ends inside a message")
            b = self.held[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    def bytes(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self.more(False):
                raise ValueError("a file ends inside a message")
        self.at += n
        return self.held[self.at - n : self.at]

    def messages(self, tag: bytes) -> Iterator[bytes]:
        while True:
            while self.at >= len(self.held):
                if not self.more():
                    return
            count = self.number()
            for i in range(count):
                message = self.bytes(self.number())
                if i or message != tag:  # files may leave the tag out
                    yield message


# ---- data sources


class _Part(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        super().__init__(None)
        self.name, self.start, self.end = name, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: messages.Kind):
        self.uri, self.kind, self.split = options["path"], kind, int(options.get("split", SPLIT))

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, path = filesystem(self.uri)
        info = fs.get_file_info(path)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(self.uri)
        files = [info] if info.type == FileType.File else [f for f in fs.get_file_info(FileSelector(path)) if f.type == FileType.File and not f.base_name.startswith(("_", "."))]
        return [_Part(f.path, low, min(f.size, low + self.split)) for f in sorted(files, key=lambda f: f.path) for low in range(0, f.size, self.split)] or [_Part("", 0, 0)]

    def read(self, part: _Part):
        if not part.name:
            return
        fs, _ = filesystem(self.uri)
        with fs.open_input_file(part.name) as file:
            members = Members(file, file.size())
            place = 0 if part.start == 0 else members.first(part.start, part.end)
            while place is not None and part.start and place < part.end and not members.header(place)[2]:  # a group of the task before
                place += members.header(place)[0]
            if place is None or place >= part.end or place >= members.size:
                return
            found, first = _Stream(members, place, part.end).messages(self.kind.tag), 0
            while held := list(islice(found, GROUP)):
                n = len(held)
                own = [pa.array([part.name] * n, pa.string()), pa.array([part.start] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())]
                yield pa.RecordBatch.from_arrays(self.kind.batch(held) + own, names=[*self.kind.columns, "_file", "_block", "_place"])
                first += n


class _Written(WriterCommitMessage):
    def __init__(self, own: str, name: str):
        self.own, self.name = own, name


class _Writer(DataSourceWriter):
    """Files that appear under their names when the job is done."""

    def __init__(self, options: dict, overwrite: bool):
        from pyarrow.fs import FileSelector

        self.uri, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        fs, path = filesystem(self.uri)
        if not overwrite and fs.get_file_info(FileSelector(path, allow_not_found=True)):
            raise FileExistsError(f"{self.uri} is not empty")

    extension = "gz"

    def members(self, rows) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, iterator):
        from pyspark import TaskContext

        context, (fs, path) = TaskContext.get(), filesystem(self.uri)
        name = f"{path}/part-{context.partitionId():05d}.{self.extension}"
        own = f"{path}/_{self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(own, compression=None) as out:
            for data in self.members(iterator):
                out.write(data)
            out.write(END)
        return _Written(own, name)

    def commit(self, written):
        fs, path = filesystem(self.uri)
        if self.overwrite:
            from pyarrow.fs import FileSelector

            for f in fs.get_file_info(FileSelector(path, allow_not_found=True)):
                if f.is_file and not f.base_name.startswith(f"_{self.job}"):
                    fs.delete_file(f.path)
        for w in written:
            if w is not None:
                fs.move(w.own, w.name)
        fs.open_output_stream(f"{path}/_SUCCESS", compression=None).close()

    def abort(self, written):
        fs, _ = filesystem(self.uri)
        for w in written:
            if w is not None:
                fs.delete_file(w.own)


class _TextWriter(_Writer):
    extension = "txt.gz"

    def members(self, rows):
        held, size = [], 0
        for row in rows:
            line = (row[0] or "").encode() + b"\n"
            if size + len(line) > DATA and held:
                yield member(b"".join(held))
                held, size = [], 0
            for low in range(0, len(line), DATA):  # a long line goes on in the next member
                held.append(line[low : low + DATA])
                size += len(held[-1])
                if size >= DATA:
                    yield member(b"".join(held))
                    held, size = [], 0
        if held:
            yield member(b"".join(held))


class _MessageWriter(_Writer, DataSourceArrowWriter):
    def __init__(self, options, overwrite, kind: messages.Kind):
        super().__init__(options, overwrite)
        self.kind, self.extension = kind, kind.name

    def members(self, rows):
        for group in groups(self.kind.tag, (message for batch in rows for message in self.kind.messages(batch))):
            for low in range(0, len(group), DATA):
                yield member(group[low : low + DATA], low == 0)


class TextSource(DataSource):
    """Lines of text; option path. ``spark.read.text`` reads them back."""

    @classmethod
    def name(cls):
        return "blockgzip-text"

    def schema(self):
        return "line string"

    def writer(self, schema, overwrite):
        if len(schema.fields) != 1 or schema.fields[0].dataType.simpleString() != "string":
            raise ValueError("lines are one string column")
        return _TextWriter(self.options, overwrite)


class _MessageSource(DataSource):
    kind: messages.Kind

    def schema(self):
        return f"{self.kind.schema}, _file string, _block long, _place long"

    def reader(self, schema):
        return _Reader(self.options, self.kind)

    def writer(self, schema, overwrite):
        return _MessageWriter(self.options, overwrite, self.kind)


class AlignmentSource(_MessageSource):
    kind = messages.ALIGNMENTS

    @classmethod
    def name(cls):
        return cls.kind.name


class MultipathSource(_MessageSource):
    kind = messages.MULTIPATHS

    @classmethod
    def name(cls):
        return cls.kind.name


#: Formats of files, by their names.
SOURCES = {s.name(): s for s in (TextSource, AlignmentSource, MultipathSource)}


def register(spark) -> None:
    """Makes the formats known to a session; to do so again changes nothing."""
    for source in SOURCES.values():
        spark.dataSource.register(source)

