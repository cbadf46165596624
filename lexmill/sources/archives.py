"""A Spark data source that reads JSON lines out of zip archives, even truncated ones.

An archive is walked entry by entry from its beginning, without the directory at its end, so
what a broken download holds is read.  Directories are passed over, archives stored inside an
archive are walked in their turn, and every other entry, deflated or stored, gives its lines.
Entries are inflated in bounded blocks; lines that do not parse and a tail cut off in the
middle drop out.  One archive is one partition.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BLOCK = 1 << 20
# Marks and fixed fields of the zip format's headers.
ENTRY, DESCRIPTOR, OTHERS = b"PK\x03\x04", b"PK\x07\x08", (b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x06\x08")
_FIELDS = struct.Struct("<4x2xHH8xI4xHH")  # flags, method, packed size, lengths of name and extra field
STORED, DEFLATED = 0, 8
SIZE_LATER, WIDE = 0x08, 0xFFFFFFFF


class Ended(Exception):
    """The archive is cut off here."""


class Bytes:
    """A stream of which bytes can be taken, looked at and put back."""

    def __init__(self, more: Callable[[int], bytes]):
        self.more, self.held = more, b""

    def some(self, most: int = BLOCK) -> bytes:
        if not self.held:
            return self.more(most)
        out, self.held = self.held[:most], self.held[most:]
        return out

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            part = self.some(min(n, BLOCK))
            if not part:
                raise Ended
            parts.append(part)
            n -= len(part)
        return b"".join(parts)

    def put_back(self, data: bytes) -> None:
        self.held = data + self.held

    def look(self, n: int) -> bytes:
        got = b""
        while len(got) < n and (part := self.some(n - len(got))):
            got += part
        self.put_back(got)
        return got


def _packed_size(extra: bytes, packed: int) -> int:
    """The entry's packed size; that of a large entry stands in its extra field."""
    at = 0
    while packed == WIDE and at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1 and n >= 16:
            return struct.unpack_from("<Q", extra, at + 12)[0]
        at += 4 + n
    return packed


def _inflated(source: Bytes) -> Iterator[bytes]:
    """Blocks of a deflated entry; what follows it stays in the stream."""
    inflate = zlib.decompressobj(-15)
    left = b""
    while not inflate.eof:
        data = left or source.some()
        if not data:
            if out := inflate.flush():
                yield out
            return
        try:
            out = inflate.decompress(data, BLOCK)
        except zlib.error:
            raise Ended from None
        left = inflate.unconsumed_tail
        if out:
            yield out
    source.put_back(inflate.unused_data)


def _stored(source: Bytes, size: int) -> Iterator[bytes]:
    while size:
        data = source.some(min(size, BLOCK))
        if not data:
            return
        size -= len(data)
        yield data


def entries(source: Bytes) -> Iterator[Iterator[bytes]]:
    """The contents of every entry that is no archive and no directory, block by block. Each
    has to be read before the next is asked for; what is left of it is passed over."""
    if source.look(4) and source.look(4)[:2] != b"PK":
        raise ValueError("no zip archive")
    while source.look(4) == ENTRY:
        try:
            flags, method, packed, n_name, n_extra = _FIELDS.unpack(source.exactly(_FIELDS.size))
            name = source.exactly(n_name)
            packed = _packed_size(source.exactly(n_extra), packed)
        except Ended:
            return
        unsized = bool(flags & SIZE_LATER) and not packed
        if flags & 1 or method not in (STORED, DEFLATED):
            if unsized:
                return  # an entry that cannot be read and whose end is not known
            content = iter(())
            for _ in _stored(source, packed):
                pass
        elif method == STORED and source.look(4) == ENTRY and (packed or unsized):
            # An archive stored in this one: its entries follow. Its own directory is passed over.
            yield from entries(source)
            _to_next(source)
            continue
        else:
            content = _inflated(source) if method == DEFLATED else _stored(source, packed)
        try:
            if not name.endswith(b"/"):
                yield content
            for _ in content:
                pass
        except Ended:
            return
        if flags & SIZE_LATER:
            _descriptor(source)


def _descriptor(source: Bytes) -> None:
    """Past the sizes behind an entry: with or without a mark, in 4 or 8 bytes each."""
    if source.look(4) == DESCRIPTOR:
        source.exactly(4)
    at = source.look(16)
    narrow = len(at) < 16 or at[12:16] in (ENTRY, *OTHERS)
    for _ in range(12 if narrow else 20):
        source.some(1)


def _to_next(source: Bytes) -> None:
    """On to the mark of the next entry, past the directory of an archive read already."""
    tail = b""
    while data := source.some():
        data = tail + data
        at = data.find(ENTRY)
        if at >= 0:
            source.put_back(data[at:])
            return
        tail = data[-3:]


def lines(blocks: Iterator[bytes]) -> Iterator[dict]:
    """Objects of the complete JSON lines of an entry."""
    rest: list[bytes] = []
    try:
        for block in blocks:
            first, *more = block.split(b"\n")
            rest.append(first)
            if more:
                yield from _row(b"".join(rest))
                for line in more[:-1]:
                    yield from _row(line)
                rest = [more[-1]]
    except Ended:
        pass
    yield from _row(b"".join(rest))


def _row(line: bytes) -> Iterator[dict]:
    if line.strip():
        try:
            value = json.loads(line)
        except ValueError:
            return
        if isinstance(value, dict):
            yield value


def json_rows(read: Callable[[int], bytes]) -> Iterator[dict]:
    """Objects of all entries of the archive that `read(n)` gives the bytes of."""
    for content in entries(Bytes(read)):
        yield from lines(content)


def _opened(path: str):
    """A stream of a file of any file system that has a mount or is known to pyarrow."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_stream(inner, compression=None)


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType):
        self.paths, self.schema = paths, schema

    def partitions(self) -> list[_Archive]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        kinds = {f.name: f.dataType.typeName() for f in self.schema.fields}
        with _opened(partition.path) as f:
            for row in json_rows(f.read):
                out = []
                for name, kind in kinds.items():
                    v = row.get(name)
                    out.append(json.dumps(v) if kind == "string" and v is not None and not isinstance(v, str) else v)
                yield tuple(out)


class ZippedJsonLines(DataSource):
    """spark.read.format("zipped_json_lines").schema(...).load(path); use `zipped_json_lines`."""

    @classmethod
    def name(cls) -> str:
        return "zipped_json_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader([p for p in self.options["path"].split("\n") if p], schema)


def register(spark) -> None:
    spark.dataSource.register(ZippedJsonLines)


def zipped_json_lines(spark, pattern: str, schema: str):
    """Rows of every archive that the pattern names, in any file system that Spark knows."""
    register(spark)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path) or []
    paths = sorted(s.getPath().toString() for s in found)
    if not paths:
        raise FileNotFoundError(pattern)
    return spark.read.format("zipped_json_lines").schema(schema).load("\n".join(paths))
