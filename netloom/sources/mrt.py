"""Spark data source "mrt": TABLE_DUMP_V2 routing tables, raw, gzip or bzip2, told apart by their first bytes.

    spark.dataSource.register(MrtDataSource)
    spark.read.format("mrt").option("table", "routes").load("hdfs://…/rib.bz2")

Options: path (one or several, comma separated, or a folder), table (routes, peers or info), peers (asn@address, comma
separated; "*" for all; by default the collector's two configured sessions), expected_date (YYYY-MM-DD). One task reads
one file as a stream, since records cannot be found from the middle. Any hard error fails the task, so a bad file
publishes nothing.
"""

from __future__ import annotations

import bz2
import datetime
import functools
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Limits and the sessions that are read by default.
MAX_INPUT, MAX_OUTPUT, MAX_RECORD = 1 << 30, 8 << 30, 64 << 20
MAX_PATH, TRANS = 256, 23456
KEPT = frozenset([2, 7, 17, 18])
DEFAULT_PEERS = "3491@123.255.90.244,3491@2001:7fa:0:1::ca28:a0f4"
MULTICAST = frozenset([3, 5, 9, 11])
UNICAST = {2: 4, 4: 6, 8: 4, 10: 6, 6: None, 12: None}
CHUNK, BATCH = 1 << 20, 8192

SCHEMAS = {
    "routes": "file string, seq long, peer_index int, peer_id string, family int, prefix_len int, prefix_key string, path array<bigint>",
    "peers": "file string, peer_index int, peer_id string, asn bigint, address string, family int, selected boolean, observed timestamp",
    "info": "file string, observed timestamp, records long, routes long",
}


class MrtError(ValueError):
    """The file is no table dump that can be read whole."""


def unpacked(chunks: Iterable[bytes], most_in: int = MAX_INPUT, most_out: int = MAX_OUTPUT) -> Iterator[bytes]:
    """The decompressed bytes; an unfinished, empty or damaged compressed stream is an error."""
    source, head, read = iter(chunks), b"", 0

    def more() -> bytes:
        nonlocal read
        c = next(source, b"")
        read += len(c)
        if read > most_in:
            raise MrtError("the input is too large")
        return c

    while len(head) < 4 and (c := more()):
        head += c
    if len(head) < 4:
        raise MrtError("the input is too short")
    make = bz2.BZ2Decompressor if head.startswith(b"BZh") else (lambda: zlib.decompressobj(31)) if head.startswith(b"\x1f\x8b") else None
    many, made, engine, data = make is bz2.BZ2Decompressor, 0, None, head
    while True:
        if not data:
            data = more()
            if not data:
                break
        if make is None:
            out, data = data, b""
        else:
            if engine is None or engine.eof:
                if engine is not None and not many:
                    raise MrtError("bytes follow the compressed stream")
                engine = make()
            try:
                out = engine.decompress(data)
            except (OSError, zlib.error) as e:
                raise MrtError(f"damaged compressed stream: {e}") from e
            data = engine.unused_data
        made += len(out)
        if made > most_out:
            raise MrtError("the decompressed input is too large")
        if out:
            yield out
    if make is not None and not engine.eof:
        raise MrtError("the compressed stream ends early")


class Stream:
    """Exact reads from chunks."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held, self.at = iter(chunks), b"", 0

    def ended(self) -> bool:
        while self.at == len(self.held):
            self.held, self.at = next(self.chunks, None), 0
            if self.held is None:
                self.held = b""
                return True
        return False

    def take(self, n: int) -> bytes:
        parts, missing = [], n
        while missing:
            if self.ended():
                raise MrtError("the file ends within a record")
            part = self.held[self.at : self.at + missing]
            self.at += len(part)
            missing -= len(part)
            parts.append(part)
        return b"".join(parts)


class Fields:
    """Big-endian fields of one record."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise MrtError("a field is cut off")
        return self.data[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def done(self) -> bool:
        return self.at == len(self.data)


def address_text(raw: bytes) -> str:
    """Canonical text of 4 or 16 bytes; never a dotted tail."""
    if len(raw) == 4:
        return ".".join(map(str, raw))
    groups = struct.unpack(">8H", raw)
    runs, at = [], 0
    while at < 8:
        end = at
        while end < 8 and not groups[end]:
            end += 1
        if end - at > 1:
            runs.append((at - end, at, end))
        at = max(end, at + 1)
    text = [f"{g:x}" for g in groups]
    if not runs:
        return ":".join(text)
    _, a, b = min(runs)
    return f"{':'.join(text[:a])}::{':'.join(text[b:])}"


def plain_sequence(raw: bytes) -> list[int] | None:
    """The numbers of a path of plain sequences; null for sets, confederations and anything malformed."""
    out: list[int] = []
    at, plain = 0, True
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        kind, n = raw[at], raw[at + 1]
        end = at + 2 + 4 * n
        if not n or kind not in (1, 2, 3, 4) or end > len(raw):
            return None
        plain &= kind == 2
        out += struct.unpack_from(f">{n}I", raw, at + 2)
        at = end
    return out if plain else None


@functools.lru_cache(1 << 14)
def decode_path(raw: bytes) -> list[int] | None:
    """The AS path of a BGP attribute block, or null where it cannot be one linear path. Blocks repeat from prefix to
    prefix, so the last ones are remembered."""
    at, size, kept = 0, len(raw), {}
    while at < size:
        wide = at + 3 + (raw[at] >> 4 & 1)
        if wide > size:
            raise MrtError("an attribute is cut off")
        kind, end = raw[at + 1], wide + int.from_bytes(raw[at + 2 : wide], "big")
        if end > size:
            raise MrtError("an attribute is cut off")
        if kind in KEPT:
            if kind in kept:
                raise MrtError("a path attribute occurs twice")
            kept[kind] = raw[wide:end]
        at = end
    path = plain_sequence(kept[2]) if 2 in kept else None
    if path is None:
        return None
    if TRANS in path and 17 in kept:
        stale = False
        if 7 in kept and 18 in kept:
            if len(kept[7]) != 8 or len(kept[18]) != 8:
                return None
            stale = int.from_bytes(kept[7][:4], "big") != TRANS
        if not stale:
            wide = plain_sequence(kept[17])
            if wide is None:
                return None
            if 0 < len(wide) <= len(path):
                path[-len(wide) :] = wide
    if not path or 0 in path or TRANS in path:
        return None
    if len(path) > MAX_PATH:
        raise MrtError("an AS path is too long")
    return path


class Dump:
    """One file's records. After iteration: peers, records, observed, routes."""

    def __init__(self, chunks: Iterable[bytes], wanted: str = DEFAULT_PEERS, expected_date: str | None = None):
        self.stream, self.expected = Stream(unpacked(chunks)), expected_date
        self.wanted = None if wanted.strip() == "*" else {w.strip() for w in wanted.split(",")}
        self.peers: list[tuple[str, int, str, int, bool]] | None = None
        self.records = self.routes = 0
        self.observed = 0

    def _records(self) -> Iterator[tuple[int, bytes]]:
        """Subtype and body of each record other than the peer table, which is read; an empty body follows that."""
        while not self.stream.ended():
            stamp, kind, subtype, size = struct.unpack(">IHHI", self.stream.take(12))
            if kind != 13:
                raise MrtError(f"record type {kind} is no table dump")
            if size > MAX_RECORD:
                raise MrtError("a record is too large")
            data = self.stream.take(size)
            if not self.records:
                self.observed = stamp
            self.records += 1
            if subtype == 1:
                self._peer_table(Fields(data))
                yield subtype, b""
            elif self.peers is None:
                raise MrtError("routes come before the peer table")
            else:
                yield subtype, data

    def __iter__(self) -> Iterator[tuple[int, int, str, int, int, str, list[int] | None]]:
        for subtype, data in self._records():
            if subtype in UNICAST:
                yield from self._routes(data, subtype)
            elif subtype not in MULTICAST and subtype != 1:
                raise MrtError(f"subtype {subtype} is not known")
        if self.peers is None:
            raise MrtError("there is no peer table")
        day = datetime.datetime.fromtimestamp(self.observed, datetime.UTC).date().isoformat()
        if self.expected and day != self.expected:
            raise MrtError(f"the file is of {day}, not {self.expected}")
        if not self.routes:
            raise MrtError("no selected session has routes")

    def peer_table(self) -> list[tuple[str, int, str, int, bool]]:
        """The sessions, reading no further than their table."""
        for _ in self._records():
            if self.peers is not None:
                return self.peers
        raise MrtError("there is no peer table")

    def _peer_table(self, f: Fields) -> None:
        if self.peers is not None:
            raise MrtError("there are two peer tables")
        f.take(4)
        f.take(f.uint(2))
        self.peers, seen = [], set()
        for _ in range(f.uint(2)):
            flags = f.uint(1)
            if flags & ~3:
                raise MrtError("unknown peer flags")
            f.take(4)
            address = address_text(f.take(16 if flags & 1 else 4))
            asn = f.uint(4 if flags & 2 else 2)
            name = f"{asn}@{address}"
            if name in seen:
                raise MrtError("a session occurs twice")
            seen.add(name)
            self.peers.append((name, asn, address, 6 if flags & 1 else 4, self.wanted is None or name in self.wanted))
        if not f.done():
            raise MrtError("bytes follow the peer table")

    def _routes(self, data: bytes, subtype: int):
        family, at, size = UNICAST[subtype], 4, len(data)
        if family is None:
            if size < 7:
                raise MrtError("a field is cut off")
            afi, safi = struct.unpack_from(">HB", data, 4)
            if afi not in (1, 2) or safi != 1:
                raise MrtError("unknown address family")
            family, at = (4 if afi == 1 else 6), (11 if subtype == 12 else 7)
        if at >= size:
            raise MrtError("a field is cut off")
        length, width = data[at], 32 if family == 4 else 128
        if length > width:
            raise MrtError("a prefix is too long")
        end = at + 1 + (length + 7) // 8
        if end + 2 > size:
            raise MrtError("a field is cut off")
        key = int.from_bytes(data[at + 1 : end].ljust(width // 8, b"\0"), "big") >> (width - length) << (width - length)
        text, at, skip = f"{key:0{width // 4}x}", end + 2, 10 if subtype in (8, 10) else 6
        for _ in range(data[end] << 8 | data[end + 1]):
            start = at + skip + 2
            if start > size:
                raise MrtError("a field is cut off")
            index, attributes = data[at] << 8 | data[at + 1], data[start - 2] << 8 | data[start - 1]
            at = start + attributes
            if at > size:
                raise MrtError("a field is cut off")
            if index >= len(self.peers):
                raise MrtError("a route names an unknown peer")
            if self.peers[index][4]:  # attributes of other sessions are never decoded
                self.routes += 1
                yield self.routes, index, self.peers[index][0], family, length, text, decode_path(data[start:at])
        if at != size:
            raise MrtError("bytes follow a record")


def opened(path: str) -> Iterator[bytes]:
    """A file's bytes in chunks, from any store that Arrow reaches."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(inner, compression=None) as f:
        while chunk := f.read(CHUNK):
            yield bytes(chunk)


def listed(path: str) -> list[str]:
    from pyarrow import fs

    out = []
    for p in filter(None, (x.strip() for x in path.split(","))):
        scheme = p[: p.index("://") + 3] if "://" in p else ""
        system, inner = fs.FileSystem.from_uri(p) if scheme else (fs.LocalFileSystem(), p)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        files = [info.path] if info.is_file else sorted(i.path for i in system.get_file_info(fs.FileSelector(inner)) if i.is_file and not i.base_name.startswith((".", "_")))
        out += [p if info.is_file else p.rstrip("/") + "/" + f.rsplit("/", 1)[1] for f in files]
    return out


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class MrtReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options = {k.lower(): v for k, v in options.items()}
        self.table, self.schema = self.options.get("table", "routes"), schema
        if not self.options.get("path"):
            raise MrtError("the path is missing")

    def partitions(self):
        return [File(p) for p in listed(self.options["path"])]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        dump = Dump(opened(partition.path), self.options.get("peers", DEFAULT_PEERS), self.options.get("expected_date"))
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        stamp = lambda: datetime.datetime.fromtimestamp(dump.observed, datetime.UTC)
        if self.table == "peers":  # the table stands before all routes; the rest is checked where the routes are read
            if rows := [(partition.path, i, *p, stamp()) for i, p in enumerate(dump.peer_table())]:
                yield batch(rows)
            return
        rows = []
        for r in dump:
            if self.table == "routes":
                rows.append((partition.path, *r))
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
        if self.table == "info":
            rows = [(partition.path, stamp(), dump.records, dump.routes)]
        if rows:
            yield batch(rows)


class MrtDataSource(DataSource):
    @classmethod
    def name(cls):
        return "mrt"

    def schema(self):
        return SCHEMAS[self.options.get("table", "routes")]

    def reader(self, schema):
        return MrtReader(dict(self.options), schema)

    def streamReader(self, schema):
        from netloom.streaming.rib_files import RibFiles

        return RibFiles(dict(self.options), schema)
