"""Playback captures: a Python data source, a writer, and the header as columns.

A record is a text header with fields between slashes, then the payload and a line feed:
`*M*E*T*A*S*T*A*R*T*/hint/length/ip/port/HH:MM:SS.mmm/epoch.micros//*M*E*T*A*E*N*D*`. Readers go on by the length in the header, so that payloads
may hold line feeds or the marker. Large plain files are split: a split begins at the first marker in it from which two
records in a row (or the file's end) can be read. Packed files (.gz) are one split. Whole files pass a worker in pieces.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format.
START, END = b"*M*E*T*A*S*T*A*R*T*", b"*M*E*T*A*E*N*D*"
HEADER = re.compile(re.escape(START) + rb"/([^/]*)/(\d+)/([^/]*)/([^/]*)/([^/]*)/([^/]*)//" + re.escape(END))
SCHEMA = "path string, offset long, hint string, ip string, port string, time_str string, time string, header_size int, payload_size int, msg binary, payload binary"
SPLIT = 64 << 20
LONGEST_HEADER = 512
#: Bytes of a file that a worker takes at once, and about those of the records that it gives back at once.
PIECE = 1 << 20


class BadRecord(ValueError):
    pass


def record_at(data: bytes, at: int) -> tuple[re.Match, int] | None:
    """The header at this place and the place after its record; None if the record is not whole."""
    m = HEADER.match(data, at)
    if not m:
        return None
    end = m.end() + int(m[2])
    return (m, end) if end <= len(data) else None


def parse(data: bytes, path: str, offset: int = 0, strict: bool = True) -> Iterator[tuple]:
    """Records of a buffer that begins with one. A cut-off last record ends the input; anything else raises with its offset."""
    at = 0
    while at < len(data):
        found = record_at(data, at)
        if found is None:
            if strict and not (START.startswith(data[at : at + len(START)]) or data.startswith(START, at)):
                raise BadRecord(f"{path}: no record at offset {offset + at}")
            return
        m, end = found
        hint, _, ip, port, clock, epoch = (x.decode("ascii", "replace") for x in m.groups())
        yield path, offset + at, hint, ip, port, clock, epoch, m.end() - at, end - m.end(), data[at:end], data[m.end() : end]
        at = end + (data[end : end + 1] == b"\n")


def parse_pieces(pieces: Iterable[bytes], path: str) -> Iterator[tuple]:
    """The records that parse() finds in all pieces together; no more is held than the piece and the record at hand."""
    held, base, need, ended = bytearray(), 0, 1, False
    for piece in pieces:
        held += piece
        if ended and held:  # the line feed after a record that ended with its piece
            skip = held.startswith(b"\n")
            del held[:skip]
            base, ended = base + skip, False
        if len(held) < need:
            continue
        data, at = bytes(held), 0
        for row in parse(data, path, base):
            yield row
            end = row[1] - base + len(row[9])
            at, ended = end + (data[end : end + 1] == b"\n"), end == len(data)
        held, base = bytearray(data[at:]), base + at
        m = HEADER.match(held)
        if not m and held.count(b"/") > 8:  # a header has 8: this one is broken, which ends the input
            return
        need = m.end() + int(m[2]) if m else len(held) + 1


class _Pieces(io.RawIOBase):
    """Pieces as a file to read."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.left = iter(pieces), memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.left:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.left = memoryview(piece)
        n = min(len(out), len(self.left))
        out[:n], self.left = self.left[:n], self.left[n:]
        return n


def unpacked(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a .gz file, in pieces as well."""
    with gzip.open(io.BufferedReader(_Pieces(pieces))) as f:
        yield from iter(partial(f.read, PIECE), b"")


class _Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


class PlaybackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"].removeprefix("file://"), int(options.get("splitbytes", SPLIT))

    def files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(f for f in glob.glob(f"{self.path}/**", recursive=True) if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))
        return sorted(glob.glob(self.path))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.files():
            if path.endswith(".gz"):
                out.append(_Part(path, 0, None))
            else:
                size = os.path.getsize(path)
                out += [_Part(path, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        return out or [_Part("", 0, None)]

    def read(self, part: _Part) -> Iterator[tuple]:
        if not part.path:
            return
        if part.stop is None:
            with gzip.open(part.path, "rb") as f:
                yield from parse_pieces(iter(partial(f.read, PIECE), b""), part.path)
            return
        size = os.path.getsize(part.path)
        with open(part.path, "rb") as f:
            at = 0 if part.start == 0 else self._resync(f, part.start, part.stop, size)
            while at is not None and at < part.stop:
                data = self._record(f, at, size)
                if data is None:
                    raise BadRecord(f"{part.path}: no record at offset {at}")
                rows = list(parse(data, part.path, at))
                if not rows:
                    return
                yield rows[0]
                at += len(rows[0][9])
                f.seek(at)
                at += f.read(1) == b"\n"

    @staticmethod
    def _record(f: io.BufferedReader, at: int, size: int) -> bytes | None:
        """The bytes of the record at a place; b'' or a stump at the file's cut-off end, None if there is none."""
        f.seek(at)
        head = f.read(LONGEST_HEADER)
        m = HEADER.match(head)
        if not m:
            return head if len(head) < LONGEST_HEADER and (START.startswith(head) or head.startswith(START)) else None
        end = at + m.end() + int(m[2])
        if end > size:
            return b""
        f.seek(at)
        return f.read(end - at)

    def _resync(self, f: io.BufferedReader, start: int, stop: int, size: int) -> int | None:
        f.seek(start)
        window = f.read(stop - start + len(START))
        at = window.find(START)
        while at != -1 and start + at < stop:
            if self._chain(f, start + at, size):
                return start + at
            at = window.find(START, at + 1)
        return None

    def _chain(self, f: io.BufferedReader, at: int, size: int) -> bool:
        """Whether two records, or one and the file's end, begin here; the byte before must end a record."""
        f.seek(at - 1)
        if f.read(1) != b"\n":
            return False
        for _ in range(2):
            data = self._record(f, at, size)
            if not data:
                return data == b""
            at += len(data)
            f.seek(at)
            at += f.read(1) == b"\n"
            if at >= size:
                return True
        return True


class PlaybackSource(DataSource):
    """spark.read.format("playback").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "playback"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PlaybackReader(self.options)


def read_playback(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Captures on a file system that the workers can open."""
    spark.dataSource.register(PlaybackSource)
    return spark.read.format("playback").option("splitbytes", str(split)).load(path)


def read_playback_files(spark: SparkSession, path: str) -> DataFrame:
    """Captures of up to 2 GB each in any store that Spark reads. The JVM holds one file for each task, a Python worker a batch of pieces (see PIECE)."""

    def run(batches):
        pieces = ((name.as_py(), piece.as_py()) for batch in batches for name, piece in zip(batch["path"], batch["piece"]))
        files = ((name, (piece for _, piece in group)) for name, group in groupby(pieces, lambda x: x[0]))
        return _arrow_batches(row for name, file in files for row in parse_pieces(unpacked(file) if name.endswith(".gz") else file, name))

    files = spark.read.format("binaryFile").load(path)
    places = F.sequence(F.lit(0), F.expr(f"int((length - 1) div {PIECE})"))
    pieces = files.select("path", "content", F.explode(places).alias("k")).select("path", F.substring("content", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    return pieces.mapInArrow(run, SCHEMA)


def _arrow_batches(rows: Iterable[tuple]) -> Iterator:
    """Rows of SCHEMA as Arrow batches of about PIECE bytes of messages and 10,000 rows at most."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[kind]) for n, kind in map(str.split, SCHEMA.split(", "))])

    def batch(some):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some), schema)], schema=schema)

    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[9])
        if size >= PIECE or len(some) == 10_000:
            yield batch(some)
            some, size = [], 0
    if some:
        yield batch(some)


def record(payload: Column, ip: Column, port: Column, clock: Column, epoch: Column, hint: str = "A") -> Column:
    """A record's bytes, without the line feed after it."""
    lead = F.concat_ws("/", F.lit(START.decode()), F.lit(hint), F.octet_length(payload).cast("string"), ip, port, clock, epoch, F.lit(""), F.lit(END.decode()))
    return F.concat(lead.cast("binary"), payload.cast("binary"))


def header_columns(raw: Column) -> dict[str, Column]:
    """hint, length, ip, port, time_str and time_num of a record, by splitting its header."""
    head = F.decode(F.substring(raw, F.lit(1), F.lit(LONGEST_HEADER)), "ISO-8859-1")
    names = ("hint", "length", "ip", "port", "time_str", "time_num")
    return {n: F.split_part(head, F.lit("/"), F.lit(k)) for k, n in enumerate(names, 2)}


def markup(frame: DataFrame) -> DataFrame:
    """An index that leaves the capture where it is: (path, offset, size) of each message in place of its bytes."""
    return frame.select("path", "offset", (F.col("header_size") + F.col("payload_size")).alias("size"), "ip", "port", "time")


def dereference(marks: DataFrame) -> DataFrame:
    """Adds `msg`, read from the files that markup() points at (plain files that the workers can open)."""

    def run(batches):
        for pdf in batches:
            out = []
            handles: dict[str, io.BufferedReader] = {}
            for path, offset, size in zip(pdf["path"], pdf["offset"], pdf["size"]):
                f = handles.get(path) or handles.setdefault(path, open(path, "rb"))
                f.seek(offset)
                out.append(f.read(size))
            for f in handles.values():
                f.close()
            yield pdf.assign(msg=out)

    schema = ", ".join(f"`{n}` {t}" for n, t in marks.dtypes) + ", msg binary"
    return marks.mapInPandas(run, schema)
