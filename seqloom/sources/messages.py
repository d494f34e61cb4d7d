"""Messages of live sessions as a data source: batch scan, stream with offsets, and sink.

A folder holds files of messages, whose names rise with their arrival; each file is a run of records, a header of fixed
size before each payload. A file is one partition. A stream's offset is the name of the last file that it has seen: files
stay where they are, so that a query that starts again from its checkpoint reads what it had not finished, and nothing
else. The sink's tasks write files that nobody sees; the driver gives them their names when all are there."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "session long, seq long, at timestamp, kind string, pcm binary"
#: session, seq (-1: none), arrival in microseconds, bytes of the kind, bytes of the payload.
HEADER = "<qqqHI"
HEADER_SIZE = struct.calcsize(HEADER)
ENDING = ".messages"
TESTS = {EqualTo: lambda v, w: v == w, In: lambda v, w: v in w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _names(path: str) -> list[str]:
    """Names of the folder's files, the oldest first."""
    store, folder = _store(path)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(ENDING))


@dataclass
class MessageFile(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    name: str | None


@dataclass(frozen=True)
class Condition:
    """A pushed filter on session or seq."""

    column: str
    test: type
    value: object

    def holds(self, session: int, seq: int | None) -> bool:
        v = session if self.column == "session" else seq
        return v is not None and TESTS[self.test](v, self.value)


def records(path: str, name: str, conditions: list[Condition], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A file's messages in batches; payloads of those that a condition leaves out are passed over."""
    store, folder = _store(path)
    schema = pa.schema([("session", pa.int64()), ("seq", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("kind", pa.string()), ("pcm", pa.binary())])
    held, held_bytes = [], 0
    with store.open_input_file(f"{folder}/{name}") as f:
        while len(head := f.read(HEADER_SIZE)) == HEADER_SIZE:
            session, seq, at, kind, n = struct.unpack(HEADER, head)
            seq = None if seq < 0 else seq
            if not all(c.holds(session, seq) for c in conditions):
                f.seek(kind + n, 1)
                continue
            body = f.read(kind + n)
            held.append((session, seq, at, body[:kind].decode(), body[kind:]))
            held_bytes += n
            if len(held) >= rows or held_bytes >= size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


class MessageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.conditions = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of session and seq with values are done here; the others are left to Spark."""
        for f in filters:
            if type(f) in TESTS and f.attribute in (("session",), ("seq",)) and f.value is not None:
                self.conditions.append(Condition(f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [MessageFile(n) for n in _names(self.path)] or [MessageFile("")]

    def read(self, partition: MessageFile) -> Iterator[pa.RecordBatch]:
        return records(self.path, partition.name, self.conditions) if partition.name else iter(())


class MessageStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, most_files: int):
        self.path, self.most_files, self.seen = path, most_files, ""

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        """At most `most_files` files further than the offset before."""
        ahead = [n for n in _names(self.path) if n > self.seen]
        if ahead:
            self.seen = ahead[min(self.most_files, len(ahead)) - 1]
        return {"file": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = max(self.seen, end["file"])
        return [MessageFile(n) for n in _names(self.path) if start["file"] < n <= end["file"]]

    def read(self, partition: MessageFile) -> Iterator[pa.RecordBatch]:
        return records(self.path, partition.name, [])

    def commit(self, end: dict) -> None:
        pass


class MessageWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        name, out = f"_{uuid.uuid4().hex}", None
        try:
            for r in iterator:
                out = out or store.open_output_stream(f"{folder}/{name}")
                kind, pcm = (r["kind"] or "pcm").encode(), bytes(r["pcm"] or b"")
                at = r["at"]
                out.write(struct.pack(HEADER, r["session"], -1 if r["seq"] is None else r["seq"], 0 if at is None else int(pa.scalar(at, pa.timestamp("us", "UTC") if at.tzinfo else pa.timestamp("us")).value), len(kind), len(pcm)) + kind + pcm)
        finally:
            if out:
                out.close()
        return Written(name if out else None)

    def commit(self, messages: list[Written | None]) -> None:
        """Files of one write follow those that are there, in the order of their tasks."""
        store, folder = _store(self.path)
        there = _names(self.path)
        first = int(there[-1].split("-")[0]) + 1 if there else 0
        for k, m in enumerate(messages):
            if m is not None and m.name:
                store.move(f"{folder}/{m.name}", f"{folder}/{first:012d}-{k:06d}{ENDING}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{folder}/{m.name}")


class MessageSource(DataSource):
    """spark.read / readStream / write with format("session_messages"). Options: path, and for streams filesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "session_messages"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("session_messages needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> DataSourceReader:
        return MessageReader(self._path())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return MessageStreamReader(self._path(), int(self.options.get("filesPerBatch", "1000000")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("messages are appended, not overwritten")
        return MessageWriter(self._path())


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets Spark push filters into sources of this kind."""
    spark.dataSource.register(MessageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
