"""``calllog``: a log of JSON lines as a Spark data source, for batches and streams, with writes that are seen whole or not at all.

Reading gives (file, offset, value, bad): every non-blank line with its place in bytes, and whether it is no JSON; ``bad_lines``
counts those by file. A batch is cut into ranges of bytes, so a large file is many tasks. A stream's offset is how far each
file has been read, always the end of a line, so a line that is still being written is read when it is whole.

Writing is in two phases: tasks write files that nobody reads yet and tell the driver their names; the driver then writes one
manifest, and moves it into place. Readers of a log with manifests read what these list. Files of a job that stopped before
are left aside, a stream's batch that comes again after its manifest is there changes nothing, and a new manifest never
touches an earlier file. Folders without manifests are read whole, as other writers leave them.

Paths are those of pyarrow's file systems; what only Spark's own readers can open needs ``readers.read_jsonl``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from calltide.session import ship

READ_SCHEMA = "file string, offset long, value string, bad boolean"
RANGE_BYTES = 64 << 20
MANIFESTS = "_manifests"
_BLOCK = 1 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return system, inner.rstrip("/")


def log_files(path: str) -> dict[str, int]:
    """Names and bytes of the log's files: those that manifests list, or all of a folder without any."""
    system, base = _open(path)
    if system.get_file_info(f"{base}/{MANIFESTS}").type == pafs.FileType.Directory:
        found = {}
        for info in system.get_file_info(pafs.FileSelector(f"{base}/{MANIFESTS}")):
            if info.base_name.endswith(".json"):
                with system.open_input_stream(info.path) as f:
                    found |= json.loads(f.read())["files"]
        return found
    infos = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return {i.base_name: i.size for i in infos if i.is_file and not i.base_name.startswith(("_", ".")) and i.base_name.endswith((".jsonl", ".json", ".txt"))}


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _cut(file: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(file, a, min(end, a + size)) for a in range(start, end, size)]


def _lines(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in the range; the last may end beyond it."""
    system, base = _open(path)
    with system.open_input_file(f"{base}/{part.file}") as f:
        at = part.start
        if at:
            f.seek(at - 1)
            at = part.start - 1
            head, skipping = f.read(_BLOCK), True
        else:
            head, skipping = f.read(_BLOCK), False
        pending = b""
        while head:
            pending += head
            *whole, pending = pending.split(b"\n")
            for line in whole:
                begin, at = at, at + len(line) + 1
                if skipping:
                    skipping = False  # the rest of a line that begins before the range
                elif begin < part.end:
                    yield begin, line
                else:
                    return
            if at >= part.end and not skipping:
                return
            head = f.read(_BLOCK)
        if pending and not skipping and at < part.end:
            yield at, pending


def _is_json(line: bytes) -> bool:
    try:
        json.loads(line)
        return True
    except ValueError:
        return False


class _Read:
    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of an empty log Spark makes one partition itself
            return

        def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            values = [line.decode("utf-8", "replace") for _, line in rows]
            columns = [pa.array([partition.file] * len(rows), pa.string()), pa.array([o for o, _ in rows], pa.int64()), pa.array(values, pa.string()), pa.array([not _is_json(line) for _, line in rows], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["file", "offset", "value", "bad"])

        rows: list[tuple[int, bytes]] = []
        held = 0
        for offset, line in _lines(self.path, partition):
            if line.strip():
                rows.append((offset, line))
                held += len(line)
            if held > _BLOCK or len(rows) >= 4096:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


class LogReader(_Read, DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        return [r for name, n in sorted(log_files(self.path).items()) for r in _cut(name, 0, n, self.size)]


class LogStream(_Read, DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {name: end for name, n in sorted(log_files(self.path).items()) if (end := self._whole(name, n))}

    def _whole(self, name: str, size: int) -> int:
        """Where the file's last whole line ends."""
        system, base = _open(self.path)
        with system.open_input_file(f"{base}/{name}") as f:
            end = size
            while end > 0:
                begin = max(0, end - _BLOCK)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [r for name, upto in sorted(end.items()) for r in _cut(name, start.get(name, 0), upto, self.size)]

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    file: str
    size: int


class _Write:
    """Rows as JSON lines, in one file a task that only a manifest makes part of the log."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.names, self.overwrite = path, schema.names, overwrite
        system, base = _open(path)
        # from now on the log is what its manifests say, beginning with the files that are there
        if system.get_file_info(f"{base}/{MANIFESTS}").type != pafs.FileType.Directory:
            there = log_files(path)
            self._manifest(f"0-{uuid.uuid4().hex}", there)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, base = _open(self.path)
        name, size = f"part-{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(f"{base}/{name}") as f:
            for row in rows:
                line = json.dumps(dict(zip(self.names, row, strict=True)), ensure_ascii=False, default=str).encode() + b"\n"
                f.write(line)
                size += len(line)
        return Written(name, size)

    def _manifest(self, name: str, files: dict[str, int]) -> None:
        system, base = _open(self.path)
        system.create_dir(f"{base}/{MANIFESTS}", recursive=True)
        made = f"{base}/{MANIFESTS}/.{uuid.uuid4().hex}"
        with system.open_output_stream(made) as f:
            f.write(json.dumps({"files": files}).encode())
        system.move(made, f"{base}/{MANIFESTS}/{name}.json")

    def _commit(self, name: str, messages: list[Written | None]) -> None:
        system, base = _open(self.path)
        old = [i.path for i in system.get_file_info(pafs.FileSelector(f"{base}/{MANIFESTS}")) if i.base_name.endswith(".json")] if self.overwrite else []
        self._manifest(name, {m.file: m.size for m in messages if m and m.size})
        for path in old:
            system.delete_file(path)

    def _abort(self, messages: list[Written | None]) -> None:
        system, base = _open(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{base}/{m.file}")


class LogWriter(_Write, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(f"1-{uuid.uuid4().hex}", messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class LogStreamWriter(_Write, DataSourceStreamWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, query: str):
        super().__init__(path, schema, overwrite)
        self.query = query

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        system, base = _open(self.path)
        name = f"2-{self.query}-{batchId}"
        if system.get_file_info(f"{base}/{MANIFESTS}/{name}.json").type == pafs.FileType.NotFound:
            self._commit(name, messages)
        else:  # the batch was written before the query stopped
            self._abort(messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._abort(messages)


class CallLog(DataSource):
    """Options: path; rangeBytes (reading); query (streams that write: a name that stays the same over restarts)."""

    @classmethod
    def name(cls) -> str:
        return "calllog"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LogReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogStream(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return LogWriter(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return LogStreamWriter(self.options["path"], schema, False, self.options["query"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(CallLog)


def bad_lines(log: DataFrame) -> DataFrame:
    """(file, lines, bad) of a log that was read."""
    return log.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("bad"))


def fields(log: DataFrame, schema: str) -> DataFrame:
    """The good lines' fields by a schema, with file and offset."""
    return log.where("NOT bad").select("file", "offset", F.from_json("value", schema).alias("r")).select("file", "offset", "r.*")
