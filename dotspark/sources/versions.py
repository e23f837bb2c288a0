"""Data sources: tables in versions with one pointer to the current one, and line logs that streams read by offset.

Both live in a folder that driver and executors share and that has atomic links and renames (a mounted file system).
``register`` makes them known to a session as formats ``versioned`` and ``linelog``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a log that one task reads.
BLOCK = 64 << 20


def register(spark: SparkSession) -> None:
    for source in (VersionedTable, LineLog):
        spark.dataSource.register(source)


def local(path: str) -> str:
    """The path of a mounted folder, with or without ``file:``."""
    return path.removeprefix("file://").removeprefix("file:").rstrip("/")


@dataclass
class Part(InputPartition):
    path: str
    start: int = 0
    end: int = 0


@dataclass
class Written(WriterCommitMessage):
    path: str | None


# --- versions -------------------------------------------------------------------------------------------------


def manifests(root: str) -> dict[int, str]:
    """Version numbers and their manifests."""
    folder = f"{root}/manifests"
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return {int(n[1:-5]): f"{folder}/{n}" for n in names if n.startswith("v") and n.endswith(".json")}


def current(root: str, version: int | None = None) -> dict | None:
    """The manifest of a version, the latest if none is named: number, schema and parts."""
    known = manifests(local(root))
    if not known:
        return None
    with open(known[max(known) if version is None else version]) as f:
        return json.load(f)


class VersionedTable(DataSource):
    """Parquet parts and a manifest per version. Overwriting puts a new version in place of the current one; readers
    of older versions go on undisturbed. Of writers that start from one version the first to commit wins."""

    @classmethod
    def name(cls) -> str:
        return "versioned"

    def _manifest(self) -> dict:
        version = self.options.get("version")
        found = current(self.options["path"], int(version) if version else None)
        if found is None:
            raise FileNotFoundError(f"no version of a table in {self.options['path']}")
        return found

    def schema(self) -> StructType:
        return StructType.fromJson(self._manifest()["schema"])

    def reader(self, schema: StructType) -> VersionReader:
        return VersionReader(self._manifest()["parts"])

    def writer(self, schema: StructType, overwrite: bool) -> VersionWriter:
        return VersionWriter(local(self.options["path"]), schema, overwrite)


class VersionReader(DataSourceReader):
    def __init__(self, parts: list[str]) -> None:
        self.parts = parts

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self.parts] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from pq.ParquetFile(partition.path).iter_batches()


class VersionWriter(DataSourceArrowWriter):
    """Tasks write parts under a name of their own; committing links the manifest to the next number, which one writer can do."""

    def __init__(self, root: str, schema: StructType, overwrite: bool) -> None:
        self.root, self.schema, self.overwrite = root, schema.jsonValue(), overwrite
        self.base = max(manifests(root), default=0)
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        path, writer = f"{self.root}/parts/{self.job}/{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if writer is None:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                writer = pq.ParquetWriter(path, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
        return Written(path if writer is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        kept = [] if self.overwrite or not self.base else current(self.root, self.base)["parts"]
        number = self.base + 1
        manifest = {"version": number, "schema": self.schema, "parts": kept + sorted(m.path for m in messages if m and m.path)}
        os.makedirs(f"{self.root}/manifests", exist_ok=True)
        draft = f"{self.root}/manifests/.{self.job}"
        with open(draft, "w") as f:
            json.dump(manifest, f)
        try:
            os.link(draft, f"{self.root}/manifests/v{number:010d}.json")
        except FileExistsError:
            raise RuntimeError(f"version {number} of {self.root} was committed by another writer; nothing was changed") from None
        finally:
            os.unlink(draft)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.unlink(m.path)


# --- logs -----------------------------------------------------------------------------------------------------


def log_files(root: str) -> list[str]:
    return sorted(f"{root}/{n}" for n in (os.listdir(root) if os.path.isdir(root) else []) if n.endswith(".jsonl"))


def whole_lines(path: str) -> int:
    """The place behind the last line end: what is there of a line that is still being written does not count."""
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        at = end
        while at > 0:
            start = max(0, at - 4096)
            f.seek(start)
            cut = f.read(at - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            at = start
    return 0


def lines_of(path: str, start: int, end: int) -> Iterator[tuple[str, int, str]]:
    """(file, place, line) of the lines that begin in a stretch of bytes; bytes that are no text are replaced."""
    with open(path, "rb") as f:
        at = start
        if start:
            f.seek(start - 1)
            at = start - 1 + len(f.readline())  # the rest of a line that began before
        while at < end:
            line = f.readline()
            if not line:
                break
            yield os.path.basename(path), at, line.rstrip(b"\r\n").decode(errors="replace")
            at += len(line)


def blocks(path: str, start: int, end: int) -> list[Part]:
    return [Part(path, at, min(at + BLOCK, end)) for at in range(start, end, BLOCK)]


class LineLog(DataSource):
    """An append-only folder of line files: ``file``, ``place`` and ``value`` of each line. Batches split large files,
    streams read what came behind the offset of each file, and appended files show when their job commits."""

    @classmethod
    def name(cls) -> str:
        return "linelog"

    def schema(self) -> str:
        return "file string, place long, value string"

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(local(self.options["path"]))

    def streamReader(self, schema: StructType) -> LogStream:  # noqa: N802
        return LogStream(local(self.options["path"]))

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is appended to, never overwritten")
        return LogWriter(local(self.options["path"]), schema.fieldNames().index("value"))


class LogReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[Part]:
        return [b for path in log_files(self.root) for b in blocks(path, 0, os.path.getsize(path))] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        return lines_of(partition.path, partition.start, partition.end) if partition.path else iter(())


class LogStream(DataSourceStreamReader):
    """Offsets are the bytes read of each file."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {"bytes": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"bytes": {os.path.basename(p): whole_lines(p) for p in log_files(self.root)}}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [b for name, to in end["bytes"].items() for b in blocks(f"{self.root}/{name}", start["bytes"].get(name, 0), to)]

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        return lines_of(partition.path, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        pass


class LogWriter(DataSourceWriter):
    def __init__(self, root: str, column: int) -> None:
        self.root, self.column = root, column

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.root, exist_ok=True)
        path = f"{self.root}/.{uuid.uuid4().hex}"
        with open(path, "w", newline="\n") as f:
            for row in iterator:
                f.write((row[self.column] or "").replace("\n", " ") + "\n")
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.path:
                if os.path.getsize(m.path):
                    os.rename(m.path, f"{self.root}/part-{os.path.basename(m.path)[1:]}.jsonl")
                else:
                    os.unlink(m.path)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.unlink(m.path)
