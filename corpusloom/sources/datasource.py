"""``spark.read.format("corpusloom_units")``: folders of files as a Python data source, read or streamed.

A partition is a group of neighbouring files of some bytes; a task opens its files one after another and gives the rows that
:func:`files.load` gives. The stream takes the files that have changed since its last offset. Folders are those that pyarrow's file systems
reach (local ones, s3, gs, hdfs with its library); for any store that only Spark reads there is ``load(discover(...))``."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corpusloom.sources import files

#: Bytes of files that a partition holds, about; seconds that a file must be old for the stream, so that none of its time comes later.
GROUP_BYTES, SETTLED = 64_000_000, 1.0


def status_of(path: str, loaders: dict) -> tuple[str | None, str, str]:
    """Why a file is skipped (None: it is read), its extension and its title, as :func:`files.load` has them."""
    name = path.rpartition("/")[2]
    found = re.search(r"[^/.](\.[^./]+)$", path)
    ext = found[1].lower() if found else ""
    title = re.sub(r"(?<=[^/.])\.[^./]+$", "", name).translate(str.maketrans("_-", "  "))
    stem = re.sub(r"\.[^.]*$", "", name).lower()
    hidden = any(part.startswith(".") for part in path.split("/"))
    sensitive = name.lower() in files.SENSITIVE_NAMES or any(p in stem for p in files.SENSITIVE_PARTS)
    return ("skipped_hidden" if hidden else "skipped_sensitive" if sensitive else None if ext in loaders else "skipped_unsupported"), ext, title


@dataclass
class Group(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


class _Folder:
    """What the reader and the stream share. ``options``: path, group_bytes, settled."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.group = int(options.get("group_bytes", GROUP_BYTES))
        self.settled = float(options.get("settled", SETTLED))

    def store(self) -> tuple[stores.FileSystem, str]:
        return stores.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (stores.LocalFileSystem(), self.root)

    def listed(self) -> list[tuple[str, int, int]]:
        """(path below the root, bytes, time in nanoseconds), by path; a missing folder has none."""
        store, base = self.store()
        found = store.get_file_info(stores.FileSelector(base, allow_not_found=True, recursive=True))
        return sorted((f.path.removeprefix(base).lstrip("/"), f.size, f.mtime_ns or 0) for f in found if f.type == stores.FileType.File)

    def groups(self, listed: list[tuple[str, int, int]]) -> list[Group]:
        out, held = [], 0
        for path, size, _ in listed:
            if not out or held + size > self.group:
                out.append(Group([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        store, base = self.store()
        for path in partition.paths:
            skipped, ext, title = status_of(path, files.LOADERS)
            data = None
            if not skipped:
                with store.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
            yield pa.RecordBatch.from_pylist(files.file_rows(path, skipped, ext, title, data, files.LOADERS), schema=files._ARROW)


class UnitsReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Group]:
        return self.groups(self.listed())


class UnitsStream(_Folder, DataSourceStreamReader):
    """Offsets are the latest time of a file that was taken."""

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        now = time.time_ns() - int(self.settled * 1e9)
        return {"until": max((t for _, _, t in self.listed() if t <= now), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        return self.groups([f for f in self.listed() if start["until"] < f[2] <= end["until"]])

    def commit(self, end: dict) -> None:
        pass


class UnitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpusloom_units"

    def schema(self) -> str:
        return files._UNITS

    def reader(self, schema) -> UnitsReader:
        return UnitsReader(self.options)

    def streamReader(self, schema) -> UnitsStream:
        return UnitsStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UnitsSource)
