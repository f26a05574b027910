"""Media folders as a Spark data source that keeps names Spark's own listing leaves out, such as `_name.mkv`.

    spark.dataSource.register(MediaFolder)
    spark.read.format("media_folder").load("/media")            # one listing
    spark.readStream.format("media_folder").load("/media")      # a listing for every trigger

Folders are read where tasks run, so they have to be mounted on every executor, as the nodes' mounts are.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from mediacat.operators.scan import media_only

#: Folders this deep below the root, and what lies below them, are a task each.
DEPTH = 2
SCHEMA = "path string, size bigint, mtime_s bigint, scan_s bigint"


class Folder(InputPartition):
    def __init__(self, path: str, whole: bool, scan_s: int):
        super().__init__((path, whole, scan_s))
        self.path, self.whole, self.scan_s = path, whole, scan_s


def _entries(path: str) -> list[os.DirEntry]:
    """What is in a folder, in order; nothing if it has gone."""
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _folders(root: str, depth: int, scan_s: int) -> list[Folder]:
    out, level = [], [root]
    for _ in range(depth):
        out += [Folder(path, False, scan_s) for path in level]
        level = [e.path for path in level for e in _entries(path) if e.is_dir(follow_symlinks=False)]
    return out + [Folder(path, True, scan_s) for path in level]


def _files(folder: Folder) -> Iterator[tuple]:
    waiting = [folder.path]
    while waiting:
        for entry in _entries(waiting.pop()):
            try:
                if entry.is_dir(follow_symlinks=False):
                    waiting += [entry.path] if folder.whole else []
                elif entry.is_file():
                    facts = entry.stat()
                    yield entry.path, facts.st_size, int(facts.st_mtime), folder.scan_s
            except OSError:  # gone since the folder was listed
                continue


class _Listing(DataSourceReader):
    def __init__(self, root: str, depth: int):
        self.root, self.depth = root, depth

    def partitions(self) -> list[InputPartition]:
        return _folders(self.root, self.depth, int(time.time()))

    def read(self, partition: Folder) -> Iterator[tuple]:
        return _files(partition)


class _Watch(DataSourceStreamReader):
    """Every trigger lists all folders anew; the offset is the time of the listing."""

    def __init__(self, root: str, depth: int):
        self.root, self.depth = root, depth

    def initialOffset(self) -> dict:
        return {"scan_s": 0}

    def latestOffset(self) -> dict:
        return {"scan_s": int(time.time())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _folders(self.root, self.depth, end["scan_s"])

    def read(self, partition: Folder) -> Iterator[tuple]:
        return _files(partition)


class MediaFolder(DataSource):
    """Files below `path`: path, size, mtime_s, scan_s. Option depth: see DEPTH."""

    @classmethod
    def name(cls) -> str:
        return "media_folder"

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple[str, int]:
        return self.options["path"].removeprefix("file://").rstrip("/") or "/", int(self.options.get("depth", DEPTH))

    def reader(self, schema) -> DataSourceReader:
        return _Listing(*self._arguments())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Watch(*self._arguments())


def media_listing(spark: SparkSession, watch_path: str, depth: int = DEPTH) -> DataFrame:
    """Video files below a mounted folder, names with `_` included: path, size, mtime_s."""
    spark.dataSource.register(MediaFolder)
    files = spark.read.format("media_folder").option("depth", depth).load(watch_path)
    return media_only(files.select("path", "size", "mtime_s"))


def watched_folder(spark: SparkSession, watch_path: str, depth: int = DEPTH) -> DataFrame:
    """All video files of a mounted folder at each trigger, for `arrivals`; trigger at the scan interval."""
    spark.dataSource.register(MediaFolder)
    return media_only(spark.readStream.format("media_folder").option("depth", depth).load(watch_path))
