"""A data source of file heads: name, size and the first bytes of every file under a folder; nothing else of a file is read."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD_BYTES = 4096
FILES_PER_TASK = 500
SCHEMA = "path string, length long, head binary"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI; a bare path is a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FileHeads(DataSource):
    """format("file_heads"): options path, bytes (HEAD_BYTES) and files (FILES_PER_TASK). A file that goes meanwhile gives no row."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("bytes", HEAD_BYTES)), int(self.options.get("files", FILES_PER_TASK)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, head: int, files: int):
        self.path, self.head, self.files = path, head, files

    def partitions(self) -> list[InputPartition]:
        """Names only; hidden files and folders are skipped, as by Spark's own readers."""
        system, root = _opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(part[:1] in ("_", ".") for part in posixpath.relpath(p, root).split("/") if part != ".")
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and not hidden(f.path))
        return [Files(paths[a : a + self.files]) for a in range(0, len(paths), self.files)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        rows: tuple[list, list, list] = ([], [], [])
        for info in system.get_file_info(partition.value):
            if info.type != fs.FileType.File:
                continue
            with system.open_input_file(info.path) as f:
                for column, x in zip(rows, (info.path, info.size, f.read(self.head)), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["path", "length", "head"])


def read_heads(spark: SparkSession, path: str, head: int = HEAD_BYTES, files: int = FILES_PER_TASK) -> DataFrame:
    """path, length, head of every file under `path`."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("path", path).option("bytes", head).option("files", files).load()
