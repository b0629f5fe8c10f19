"""A data source of the first bytes of files: path, bytes (the file's size) and head, which is unpacked if the name ends as that of a compressed file. The rest of a file isn't read."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Files that one task opens.
FILES = 256


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"].rstrip("/"), options.get("glob", "*")
        self.size, self.most = int(options.get("head", 20000)), int(options.get("most", 1 << 62))

    def partitions(self) -> list[_Files]:
        fs, base = FileSystem.from_uri(self.root)
        found = [(f.path[len(base) :], f.size) for f in fs.get_file_info(FileSelector(base, recursive=True)) if f.type == FileType.File]
        # Names that begin with _ or . are Spark's own, as in its other sources.
        kept = sorted(f for f in found if f[1] <= self.most and fnmatch.fnmatch(f[0].rpartition("/")[2].lower(), self.glob.lower()) and not any(p[:1] in ("_", ".") for p in f[0].split("/")[1:]))
        return [_Files(kept[k : k + FILES]) for k in range(0, len(kept), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(self.root)
        rows = []
        for name, size in partition.files:
            with fs.open_input_stream(base + name) as f:
                rows.append((self.root + name, size, f.read(self.size)))
        names = ["path", "bytes", "head"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=names)


class FileHeads(DataSource):
    """Options: path, glob (by name, in any case), head (bytes to read), most (larger files are left out)."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, bytes long, head binary"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))


def file_heads(spark: SparkSession, path: str, glob: str, head: int, most: int) -> DataFrame:
    """(path, bytes, head) of the files under a folder that every machine shares, at a path that Arrow's file systems open."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").options(glob=glob, head=head, most=most).load(path if "://" in path or path.startswith("file:") else f"file://{path}")
