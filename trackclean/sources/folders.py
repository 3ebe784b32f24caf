"""File listings of a mounted folder as a data source: directories are listed by many tasks, and no file is left out.

Spark's own file sources leave out names that start with "_" or "." and files without a byte; a library may have them.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, size_bytes long, mtime_us long"
#: Directories are opened on the driver until there are so many to deal out.
PARTS = 64


class Folder(InputPartition):
    """A directory, to be listed with all that is below it, or its own files only."""

    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


def entries(path: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """(directories, files with size and time) of a directory. Links to directories are not followed, links to files are;
    what cannot be read is left out, as one bad file should not end a scan."""
    folders, files = [], []
    try:
        with os.scandir(path) as found:
            for e in found:
                try:
                    if e.is_dir(follow_symlinks=False):
                        folders.append(e.path)
                    elif stat.S_ISREG((s := e.stat()).st_mode):
                        files.append((e.path, s.st_size, s.st_mtime_ns // 1000))
                except OSError:
                    continue
    except OSError:
        pass
    return sorted(folders), files


class FolderReader(DataSourceReader):
    def __init__(self, root: str, parts: int) -> None:
        self.root, self.parts = root, parts

    def partitions(self) -> list[InputPartition]:
        """Level by level, until there are enough directories or no more."""
        opened, level = [], [self.root]
        while level and len(opened) + len(level) < self.parts:
            opened += level
            level = [d for path in level for d in entries(path)[0]]
        return [Folder(p, False) for p in opened] + [Folder(p, True) for p in level] or [Folder(self.root, False)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, int]]:
        left = [partition.path]
        while left:
            folders, files = entries(left.pop())
            yield from files
            if partition.deep:
                left += folders


class FolderSource(DataSource):
    """spark.read.format("folder").load(path): path, size_bytes, mtime_us of every file below it; option parts."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options["path"], int(self.options.get("parts", PARTS)))
