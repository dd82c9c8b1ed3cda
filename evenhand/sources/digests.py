"""Digests of files of any size, as a data source: a partition per file, read in pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 16 << 20


class OneFile(InputPartition):
    def __init__(self, uri: str, place: str):
        self.uri, self.place = uri, place


class FileDigests(DataSource):
    """``spark.read.format("file_digests").load(folder)``: (bytes, file, sha256) of each file below a folder.

    A task holds one piece of its file.  Names of hidden files (``_`` or ``.``
    first) are left out; an empty folder gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "bytes long, file string, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return DigestReader(self.options["path"])


class DigestReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path if "://" in path else path.removeprefix("file:")

    def partitions(self) -> list[OneFile]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(place)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(place, recursive=True))
        return [OneFile(self.path, f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name[0] not in "._"]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:
            return
        system, _ = fs.FileSystem.from_uri(partition.uri)
        digest, size = hashlib.sha256(), 0
        with system.open_input_file(partition.place) as source:
            while piece := source.read(PIECE):
                digest.update(piece)
                size += len(piece)
        yield size, partition.place.rpartition("/")[2], digest.hexdigest()
