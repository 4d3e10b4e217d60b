"""Files of a path, for planning."""

from __future__ import annotations

import base64
import json
import os
import pickle
from collections.abc import Mapping

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, InputPartition

from ..codecs import Codec
from ..tail import READ_AHEAD, FileTail, open_source


def list_files(path: str) -> list[str]:
    return [f for f, _ in sized_files(path)]


def sized_files(path: str) -> list[tuple[str, int]]:
    """(data file, bytes) under a file, folder or JSON list of these, in order; names that begin with . or _ are not data. Files are
    listed, not opened."""
    if path.startswith("["):
        return [f for p in json.loads(path) for f in sized_files(p)]
    import pyarrow.fs as pafs

    if "://" in path or path.startswith("file:"):
        uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        system, inner = pafs.FileSystem.from_uri(uri)
        head = uri[: len(uri) - len(inner)]
    else:
        system, inner, head = pafs.LocalFileSystem(), os.path.abspath(path), ""
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(head + inner, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    ok = [(head + f.path, f.size) for f in found if f.type == pafs.FileType.File and not any(p[:1] in "._" for p in f.path[len(inner) :].split("/") if p)]
    return sorted(ok)


class FilePartition(InputPartition):
    """A file; of a scan, one stripe of it, or those that begin from one place to before another."""

    def __init__(self, file: str, stripe: int | None = None, start: int = 0, end: int | None = None):
        self.file, self.stripe, self.start, self.end = file, stripe, start, end


def packed_codecs(codecs: Mapping[str, Codec]) -> str:
    """Codecs as an option of the sources, by which they reach the executors."""
    return base64.b64encode(cloudpickle.dumps(dict(codecs))).decode()


class OrcSource(DataSource):
    """Options: path; start and end, for a file that lies within another one; codecs (packed_codecs) that replace or add to those
    known; buffer_size, the bytes that the first read of a file takes from its end."""

    def codecs(self) -> dict[str, Codec] | None:
        packed = self.options.get("codecs")
        return pickle.loads(base64.b64decode(packed)) if packed else None

    def bounds(self) -> tuple[int, int | None]:
        end = self.options.get("end")
        return int(self.options.get("start", 0)), None if end is None else int(end)

    def files(self) -> list[str]:
        return list_files(self.options["path"])

    def with_tail(self, file: str, use):
        read, size, close = open_source(file, *self.bounds())
        try:
            return use(FileTail.read(read, size, self.codecs(), int(self.options.get("buffer_size", READ_AHEAD))))
        finally:
            close()
