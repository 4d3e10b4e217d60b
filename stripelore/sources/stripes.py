"""Scan by stripe: tasks by bytes of files, batches of a chosen size, unions and nanoseconds included."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.orc as paorc
from pyspark.sql.datasource import DataSourceReader
from pyspark.sql.pandas.types import from_arrow_schema

from ..errors import InvalidStripeIndex, MalformedUnion
from ..tail import ReadAt, open_source
from .files import FilePartition, OrcSource, sized_files


def flat_type(t: pa.DataType, nanos: bool) -> pa.DataType:
    """A union becomes struct<tag, field0, ...>; a timestamp becomes microseconds or, with nanos, a long of nanoseconds."""
    if pa.types.is_union(t):
        return pa.struct([("tag", pa.int8()), *[(f"field{k}", flat_type(t.field(k).type, nanos)) for k in range(t.num_fields)]])
    if pa.types.is_timestamp(t):
        return pa.int64() if nanos else pa.timestamp("us", t.tz)
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, flat_type(f.type, nanos)) for f in t])
    if pa.types.is_map(t):
        return pa.map_(flat_type(t.key_type, nanos), flat_type(t.item_type, nanos))
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return pa.list_(flat_type(t.value_type, nanos))
    return t


def flat(a: pa.Array, nanos: bool) -> pa.Array:
    """An array in its flat_type."""
    t = a.type
    if not _nested(t):
        if pa.types.is_timestamp(t):
            return a.cast(pa.timestamp("ns", t.tz)).cast(pa.int64()) if nanos else a.cast(pa.timestamp("us", t.tz), safe=False)
        return a
    if pa.types.is_union(t):
        tags = a.type_codes
        if not set(pc.unique(tags).to_pylist()) <= set(t.type_codes):
            raise MalformedUnion("a tag that no variant of the union has")
        fields = []
        for k in range(t.num_fields):
            mine = pc.equal(tags, pa.scalar(t.type_codes[k], pa.int8()))
            child = a.field(k) if t.mode == "sparse" else a.field(k).take(pc.if_else(mine, a.offsets, pa.scalar(None, pa.int32())))
            child = flat(child, nanos)
            fields.append(pc.if_else(mine, child, pa.nulls(len(a), child.type)) if t.mode == "sparse" else child)
        return pa.StructArray.from_arrays([tags, *fields], ["tag", *[f"field{k}" for k in range(t.num_fields)]])
    mask = a.is_null() if a.null_count else None
    if pa.types.is_struct(t):
        if not t.num_fields:
            return a
        return pa.StructArray.from_arrays([flat(a.field(k), nanos) for k in range(t.num_fields)], [f.name for f in t], mask=mask)
    if a.offset:
        a = pa.concat_arrays([a])
        mask = a.is_null() if a.null_count else None
    if pa.types.is_map(t):
        return pa.MapArray.from_arrays(a.offsets, flat(a.keys, nanos), flat(a.items, nanos), mask=mask)
    return pa.ListArray.from_arrays(a.offsets.cast(pa.int32()), flat(a.values, nanos), mask=mask)


def _nested(t: pa.DataType) -> bool:
    return pa.types.is_nested(t)


class BoundedFile(io.RawIOBase):
    """A seekable file over reads by position, of which only what is asked for is held."""

    def __init__(self, read: ReadAt, size: int):
        self.read_at, self.size, self.at = read, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def readinto(self, buffer) -> int:
        data = self.read_at(self.at, max(0, min(len(buffer), self.size - self.at)))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


class StripeScan(OrcSource):
    """Rows of the stripes of a path. Options: path, start, end; stripe (one stripe of each file; InvalidStripeIndex if a file lacks it);
    batch_size (rows of a batch at most, 4096); columns (a comma-separated projection); nanos (true: timestamps as longs of nanoseconds);
    split_size (64 MiB: a task takes the stripes that begin in so many bytes of a file). Codecs are Arrow's own."""

    @classmethod
    def name(cls) -> str:
        return "orc_stripe_scan"

    def _option(self) -> tuple[int, bool, list[str] | None]:
        columns = self.options.get("columns")
        return int(self.options.get("batch_size", 4096)), self.options.get("nanos", "false").lower() == "true", columns.split(",") if columns else None

    def open(self, file: str) -> paorc.ORCFile:
        start, end = self.bounds()
        if start or end is not None:
            read, size, _ = open_source(file, start, end)
            return paorc.ORCFile(pa.PythonFile(BoundedFile(read, size), mode="r"))
        if "://" in file or file.startswith("file:"):
            import pyarrow.fs as pafs

            system, inner = pafs.FileSystem.from_uri(file)
            return paorc.ORCFile(system.open_input_file(inner))
        return paorc.ORCFile(file)

    def schema(self):
        _, nanos, columns = self._option()
        full = self.open(self.files()[0]).schema
        fields = [full.field(c) for c in columns] if columns else list(full)
        return from_arrow_schema(pa.schema([pa.field(f.name, flat_type(f.type, nanos)) for f in fields]))

    def reader(self, schema):
        return _StripeReader(self)


class _StripeReader(DataSourceReader):
    def __init__(self, source: StripeScan):
        self.source = source

    def partitions(self) -> list[FilePartition]:
        """By names and sizes of files alone: at most the first file is opened here, for its schema."""
        options = self.source.options
        if "stripe" in options:
            return [FilePartition(f, int(options["stripe"])) for f in self.source.files()]
        share, out = int(options.get("split_size", 64 << 20)), []
        start, end = self.source.bounds()
        for f, size in sized_files(options["path"]):
            size = (size if end is None else end) - start
            out += [FilePartition(f, start=at, end=at + share) for at in range(0, max(1, size), share)]
        return out

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        size, nanos, columns = self.source._option()
        file = self.source.open(partition.file)
        if partition.stripe is None:
            places = self.source.with_tail(partition.file, lambda tail: [s.get("offset", 0) for s in tail.stripes])
            stripes = [i for i, at in enumerate(places) if partition.start <= at < partition.end]
        elif 0 <= partition.stripe < file.nstripes:
            stripes = [partition.stripe]
        else:
            raise InvalidStripeIndex(f"stripe {partition.stripe} of {file.nstripes} in {partition.file}")
        for i in stripes:
            batch = file.read_stripe(i, columns=columns)
            names = columns or batch.schema.names
            arrays = [flat(batch.column(batch.schema.get_field_index(n)), nanos) for n in names]
            for at in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_arrays([a.slice(at, size) for a in arrays], names)
