"""Metadata of files, stripes, columns, streams and row groups as rows, read on the executors, one task for each file."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql.datasource import DataSourceReader

from ..tail import FileTail
from ..typetree import leaf_paths, schema
from ..wire import TYPES
from .files import FilePartition, OrcSource


class _Rows(OrcSource):
    """A source whose rows come from each file's tail."""

    def rows(self, file: str, tail: FileTail) -> list[tuple]:
        raise NotImplementedError

    def reader(self, schema):
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: _Rows):
        self.source = source

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(f) for f in self.source.files()]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        yield from self.source.with_tail(partition.file, lambda tail: self.source.rows(partition.file, tail))


class FileMeta(_Rows):
    """One row for each file."""

    @classmethod
    def name(cls) -> str:
        return "orc_file_meta"

    def schema(self) -> str:
        return (
            "file string, version struct<major:int,minor:int>, rows long, stripes int, header_length long, content_length long, row_index_stride long, "
            "compression string, block_size long, writer_version int, software_version string, schema string, user_metadata map<string,binary>"
        )

    def rows(self, file: str, tail: FileTail) -> list[tuple]:
        f = tail.footer
        return [(
            file, tail.version, tail.rows, len(tail.stripes), f.get("header_length"), f.get("content_length"), f.get("row_index_stride"), tail.compression.name,
            tail.postscript.get("block_size"), tail.postscript.get("writer_version"), f.get("software_version"), schema(tail.types, tail.nullable).json(), tail.user_metadata,
        )]


class Stripes(_Rows):
    """One row for each stripe."""

    @classmethod
    def name(cls) -> str:
        return "orc_stripes"

    def schema(self) -> str:
        return "file string, stripe int, offset long, index_size long, data_size long, footer_size long, rows long, timezone string"

    def rows(self, file: str, tail: FileTail) -> list[tuple]:
        return [
            (file, i, s.get("offset"), s.get("index_length", 0), s.get("data_length", 0), s.get("footer_length", 0), s.get("rows", 0), tail.stripe_footer(i).get("timezone"))
            for i, s in enumerate(tail.stripes)
        ]


_STATISTICS = (
    "values long, has_null boolean, bytes_on_disk long, int_min long, int_max long, int_sum long, double_min double, double_max double, double_sum double, "
    "string_min string, string_max string, string_lower string, string_upper string, string_length long, true_count long, decimal_min string, decimal_max string, decimal_sum string, "
    "date_min int, date_max int, timestamp_min_ms long, timestamp_max_ms long, timestamp_min_utc_ms long, timestamp_max_utc_ms long, timestamp_min_nanos int, timestamp_max_nanos int, "
    "binary_length long, min_children long, max_children long, total_children long"
)


def statistics_row(s: dict[str, Any]) -> tuple:
    def of(kind: str, *names: str) -> list:
        part = s.get(kind, {})
        return [part.get(n) for n in names]

    bucket = s.get("bucket", {}).get("count")
    return (
        s.get("values"), s.get("has_null"), s.get("bytes_on_disk"), *of("integer", "min", "max", "sum"), *of("double", "min", "max", "sum"),
        *of("string", "min", "max", "lower", "upper", "sum"), bucket[0] if bucket else None, *of("decimal", "min", "max", "sum"), *of("date", "min", "max"),
        *of("timestamp", "min", "max", "min_utc", "max_utc", "min_nanos", "max_nanos"), *of("binary", "sum"), *of("collection", "min_children", "max_children", "total_children"),
    )


def _columns(tail: FileTail) -> list[tuple[int, str, str]]:
    paths = leaf_paths(tail.types)
    return [(i, paths.get(i, ""), TYPES[t.get("kind", 0)]) for i, t in enumerate(tail.types)]


class ColumnStatistics(_Rows):
    """Statistics of each column, of the whole file (stripe is null) and of each stripe. Each row has the column's own by its id; the root is column 0."""

    @classmethod
    def name(cls) -> str:
        return "orc_column_stats"

    def schema(self) -> str:
        return f"file string, stripe int, column_id int, column string, kind string, {_STATISTICS}"

    def rows(self, file: str, tail: FileTail) -> list[tuple]:
        columns = _columns(tail)
        lots = [(None, tail.footer["statistics"]), *enumerate(tail.stripe_statistics)]
        return [(file, stripe, *c, *statistics_row(s)) for stripe, stats in lots for c, s in zip(columns, stats, strict=False)]


class Streams(_Rows):
    """Place, length and encoding of each stream of each stripe."""

    @classmethod
    def name(cls) -> str:
        return "orc_streams"

    def schema(self) -> str:
        return "file string, stripe int, column_id int, column string, stream string, offset long, length long, encoding string, dictionary_size long"

    def rows(self, file: str, tail: FileTail) -> list[tuple]:
        names, out = {i: n for i, n, _ in _columns(tail)}, []
        for i in range(len(tail.stripes)):
            footer = tail.stripe_footer(i)["columns"]
            for s in tail.streams(i):
                c = s["column"]
                out.append((file, i, c, names.get(c), s["kind"], s["offset"], s["length"], tail.encoding(i, c), footer[c].get("dictionary_size", 0)))
        return out


class RowGroups(_Rows):
    """The row index: positions and statistics of each group of rows of each column, and its Bloom filter, where there is one."""

    @classmethod
    def name(cls) -> str:
        return "orc_row_groups"

    def schema(self) -> str:
        return f"file string, stripe int, row_group int, column_id int, column string, kind string, positions array<long>, bloom_hashes int, bloom_bits binary, {_STATISTICS}"

    def rows(self, file: str, tail: FileTail) -> list[tuple]:
        out = []
        for i in range(len(tail.stripes)):
            kinds = {(s["column"], s["kind"]) for s in tail.streams(i)}
            for c in _columns(tail):
                if (c[0], "ROW_INDEX") not in kinds:
                    continue
                blooms = tail.bloom_filters(i, c[0]) if (c[0], "BLOOM_FILTER_UTF8") in kinds else []
                for g, entry in enumerate(tail.row_index(i, c[0])):
                    b = blooms[g] if g < len(blooms) else {}
                    out.append((file, i, g, *c, entry["positions"], b.get("hashes"), b.get("bits"), *statistics_row(entry.get("statistics", {}))))
        return out
