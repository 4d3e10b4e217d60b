"""A reader of ORC files: data through Spark's vectorized reader, metadata and stripes through the sources of this package."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codecs import Codec
from ..errors import InvalidStripeIndex
from ..sources import register
from ..sources.files import list_files, packed_codecs
from ..tail import READ_AHEAD, FileTail, open_source
from ..typetree import schema


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(pattern)
    return sorted(f.getPath().toString() for f in found)


class OrcReader:
    """Opens a file, a folder of files or a pattern of these. `start` and `end` bound a file that lies within another one; `codecs` replaces or
    adds decompressors of metadata and streams, on the driver and the executors; `buffer_size` is how much the first read of a file takes
    from its end."""

    def __init__(
        self, spark: SparkSession, path: str, *, start: int = 0, end: int | None = None, codecs: Mapping[str, Codec] | None = None, buffer_size: int = READ_AHEAD
    ):
        self.spark, self.codecs, self.buffer_size = spark, codecs, buffer_size
        self.path = json.dumps(_matches(spark, path)) if any(c in path for c in "*?{") else path
        self.options = {"path": self.path, "start": str(start), "buffer_size": str(buffer_size)} | ({} if end is None else {"end": str(end)})
        if codecs:
            self.options["codecs"] = packed_codecs(codecs)
        register(spark)

    def _source(self, name: str, **options: str) -> DataFrame:
        return self.spark.read.format(name).options(**self.options, **options).load()

    # -- metadata of every file, read on the executors

    def files(self) -> DataFrame:
        return self._source("orc_file_meta")

    def versions(self) -> DataFrame:
        return self.files().select("file", "version")

    def user_metadata(self) -> DataFrame:
        return self.files().select("file", F.explode("user_metadata").alias("name", "value"))

    def num_rows(self) -> int:
        """Rows by the footers alone."""
        return self.files().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def stripes(self) -> DataFrame:
        return self._source("orc_stripes")

    def stripes_count(self) -> int:
        return self.files().agg(F.coalesce(F.sum("stripes"), F.lit(0))).first()[0]

    def stripe_metadata(self, stripe: int) -> DataFrame:
        """The stripe's row for each file, with its column statistics as an array; InvalidStripeIndex if no file has it."""
        rows = self.stripes().where(F.col("stripe") == stripe)
        if rows.isEmpty():
            raise InvalidStripeIndex(f"no file has a stripe {stripe}")
        stats = self.column_statistics().where(F.col("stripe") == stripe)
        own = [c for c in stats.columns if c not in ("file", "stripe")]
        stats = stats.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("statistics"))
        return rows.join(stats, "file", "left")

    def column_statistics(self) -> DataFrame:
        return self._source("orc_column_stats")

    def streams(self) -> DataFrame:
        return self._source("orc_streams")

    def row_groups(self) -> DataFrame:
        return self._source("orc_row_groups")

    # -- one file, on the driver

    def tail(self, file: str | None = None) -> FileTail:
        """The tail of one file (the first). The file stays open as long as the result is used."""
        read, size, _ = open_source(file or list_files(self.path)[0], int(self.options["start"]), int(self.options["end"]) if "end" in self.options else None)
        return FileTail.read(read, size, self.codecs, self.buffer_size)

    def schema(self) -> T.StructType:
        """The first file's schema with column ids in the fields' metadata; nullable by its statistics."""
        tail = self.tail()
        return schema(tail.types, tail.nullable)

    # -- data

    def scan(self, *columns: str) -> DataFrame:
        """All rows, by Spark's own reader: columns are pruned, filters pushed down to stripes, row groups and Bloom filters."""
        if int(self.options["start"]) or "end" in self.options:
            return self.read_stripes(columns=list(columns) or None)
        df = self.spark.read.orc(json.loads(self.path) if self.path.startswith("[") else self.path)
        return df.select(*columns) if columns else df

    def read_stripes(self, stripe: int | None = None, batch_size: int = 4096, columns: list[str] | None = None, nanos: bool = False) -> DataFrame:
        """Rows of one stripe of each file, or of all, tasks by bytes of files: unions as tagged structs, timestamps on demand in nanoseconds."""
        more = {"batch_size": str(batch_size), "nanos": str(nanos).lower()}
        if stripe is not None:
            more["stripe"] = str(stripe)
        if columns:
            more["columns"] = ",".join(columns)
        return self._source("orc_stripe_scan", **more)

    @staticmethod
    def schema_of(row_schema: str) -> T.StructType:
        """A schema of files() as a StructType."""
        return T.StructType.fromJson(json.loads(row_schema))
