"""What the operators share: tables in the shared folder, and small expressions."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..shipping import ship_package

#: A word is a longest run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for paths that only Spark can open."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables of one run in the shared folder. They cut lineage, survive lost executors and, unlike a
    checkpoint of rows, are columnar and compressed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        if self.root.startswith(("file:", "/")):  # elsewhere, the folder's owner clears it
            atexit.register(shutil.rmtree, "/" + self.root.removeprefix("file:").lstrip("/"), ignore_errors=True)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                fs, p = hadoop_path(self.spark, path)
                fs.delete(p, True)


#: What operators keep in a worker process from one task to the next, by operator.
AT_HAND: dict[str, list | dict] = {}


def _give_back() -> None:
    """Memory that a task no longer uses goes back to the machine, as the process lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run, schema, keeps: str | None = None) -> DataFrame:
    """mapInArrow, with this package at hand in the workers. A worker drops what other operators than `keeps` have left in it."""
    ship_package(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, kept in AT_HAND.items():
            if name != keeps:
                kept.clear()
        yield from run(batches)
        _give_back()

    return df.mapInArrow(task, schema)


def unit_interval(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the parts alone: 52 bits of their MD5."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def join_small(left: DataFrame, right: DataFrame, on: Column, how: str, rows: int, row_bytes: int, most: int = 16 << 20) -> DataFrame:
    """Broadcasts the right side if `rows * row_bytes` is within `most` bytes; beyond it the join is
    left to Spark, which shuffles and splits skewed partitions."""
    return left.join(F.broadcast(right) if rows * row_bytes <= most else right, on, how)
