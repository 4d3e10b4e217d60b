"""Streams of arriving ORC files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.reader import OrcReader


def read_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, max_files: int | None = None) -> DataFrame:
    """A streaming DataFrame of the files that come into a folder. Without a schema, the first file that is there gives it."""
    reader = spark.readStream.schema(schema or OrcReader(spark, path).scan().schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.orc(path)
