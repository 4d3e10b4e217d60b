"""ORC files made from the Parquet tables, for queries over them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import shared_dir

_MADE: dict[tuple, str] = {}


def as_orc(spark: SparkSession, sf_dir: str, table: str, name: str = "plain", change: Callable[[DataFrame], DataFrame] | None = None, **options: str) -> str:
    """Folder of ORC files with the rows of a table, after `change`, written with options such as compression or orc.stripe.size
    (dots as two underscores). Made once for each application, table, name and options; `name` stands for `change`."""
    key = (spark.sparkContext.applicationId, sf_dir, table, name, json.dumps(options, sort_keys=True))
    if key not in _MADE:
        path = f"{shared_dir(spark)}/orc/{table}-{name}-{hashlib.sha1(repr(key).encode()).hexdigest()[:16]}"
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        writer = (change(df) if change else df).write.mode("overwrite")
        for k, v in options.items():
            writer = writer.option(k.replace("__", "."), v)
        writer.orc(path)
        _MADE[key] = path
    return _MADE[key]
