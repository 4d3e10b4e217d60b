"""Variable-length numbers as column functions."""

import random

from pyspark.sql import functions as F

from stripelore import rle
from stripelore.functions import varint_decode, varint_encode


def test_edges_and_no_arrays(spark):
    rnd = random.Random(5)
    edges = [(1 << k) + d for k in range(63) for d in (-1, 0, 1)] + [2**63 - 1, -1, -2, -(2**63), -(2**62)] + [rnd.getrandbits(64) - 2**63 for _ in range(500)]
    values = sorted({v for v in edges if -(2**63) <= v < 2**63})
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long").select("v", varint_encode(F.col("v")).alias("b"))
    df = df.select("v", "b", varint_decode(F.col("b")).alias("back"))
    for r in df.collect():
        assert r.back == r.v and (None if r.b is None else bytes(r.b)) == (None if r.v is None else rle.encode_varint(r.v % 2**64))
    assert "lambda" not in df._jdf.queryExecution().toString()
