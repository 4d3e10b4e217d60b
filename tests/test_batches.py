"""Streams decoded a few rows at a time."""

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.orc as paorc
import pytest

from stripelore import rle
from stripelore.operators import columns
from stripelore.tail import FileTail, open_source


def _tail(tmp_path, table: pa.Table, **options) -> FileTail:
    path = str(tmp_path / "x.orc")
    paorc.write_table(table, path, **options)
    read, size, _ = open_source(path)
    return FileTail.read(read, size)


@pytest.mark.parametrize("compression", ["uncompressed", "zlib"])
def test_columns_come_in_the_numbers_asked_for(tmp_path, compression):
    rnd = np.random.default_rng(2)
    n = 5003
    gaps = lambda v: [None if i % 7 == 3 else x for i, x in enumerate(v)]
    whole = {
        "i": pa.array(gaps(rnd.integers(-(2**40), 2**40, n).tolist())),
        "run": pa.array(np.arange(n)),
        "b": pa.array(gaps((rnd.random(n) < 0.3).tolist())),
        "d": pa.array(gaps([Decimal(int(v)).scaleb(-2) for v in rnd.integers(-(10**9), 10**9, n)]), pa.decimal128(12, 2)),
        "wide": pa.array([Decimal(int(v) ** 2 * (-1) ** int(v)).scaleb(-3) for v in rnd.integers(0, 2**62, n)], pa.decimal128(38, 3)),
        "s": pa.array(gaps([f"w{v}" for v in rnd.integers(0, 9, n)])),
        "t": pa.array(rnd.integers(0, 20000, n).astype(np.int32), pa.date32()),
        "l": pa.array(gaps([[{"a": int(v)}] * int(v % 4) for v in rnd.integers(0, 99, n)])),
        "f": pa.array(rnd.random(n)),
    }
    tail = _tail(tmp_path, pa.table(whole), compression=compression)
    ids = dict(zip(tail.types[0]["names"], tail.types[0]["subtypes"], strict=True))
    for name, want in whole.items():
        values, got = columns._Values(tail, 0, ids[name]), []
        for at in range(0, n, 613):
            got.append(values.take(min(613, n - at)))
        values.end()
        assert pa.concat_arrays(got).to_pylist() == want.to_pylist(), name


def test_a_feed_reads_no_further_than_it_must():
    read = []

    def pieces():
        for k in range(50):
            read.append(k)
            yield rle.encode_v1([(k * 1000 + i) ** 2 for i in range(1000)], True)

    feed = rle.Feed(pieces())
    runs = rle.integers(feed, "DIRECT", True)
    assert runs.take(1500).tolist() == [i * i for i in range(1500)] and len(read) < 8
    assert np.concatenate([runs.take(24_250) for _ in range(2)]).tolist() == [i * i for i in range(1500, 50_000)]


def test_numbers_of_streams_come_in_lots(spark, tmp_path):
    from stripelore.operators.reader import OrcReader

    spark.range(0, 300_000, 1, 2).selectExpr("id * id % 1000003 AS v").write.option("compression", "none").orc(str(tmp_path / "o"))
    streams = OrcReader(spark, str(tmp_path / "o")).streams().where("column = 'v' AND stream = 'DATA'")
    values = columns.read_integers(streams, True)
    assert sorted(r.value for r in values.collect()) == sorted(i * i % 1000003 for i in range(300_000))
    read, size, _ = open_source(streams.first().file)
    feed = rle.Feed(FileTail.read(read, size).pieces(0, 1, "DATA"))
    assert max(map(len, rle.integers(feed, "DIRECT_V2", True).lots(1000))) < 1600
