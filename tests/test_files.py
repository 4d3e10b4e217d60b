"""Tails, codecs, schemas and streams: Spark, Arrow and the decoder by hand agree; broken files raise what they should."""

import datetime as dt
import decimal
import io
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as paorc
import pytest
from hypothesis import given
from hypothesis import strategies as st

from stripelore import wire
from stripelore.codecs import Compression, frame, lz4_block
from stripelore.errors import CorruptedProtobuf, InvalidSchema, InvalidStreamKind, InvalidStripeIndex, InvalidTail, MalformedStream, MalformedUnion, TypeNotSupported, UnexpectedEof, UnsupportedFeature, UnsupportedUnion
from stripelore.operators.columns import decode_column, decode_columns
from stripelore.operators.reader import OrcReader
from stripelore.shared import shared_dir
from stripelore.tail import FileTail, bytes_source, part_of
from stripelore.typetree import column_id, schema, validate


def written(table: pa.Table, **options) -> bytes:
    out = io.BytesIO()
    paorc.write_table(table, out, **options)
    return out.getvalue()


TABLE = pa.table({
    "b": pa.array([True, None, False] * 700), "y": pa.array([1, -2, None] * 700, pa.int8()), "s": pa.array([None, 300, -5] * 700, pa.int16()),
    "i": pa.array(list(range(2100)), pa.int32()), "l": pa.array([2**62, None, -(2**62)] * 700), "f": pa.array([0.5, None, -1.25] * 700, pa.float32()),
    "d": pa.array([1e300, -0.0, None] * 700), "t": pa.array(["a", "ü" * 40, None] * 700), "z": pa.array([b"", b"\x00\xff", None] * 700),
    "e": pa.array([decimal.Decimal("1.25"), decimal.Decimal("-99999.99"), None] * 700, pa.decimal128(12, 2)),
    "a": pa.array([dt.date(1960, 2, 29), None, dt.date(2024, 1, 1)] * 700), "n": pa.nulls(2100, pa.int64()),
})


@pytest.mark.parametrize("codec", ["uncompressed", "zlib", "snappy", "lz4", "zstd"])
@pytest.mark.parametrize("version", ["0.11", "0.12"])
def test_columns_by_hand(codec, version):
    raw = written(TABLE, compression=codec, file_version=version, compression_block_size=65536, dictionary_key_size_threshold=0.5)
    tail = FileTail.read(*bytes_source(raw))
    assert tail.version == tuple(map(int, version.split("."))) and tail.rows == 2100
    for k, name in enumerate(TABLE.column_names):
        whole = pa.concat_arrays([decode_column(tail, i, k + 1) for i in range(len(tail.stripes))])
        assert whole.to_pylist() == TABLE.column(name).to_pylist(), name


def test_statistics_and_schema():
    tail = FileTail.read(*bytes_source(written(TABLE)))
    assert tail.footer["statistics"][4]["integer"] == {"min": 0, "max": 2099, "sum": sum(range(2100))}
    assert tail.stripe_statistics[0][4]["values"] == 2100
    s = schema(tail.types, tail.nullable)
    assert [column_id(f) for f in s] == list(range(1, 13)) and s["e"].dataType.simpleString() == "decimal(12,2)"
    assert tail.nullable[1] and not tail.nullable[4]
    with pytest.raises(InvalidStripeIndex):
        tail.stripe(len(tail.stripes))
    with pytest.raises(InvalidStreamKind):
        tail.stream(0, 4, "PRESENT")
    assert tail.row_index(0, 4)[0]["statistics"]["integer"]["min"] == 0


def test_timestamps_by_hand():
    ns = np.array([0, 1, 1_500_000_000, -1_500_000_000, 1420070400_000000000, -1, 1_000_000_001], np.int64)
    tail = FileTail.read(*bytes_source(written(pa.table({"t": pa.array(ns).cast(pa.timestamp("ns"))}))))
    got, arrow = decode_column(tail, 0, 1).to_pylist(), paorc.ORCFile(io.BytesIO(written(pa.table({"t": pa.array(ns).cast(pa.timestamp("ns"))})))).read().column("t")
    assert got == arrow.cast(pa.int64()).to_pylist() and [got[k] for k in (0, 2, 3, 4, 6)] == [ns[k] for k in (0, 2, 3, 4, 6)]


def test_timestamps_of_other_zones(spark, tmp_path):
    """Files that the JVM writes in a zone show what its clock showed."""
    zones, known = spark._jvm.java.util.TimeZone, spark._jvm.java.util.TimeZone.getDefault()
    clock = ["2015-01-01 00:00:00", "2023-07-04 12:30:00.25", "1969-12-31 20:00:00.5", "2023-11-05 00:59:59", "1955-06-01 01:02:03"]
    for zone in ("America/New_York", "Asia/Kolkata", "UTC"):
        path = str(tmp_path / zone.replace("/", "-"))
        before = spark.conf.get("spark.sql.session.timeZone")
        zones.setDefault(zones.getTimeZone(zone))
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            spark.createDataFrame([(c,) for c in clock], "c string").coalesce(1).selectExpr("cast(c as timestamp) t").write.orc(path)
        finally:
            zones.setDefault(known)
            spark.conf.set("spark.sql.session.timeZone", before)
        tail = OrcReader(spark, path).tail()
        assert tail.stripe_footer(0)["timezone"] == zone
        want = [int(np.datetime64(c.replace(" ", "T"), "ns").astype(np.int64)) for c in clock]
        assert decode_column(tail, 0, 1).to_pylist() == want, zone


def test_nested_by_hand():
    inner = pa.struct([("a", pa.int64()), ("b", pa.list_(pa.string()))])
    table = pa.table({
        "l": pa.array([[1, None], [], None, [2**40]] * 300, pa.list_(pa.int64())),
        "s": pa.array([{"a": 1, "b": ["x", None]}, None, {"a": None, "b": []}, {"a": 4, "b": None}] * 300, inner),
        "m": pa.array([[("k", {"a": 1, "b": None})], None, [], [("j", None), ("i", {"a": None, "b": ["y"]})]] * 300, pa.map_(pa.string(), inner)),
        "ll": pa.array([[[1], None, []], None, [], [[2, 3]]] * 300, pa.list_(pa.list_(pa.int32()))),
    })
    tail = FileTail.read(*bytes_source(written(table, compression="zlib")))
    ids = dict(zip(tail.types[0]["names"], tail.types[0]["subtypes"], strict=True))
    for name in table.column_names:
        assert decode_column(tail, 0, ids[name]).to_pylist() == table.column(name).to_pylist(), name
    union = pa.UnionArray.from_dense(pa.array([0, 1, 0], pa.int8()), pa.array([0, 0, 1], pa.int32()), [pa.array([5, 6]), pa.array(["x"])])
    tail = FileTail.read(*bytes_source(written(pa.table({"u": union}))))
    assert decode_column(tail, 0, 1).to_pylist() == [{"tag": 0, "field0": 5, "field1": None}, {"tag": 1, "field0": None, "field1": "x"}, {"tag": 0, "field0": 6, "field1": None}]
    tail.types[1]["subtypes"] = tail.types[1]["subtypes"][:1]
    with pytest.raises(MalformedUnion):
        decode_column(tail, 0, 1)


def test_short_streams_and_cached_footers():
    raw = written(TABLE, compression="uncompressed")
    reads = []
    tail = FileTail.read(lambda at, n: reads.append((at, n)) or raw[at : at + n], len(raw), read_ahead=300)
    for k in range(1, 13):
        tail.encoding(0, k)
        tail.streams(0)
    s = tail.stripe(0)
    footer = (s["offset"] + s["index_length"] + s["data_length"], s["footer_length"])
    assert reads.count(footer) == 1
    tail.read_at = lambda at, n: raw[at : at + n - 1]
    with pytest.raises(UnexpectedEof):
        tail.stream(0, 4, "DATA")


def test_codecs_and_patterns_on_executors(spark, tmp_path):
    def own_deflate(block, most):
        import zlib

        return zlib.decompress(block, -15)

    def refusing(block, most):
        raise ValueError("own codec at work")

    for k in range(3):
        spark.range(1000 * k, 1000 * k + 1000).selectExpr("id", "repeat(cast(id as string), 20) t").coalesce(1).write.option("compression", "zlib").orc(str(tmp_path / f"part={k}"))
    assert sorted(r.id for r in decode_columns(spark, str(tmp_path), {"id": "long"}, {"ZLIB": own_deflate}).collect()) == list(range(3000))
    with pytest.raises(Exception, match="own codec at work"):
        decode_columns(spark, str(tmp_path), {"t": "string"}, {"ZLIB": refusing}).collect()
    with pytest.raises(Exception, match="own codec at work"):
        OrcReader(spark, str(tmp_path), codecs={"ZLIB": refusing}).column_statistics().collect()
    r = OrcReader(spark, str(tmp_path / "part=[01]*") + "{,}", codecs={"ZLIB": own_deflate}, buffer_size=512)
    assert r.num_rows() == 2000 and r.scan().count() == 2000 and r.read_stripes().count() == 2000
    splits = OrcReader(spark, str(tmp_path))._source("orc_stripe_scan", split_size="100")
    assert splits.rdd.getNumPartitions() > 3 and splits.count() == 3000


def test_shared_folder_of_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session)


def test_within_another_file():
    raw = written(TABLE)
    read, size = part_of(bytes_source(b"head" + raw + b"tail")[0], 4, 4 + len(raw))
    assert FileTail.read(read, size).rows == 2100
    with pytest.raises(ValueError):
        part_of(read, 5, 5)


def test_broken_files():
    raw = written(TABLE)
    with pytest.raises(UnexpectedEof):
        FileTail.read(*bytes_source(b"ORC"))
    with pytest.raises(InvalidTail):
        FileTail.read(*bytes_source(raw[:-4] + b"XXX" + raw[-1:]))
    with pytest.raises(InvalidTail):
        FileTail.read(*bytes_source(raw[-60:]))
    with pytest.raises(InvalidTail):
        FileTail.read(*bytes_source(b"\x01" * 9 + b"\xff"))


def message(**fields) -> bytes:
    """Fields n<number> as wire format: ints as varints, bytes as they are."""
    out = b""
    for k, v in fields.items():
        n = int(k[1:])
        from stripelore.rle import encode_varint

        out += encode_varint(n << 3 | (2 if isinstance(v, bytes) else 0)) + (encode_varint(len(v)) + v if isinstance(v, bytes) else encode_varint(v))
    return out


def file_of(footer: bytes, compression: int = 0) -> bytes:
    post = message(n1=len(footer), n2=compression, n8000=b"ORC")
    return b"ORC" + b"\x00" * 20 + footer + post + bytes([len(post)])


def test_refusals():
    with pytest.raises(UnsupportedFeature):
        FileTail.read(*bytes_source(file_of(message(n10=b"\x0a\x00"))))
    with pytest.raises(UnsupportedFeature):
        FileTail.read(*bytes_source(file_of(b"", compression=3)))
    with pytest.raises(CorruptedProtobuf):
        FileTail.read(*bytes_source(file_of(b"\x0f")))
    # a codec of the caller's own
    body = frame(message(n6=7), 64, lambda b: b[::-1])
    tail = FileTail.read(*bytes_source(file_of(body, compression=3)), {"LZO": lambda b, most: b[::-1]})
    assert tail.rows == 7


def test_stream_beyond_stripe():
    footer = message(n1=message(n1=1, n2=1, n3=500))
    types = message(n1=12, n2=b"\x01", n3=b"a") + b""
    whole = b"ORC" + footer
    body = message(n3=message(n1=3, n2=0, n3=0, n4=len(footer), n5=1), n4=types)
    post = message(n1=len(body), n2=0, n8000=b"ORC")
    tail = FileTail.read(*bytes_source(whole + body + post + bytes([len(post)])))
    with pytest.raises(MalformedStream):
        tail.streams(0)


def t(kind, subtypes=(), names=(), **more):
    return {"kind": wire.TYPES.index(kind), "subtypes": list(subtypes), "names": list(names), **more}


@pytest.mark.parametrize(
    "types",
    [[], [t("INT")], [t("STRUCT", [1], [])], [t("STRUCT", [0], ["a"])], [t("STRUCT", [2], ["a"]), t("INT")], [t("STRUCT", [2, 1], ["a", "b"]), t("INT"), t("INT")],
     [t("STRUCT", [1], ["a"]), t("LIST")], [t("STRUCT", [1], ["a"]), t("MAP", [2]), t("INT")]],
)
def test_bad_schemas(types):
    with pytest.raises(InvalidSchema):
        validate(types)


def test_types_without_counterpart():
    with pytest.raises(TypeNotSupported):
        schema([t("STRUCT", [1], ["a"]), {"kind": 77, "subtypes": [], "names": []}])
    with pytest.raises(UnsupportedUnion):
        schema([t("STRUCT", [1], ["a"]), t("UNION", range(2, 130)), *[t("INT")] * 128])
    union = schema([t("STRUCT", [1], ["u"]), t("UNION", [2, 3]), t("INT"), t("VARCHAR", maximum_length=9)])
    assert union.simpleString() == "struct<u:struct<tag:tinyint,field0:int,field1:string>>"
    assert union["u"].dataType["field1"].metadata == {"column_id": 3, "maximum_length": 9}


@given(st.binary(max_size=3000), st.integers(1, 700))
def test_framing(data, size):
    deflate = lambda b: (c := zlib.compressobj(wbits=-15)).compress(b) + c.flush()
    assert Compression(1, size).read(frame(data, size, deflate)) == data


@given(st.binary(max_size=2000), st.integers(1, 5))
def test_lz4(data, times):
    data *= times
    raw = pa.compress(data, codec="lz4_raw", asbytes=True) if data else b"\x00"
    assert lz4_block(raw, len(data)) == data


@pytest.mark.parametrize("raw", [b"\x05", b"\x09\x00\x00ab", b"\x03\x00\x00\xff\xff\xff"])
def test_bad_frames(raw):
    with pytest.raises(MalformedStream):
        Compression(1, 100).read(raw)


def test_union_nanos_and_bounds(spark, tmp_path):
    tags = pa.array([0, 1, 0, 1], pa.int8())
    union = pa.UnionArray.from_dense(tags, pa.array([0, 0, 1, 1], pa.int32()), [pa.array([5, 6]), pa.array(["x", "y"])])
    times = pa.array([1, -1_500_000_001, 7, None], pa.int64()).cast(pa.timestamp("ns"))
    raw = written(pa.table({"u": union, "t": times, "m": pa.array([[("k", 1)], [], None, [("j", None)]], pa.map_(pa.string(), pa.int64()))}))
    (tmp_path / "a.orc").write_bytes(b"12345" + raw + b"67")
    r = OrcReader(spark, str(tmp_path), start=5, end=5 + len(raw))
    rows = r.read_stripes(nanos=True).collect()
    assert [x.u.asDict() for x in rows] == [{"tag": 0, "field0": 5, "field1": None}, {"tag": 1, "field0": None, "field1": "x"}, {"tag": 0, "field0": 6, "field1": None}, {"tag": 1, "field0": None, "field1": "y"}]
    assert [x.t for x in rows][2:] == [7, None] and [x.m for x in rows] == [{"k": 1}, {}, None, {"j": None}]
    assert r.num_rows() == 4 and r.stripes_count() == 1 and r.schema()["u"].dataType.names == ["tag", "field0", "field1"]


def test_reader(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.range(20000).selectExpr("id", "cast(id % 7 as string) s").coalesce(1).write.option("orc.stripe.size", "4096").option("orc.row.index.stride", "1000").orc(path)
    r = OrcReader(spark, path)
    n = r.stripes_count()
    assert n > 1 and r.num_rows() == 20000 and r.scan("id").count() == 20000
    parts = [r.read_stripes(stripe=i, batch_size=100).count() for i in range(n)]
    assert parts == [x.rows for x in r.stripes().orderBy("stripe").collect()]
    assert r.stripe_metadata(0).first().statistics[1].int_min == 0
    with pytest.raises(InvalidStripeIndex):
        r.stripe_metadata(n)
    with pytest.raises(Exception, match="InvalidStripeIndex|stripe 99"):
        r.read_stripes(stripe=99).count()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,19990)]" in r.scan().where("id > 19990")._jdf.queryExecution().toString()
    assert r.versions().first().version == (0, 12)


def test_stream(spark, tmp_path):
    from stripelore.streaming import read_stream

    path = str(tmp_path / "in")
    spark.range(10).write.orc(path)
    q = read_stream(spark, path).groupBy().count().writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    spark.range(5).write.mode("append").orc(path)
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").first()[0] == 15
