"""Queries over ORC files made from the tables, and the same in DuckDB's SQL over the tables themselves."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import as_orc
from ..functions import varint_decode, varint_encode, zigzag_decode, zigzag_encode
from ..operators.columns import decode_columns, read_integers
from ..operators.reader import OrcReader
from ..shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# -- whole scans, by codec, format and layout

_LINES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem"


def _scan(**options: str) -> Query:
    return lambda spark, sf: OrcReader(spark, as_orc(spark, sf, "lineitem", **options)).scan()


for _name, _options in {
    "scan_none": {"compression": "none"},
    "scan_zlib": {"compression": "zlib"},
    "scan_snappy": {"compression": "snappy"},
    "scan_lz4": {"compression": "lz4"},
    "scan_zstd": {"compression": "zstd"},
    "scan_lzo": {"compression": "lzo"},
    "scan_small_blocks": {"compression": "zlib", "orc__compress__size": "1024"},
    "scan_v011": {"orc__write__format": "0.11"},
    "scan_v012": {"orc__write__format": "0.12"},
}.items():
    query(_name, _LINES)(_scan(**_options))

_BY_FLAG = "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL"


def _by_flag(**options: str) -> Query:
    return lambda spark, sf: _scan(**options)(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


query("scan_dictionary", _BY_FLAG)(_by_flag(orc__dictionary__key__threshold="1.0"))
query("scan_direct_string", _BY_FLAG)(_by_flag(orc__dictionary__key__threshold="0"))

# -- types: values are cast before the files are written and come back as they went


def _typed(table: str, key: list[str], make: Callable[[], dict[str, Column]], show: Callable[[], dict[str, Column]] | None = None, **options: str) -> Query:
    """Columns come from functions, as none can be made before there is a session."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        made, out = make(), show() if show else None
        name = "typed-" + hashlib.sha1(repr(sorted((n, str(c)) for n, c in made.items())).encode()).hexdigest()[:12]
        path = as_orc(spark, sf, table, name, lambda df: df.select(*key, *[c.alias(n) for n, c in made.items()]), **options)
        df = OrcReader(spark, path).scan()
        return df.select(*key, *[c.alias(n) for n, c in out.items()]) if out else df

    return run


def _cast(kind: str) -> Column:
    return F.expr(f"CAST(nullif(l_linenumber, 3) AS {kind})")


_KEY = ["l_orderkey", "l_linenumber"]
for _name, _kind, _duck in [("tinyint", "tinyint", "TINYINT"), ("smallint", "smallint", "SMALLINT"), ("int", "int", "INTEGER"), ("bigint", "bigint", "BIGINT")]:
    query(f"type_{_name}", f"SELECT l_orderkey, l_linenumber, CAST(nullif(l_linenumber, 3) AS {_duck}) AS v FROM lineitem")(_typed("lineitem", _KEY, lambda k=_kind: {"v": _cast(k)}))
query("type_bool", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag = 'R' END AS v FROM lineitem")(
    _typed("lineitem", _KEY, lambda: {"v": F.expr("CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag = 'R' END")})
)
query("type_float", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS FLOAT) AS v FROM lineitem")(_typed("lineitem", _KEY, lambda: {"v": F.expr("CAST(l_quantity AS FLOAT)")}))
query("type_double", "SELECT l_orderkey, l_linenumber, nullif(l_extendedprice, l_quantity) AS v FROM lineitem")(
    _typed("lineitem", _KEY, lambda: {"v": F.expr("nullif(l_extendedprice, l_quantity)")})
)
query("type_decimal", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(12, 2)) AS v FROM lineitem")(
    _typed("lineitem", _KEY, lambda: {"v": F.expr("CAST(l_quantity AS DECIMAL(12, 2))")})
)
query("type_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS v FROM orders")(_typed("orders", ["o_orderkey"], lambda: {"v": F.expr("CAST(o_orderdate AS DATE)")}))
query("type_timestamp", "SELECT event_id, ts AS v FROM events")(
    _typed("events", ["event_id"], lambda: {"v": F.expr("CAST(ts AS TIMESTAMP)")}, lambda: {"v": F.expr("CAST(v AS TIMESTAMP_NTZ)")})
)
query("type_binary", "SELECT p_partkey, upper(hex(encode(p_name))) AS v FROM part")(
    _typed("part", ["p_partkey"], lambda: {"v": F.expr("encode(p_name, 'UTF-8')")}, lambda: {"v": F.hex("v")})
)
query("type_string", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS v, c_name AS w FROM customer")(
    _typed("customer", ["c_custkey"], lambda: {"v": F.expr("nullif(c_mktsegment, 'BUILDING')"), "w": F.col("c_name")})
)
query("type_struct", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN nullif(o_custkey, 7) END AS b, o_orderkey % 5 = 0 AS none FROM orders")(
    _typed(
        "orders", ["o_orderkey"], lambda: {"s": F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN named_struct('a', o_orderstatus, 'b', nullif(o_custkey, 7L)) END")},
        lambda: {"a": F.col("s.a"), "b": F.col("s.b"), "none": F.col("s").isNull()},
    )
)
query("type_list", "SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings")(
    _typed("embeddings", ["vec_id"], lambda: {"v": F.col("embedding")}, lambda: {"n": F.size("v"), "first": F.col("v")[0], "last": F.element_at("v", -1)})
)
query("type_map", "SELECT p_partkey, p_brand AS brand, p_size::VARCHAR AS size, 2::INTEGER AS n FROM part")(
    _typed(
        "part", ["p_partkey"], lambda: {"m": F.expr("map('brand', p_brand, 'size', CAST(p_size AS STRING))")},
        lambda: {"brand": F.col("m")["brand"], "size": F.col("m")["size"], "n": F.size("m")},
    )
)
query(
    "type_nested_nulls",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 0 ELSE 3 END::INTEGER AS n, "
    "CASE WHEN o_orderkey % 4 >= 2 THEN o_orderstatus END AS first, CASE WHEN o_orderkey % 4 = 2 THEN o_custkey END AS last FROM orders",
)(
    _typed(
        "orders", ["o_orderkey"],
        lambda: {"v": F.expr(
            "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN slice(array(named_struct('s', o_orderstatus, 'k', o_custkey)), 1, 0) "
            "ELSE array(named_struct('s', o_orderstatus, 'k', o_custkey), NULL, CASE WHEN o_orderkey % 4 = 2 THEN named_struct('s', CAST(NULL AS STRING), 'k', o_custkey) END) END"
        )},
        lambda: {"n": F.when(F.col("v").isNotNull(), F.size("v")), "first": F.expr("get(v, 0).s"), "last": F.expr("get(v, 2).k")},
    )
)


@query(
    "type_union",
    "SELECT n_nationkey, (n_nationkey % 2)::TINYINT AS tag, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::BIGINT END AS number, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS name FROM nation",
)
def type_union(spark: SparkSession, sf: str) -> DataFrame:
    """A union of numbers and names as a tagged struct. Spark writes no unions, so the 25 nations are written by Arrow."""
    import pyarrow as pa
    import pyarrow.orc as paorc

    rows = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").toArrow()
    keys = rows.column("n_nationkey").to_pylist()
    tags = pa.array([k % 2 for k in keys], pa.int8())
    numbers, names = rows.column("n_regionkey").combine_chunks().cast(pa.int64()), rows.column("n_name").combine_chunks().cast(pa.string())
    union = pa.UnionArray.from_dense(tags, pa.array(range(len(keys)), pa.int32()), [numbers, names])
    out = pa.BufferOutputStream()
    paorc.write_table(pa.table({"n_nationkey": rows.column("n_nationkey"), "u": union}), out)
    path = f"{shared_dir(spark)}/orc-union-{hashlib.sha1(sf.encode()).hexdigest()[:12]}.orc"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(out.getvalue().to_pybytes()))
    stream.close()
    df = OrcReader(spark, path).read_stripes()
    return df.select("n_nationkey", F.col("u.tag").alias("tag"), F.col("u.field0").alias("number"), F.col("u.field1").alias("name"))


# -- metadata and statistics


def _striped(spark: SparkSession, sf: str) -> OrcReader:
    """Lines in many small stripes."""
    change = lambda df: df.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    path = as_orc(spark, sf, "lineitem", "striped", change, orc__stripe__size="65536", orc__row__index__stride="5000", orc__bloom__filter__columns="l_orderkey")
    return OrcReader(spark, path)


@query("meta_num_rows", "SELECT count(*)::BIGINT AS rows FROM lineitem")
def meta_num_rows(spark, sf):
    return _striped(spark, sf).files().agg(F.sum("rows").alias("rows"))


@query("meta_stripe_rows", "SELECT count(*)::BIGINT AS rows, true AS numbered FROM lineitem")
def meta_stripe_rows(spark, sf):
    s = _striped(spark, sf).stripes().groupBy("file").agg(F.sum("rows").alias("rows"), (F.max("stripe") + 1 == F.count("*")).alias("numbered"))
    return s.agg(F.sum("rows").alias("rows"), F.bool_and("numbered").alias("numbered"))


@query("meta_stripes_count", "SELECT true AS equal, true AS several FROM (SELECT 1)")
def meta_stripes_count(spark, sf):
    r = _striped(spark, sf)
    n, counted = r.files().agg(F.sum("stripes").alias("n")), r.stripes().agg(F.count("*").alias("m"))
    return n.join(F.broadcast(counted), F.lit(True)).select((F.col("n") == F.col("m")).alias("equal"), (F.col("n") > 1).alias("several"))


@query("meta_version", "SELECT DISTINCT * FROM (VALUES (0, 11), (0, 12)) v(major, minor)")
def meta_version(spark, sf):
    both = [OrcReader(spark, as_orc(spark, sf, "nation", orc__write__format=v)).versions() for v in ("0.11", "0.12")]
    return both[0].unionByName(both[1]).select("version.major", "version.minor").distinct()


@query("meta_schema", "SELECT * FROM (VALUES ('n_nationkey', 'integer', 1), ('n_name', 'string', 2), ('n_regionkey', 'integer', 3)) v(name, type, column_id)")
def meta_schema(spark, sf):
    files = OrcReader(spark, as_orc(spark, sf, "nation")).files().select("schema").distinct()
    fields = F.from_json("schema", "fields array<struct<name:string,type:string,metadata:struct<column_id:int>>>").getField("fields")
    return files.select(F.explode(fields).alias("f")).select("f.name", "f.type", "f.metadata.column_id")


@query("meta_user_kv", "SELECT 'org.apache.spark.version' AS name, true AS filled FROM (SELECT 1)")
def meta_user_kv(spark, sf):
    kv = OrcReader(spark, as_orc(spark, sf, "nation")).user_metadata().where("name = 'org.apache.spark.version'")
    return kv.groupBy("name").agg(F.bool_and(F.octet_length("value") > 0).alias("filled"))


def _stats(spark: SparkSession, sf: str, table: str, column: str, name: str = "plain", change=None) -> DataFrame:
    return OrcReader(spark, as_orc(spark, sf, table, name, change)).column_statistics().where((F.col("column") == column) & F.col("stripe").isNull())


@query("stats_int", "SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, sum(l_orderkey)::BIGINT AS total, count(l_orderkey)::BIGINT AS n FROM lineitem")
def stats_int(spark, sf):
    s = _stats(spark, sf, "lineitem", "l_orderkey")
    return s.agg(F.min("int_min").alias("lo"), F.max("int_max").alias("hi"), F.sum("int_sum").alias("total"), F.sum("values").alias("n"))


@query("stats_double", "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, sum(l_quantity) AS total FROM lineitem")
def stats_double(spark, sf):
    s = _stats(spark, sf, "lineitem", "l_quantity")
    return s.agg(F.min("double_min").alias("lo"), F.max("double_max").alias("hi"), F.sum("double_sum").alias("total"))


@query("stats_string", "SELECT min(c_name) AS lo, max(c_name) AS hi, sum(strlen(c_name))::BIGINT AS size FROM customer")
def stats_string(spark, sf):
    s = _stats(spark, sf, "customer", "c_name")
    return s.agg(F.min(F.coalesce("string_min", "string_lower")).alias("lo"), F.max(F.coalesce("string_max", "string_upper")).alias("hi"), F.sum("string_length").alias("size"))


@query("stats_date", "SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders")
def stats_date(spark, sf):
    s = _stats(spark, sf, "orders", "d", "date", lambda df: df.select(F.col("o_orderdate").cast("date").alias("d")))
    return s.agg(F.date_from_unix_date(F.min("date_min")).alias("lo"), F.date_from_unix_date(F.max("date_max")).alias("hi"))


@query("stats_timestamp", "SELECT epoch_us(min(ts)) // 1000 AS lo, epoch_us(max(ts)) // 1000 AS hi FROM events")
def stats_timestamp(spark, sf):
    s = _stats(spark, sf, "events", "t", "time", lambda df: df.select(F.col("ts").cast("timestamp").alias("t")))
    return s.agg(F.min("timestamp_min_utc_ms").alias("lo"), F.max("timestamp_max_utc_ms").alias("hi"))


@query("stats_decimal", "SELECT min(v) AS lo, max(v) AS hi, CAST(sum(v) AS DECIMAL(20, 2)) AS total FROM (SELECT CAST(l_quantity AS DECIMAL(12, 2)) AS v FROM lineitem)")
def stats_decimal(spark, sf):
    s = _stats(spark, sf, "lineitem", "v", "decimal", lambda df: df.select(F.expr("CAST(l_quantity AS DECIMAL(12, 2)) AS v")))
    small, large = [F.col(c).cast("decimal(12,2)") for c in ("decimal_min", "decimal_max")], F.col("decimal_sum").cast("decimal(20,2)")
    return s.agg(F.min(small[0]).alias("lo"), F.max(small[1]).alias("hi"), F.sum(large).cast("decimal(20,2)").alias("total"))


@query("stats_bool", "SELECT count(*) FILTER (l_returnflag = 'R')::BIGINT AS yes, count(*)::BIGINT AS n FROM lineitem")
def stats_bool(spark, sf):
    s = _stats(spark, sf, "lineitem", "b", "bool", lambda df: df.select(F.expr("l_returnflag = 'R' AS b")))
    return s.agg(F.sum("true_count").alias("yes"), F.sum("values").alias("n"))


@query("stats_binary", "SELECT sum(strlen(p_name))::BIGINT AS size FROM part")
def stats_binary(spark, sf):
    return _stats(spark, sf, "part", "b", "binary", lambda df: df.select(F.expr("encode(p_name, 'UTF-8') AS b"))).agg(F.sum("binary_length").alias("size"))


@query("stats_has_null", "SELECT count(*) > count(nullif(l_linenumber, 1)) AS has_null, count(nullif(l_linenumber, 1))::BIGINT AS n FROM lineitem")
def stats_has_null(spark, sf):
    s = _stats(spark, sf, "lineitem", "v", "nulls", lambda df: df.select(F.expr("nullif(l_linenumber, 1) AS v")))
    return s.agg(F.bool_or("has_null").alias("has_null"), F.sum("values").alias("n"))


@query("stats_by_stripe", "SELECT sum(l_orderkey)::BIGINT AS total, count(*)::BIGINT AS n, min(l_quantity) AS lo FROM lineitem")
def stats_by_stripe(spark, sf):
    s = _striped(spark, sf).column_statistics().where("stripe is not null")
    pick = lambda c, v: F.when(F.col("column") == c, F.col(v))
    return s.agg(F.sum(pick("l_orderkey", "int_sum")).alias("total"), F.sum(pick("l_orderkey", "values")).alias("n"), F.min(pick("l_quantity", "double_min")).alias("lo"))


@query("row_groups", "SELECT count(*)::BIGINT AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi, true AS bloomed FROM lineitem")
def row_groups(spark, sf):
    g = _striped(spark, sf).row_groups().where("column = 'l_orderkey'")
    return g.agg(F.sum("values").alias("n"), F.min("int_min").alias("lo"), F.max("int_max").alias("hi"), F.bool_and((F.col("bloom_hashes") > 0) & (F.octet_length("bloom_bits") > 0)).alias("bloomed"))


@query("streams_within_stripes", "SELECT true AS equal FROM (SELECT 1)")
def streams_within_stripes(spark, sf):
    """The lengths of a stripe's streams add up to its index and data."""
    r = _striped(spark, sf)
    s = r.streams().groupBy("file", "stripe").agg(F.sum("length").alias("length"))
    return s.join(r.stripes(), ["file", "stripe"]).agg(F.bool_and(F.col("length") == F.col("index_size") + F.col("data_size")).alias("equal"))


# -- stripes


@query("stripe_scan_all", _LINES)
def stripe_scan_all(spark, sf):
    return _striped(spark, sf).read_stripes(batch_size=1000).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))


@query("stripe_scan_nanos", "SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
def stripe_scan_nanos(spark, sf):
    path = as_orc(spark, sf, "events", "time-id", lambda df: df.select("event_id", F.col("ts").cast("timestamp").alias("ns")))
    return OrcReader(spark, path).read_stripes(nanos=True)


@query("stripe_projection", "SELECT l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def stripe_projection(spark, sf):
    return _striped(spark, sf).read_stripes(columns=["l_linenumber"]).groupBy("l_linenumber").agg(F.count("*").alias("n"))


_DECODED = {"l_orderkey": "long", "l_linenumber": "int", "l_quantity": "double", "l_returnflag": "string"}
_DECODED_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem"
for _v in ("0.11", "0.12"):
    query(f"decode_columns_v{_v.replace('.', '')}", _DECODED_SQL)(
        lambda spark, sf, v=_v: decode_columns(spark, as_orc(spark, sf, "lineitem", orc__write__format=v, compression="zlib"), _DECODED)
    )


@query("decode_columns_nulls", "SELECT nullif(l_linenumber, 3) AS i, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag = 'R' END AS b, CAST(l_quantity AS DECIMAL(12, 2)) AS d, CAST(l_shipdate AS DATE) AS t FROM lineitem")
def decode_columns_nulls(spark, sf):
    exprs = ["nullif(l_linenumber, 3) AS i", "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag = 'R' END AS b", "CAST(l_quantity AS DECIMAL(12, 2)) AS d", "CAST(l_shipdate AS DATE) AS t"]
    path = as_orc(spark, sf, "lineitem", "hand", lambda df: df.selectExpr(*exprs), compression="snappy")
    return decode_columns(spark, path, {"i": "int", "b": "boolean", "d": "decimal(12,2)", "t": "date"})


_NESTED = (
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN slice(array(named_struct('s', o_orderstatus, 'm', map(o_orderstatus, o_custkey))), 1, 0) "
    "ELSE array(named_struct('s', o_orderstatus, 'm', map(o_orderstatus, o_custkey)), NULL) END AS v"
)


@query(
    "decode_nested",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 0 ELSE 2 END::INTEGER AS n, "
    "CASE WHEN o_orderkey % 4 >= 2 THEN o_orderstatus END AS first, CASE WHEN o_orderkey % 4 >= 2 THEN o_custkey END AS held, o_orderkey % 4 >= 2 AS gap FROM orders",
)
def decode_nested(spark, sf):
    """Lists of structs with maps, decoded by hand."""
    path = as_orc(spark, sf, "orders", "hand-nested", lambda df: df.selectExpr("o_orderkey", _NESTED), compression="zlib")
    df = decode_columns(spark, path, {"o_orderkey": "long", "v": "array<struct<s:string,m:map<string,bigint>>>"})
    held, gap = F.expr("get(v, 0).m")[F.expr("get(v, 0).s")], F.coalesce((F.size("v") == 2) & F.expr("get(v, 1)").isNull(), F.lit(False))
    return df.select("o_orderkey", F.when(F.col("v").isNotNull(), F.size("v")).alias("n"), F.expr("get(v, 0).s").alias("first"), held.alias("held"), gap.alias("gap"))


@query("decode_timestamps", "SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
def decode_timestamps(spark, sf):
    """Timestamps by hand, by the clock of the zone that the writer notes in each stripe."""
    path = as_orc(spark, sf, "events", "hand-time", lambda df: df.select("event_id", F.col("ts").cast("timestamp").alias("ns")))
    return decode_columns(spark, path, {"event_id": "long", "ns": "long"})


@query("decode_streams", "SELECT l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def decode_streams(spark, sf):
    """The numbers of raw streams, read by their places."""
    path = as_orc(spark, sf, "lineitem", "uncompressed", compression="none")
    values = read_integers(OrcReader(spark, path).streams().where("column = 'l_linenumber' AND stream = 'DATA'"), True)
    return values.select(F.col("value").cast("int").alias("l_linenumber")).groupBy("l_linenumber").agg(F.count("*").alias("n"))


# -- what Catalyst does with the files


@query("project", "SELECT l_orderkey, l_discount FROM lineitem")
def project(spark, sf):
    return _striped(spark, sf).scan("l_orderkey", "l_discount")


@query("filter_pushdown", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
def filter_pushdown(spark, sf):
    return _striped(spark, sf).scan().where("l_quantity > 45 AND l_discount < 0.02").select("l_orderkey", "l_linenumber", "l_quantity")


@query("agg_pushdown", "SELECT count(*)::BIGINT AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem")
def agg_pushdown(spark, sf):
    """Spark answers it from the footers where spark.sql.orc.aggregatePushdown is on."""
    return _striped(spark, sf).scan().agg(F.count("*").alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


@query("agg_from_statistics", ORACLES["agg_pushdown"])
def agg_from_statistics(spark, sf):
    """The same from the files' statistics, under any settings, without their data."""
    s = _striped(spark, sf).column_statistics().where("column = 'l_orderkey' AND stripe is null")
    return s.agg(F.sum("values").alias("n"), F.min("int_min").alias("lo"), F.max("int_max").alias("hi"))


@query("zigzag_roundtrip", "SELECT l_orderkey, CASE WHEN l_orderkey - 3000 >= 0 THEN 2 * (l_orderkey - 3000) ELSE -2 * (l_orderkey - 3000) - 1 END AS z, l_orderkey - 3000 AS back FROM lineitem")
def zigzag_roundtrip(spark, sf):
    v = F.col("l_orderkey") - 3000
    z = zigzag_encode(v)
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", z.alias("z"), zigzag_decode(z).alias("back"))


@query("varint_roundtrip", "SELECT l_orderkey, (CASE WHEN l_orderkey < 128 THEN 1 WHEN l_orderkey < 16384 THEN 2 WHEN l_orderkey < 2097152 THEN 3 ELSE 4 END)::INTEGER AS size, l_orderkey AS back FROM lineitem")
def varint_roundtrip(spark, sf):
    # in two projections: Catalyst keeps them apart, so that bytes are made once for both columns
    made = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", varint_encode(F.col("l_orderkey")).alias("b"))
    return made.select("l_orderkey", F.octet_length("b").alias("size"), varint_decode(F.col("b")).alias("back"))


@query(
    "flagship",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*)::BIGINT AS n, max(l_extendedprice) AS max_price FROM lineitem "
    "WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
)
def flagship(spark, sf):
    lines = OrcReader(spark, as_orc(spark, sf, "lineitem", compression="zstd")).scan().where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02'"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"), F.max("l_extendedprice").alias("max_price"))
