"""Shards of a growing table: small immutable files, merged by size tiers, named by a versioned manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hadoop_path, shared_dir, table

MANIFEST = "run string, files long, rows long, bytes long, born long"
#: A version in so many has the whole manifest; the others say what they add to the one before and take from it.
WHOLE = 16

#: Types that hold every value of those before them in the same row, and that Parquet files of those can be read as.
_WIDER = ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType))


class Conflict(RuntimeError):
    """Another writer has committed this version first."""


class SchemaConflict(ValueError):
    """An arrival has a column of a type that the store's column cannot take; nothing was written."""


def _wider(name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    for kinds in _WIDER:
        if type(a) in kinds and type(b) in kinds:
            return max(a, b, key=lambda t: kinds.index(type(t)))
    raise SchemaConflict(f"column {name} is {a.simpleString()} and comes as {b.simpleString()}")


def merged_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    """The columns of a, then those that b alone has (names as Spark compares them, without regard to case), each of the
    wider type; SchemaConflict where one type doesn't hold the other's values."""
    known = {f.name.lower(): f for f in b.fields}
    if len(known) < len(b.fields):
        raise SchemaConflict("two columns have one name")
    own = {f.name.lower() for f in a.fields}
    fields = [T.StructField(f.name, _wider(f.name, f.dataType, known[f.name.lower()].dataType) if f.name.lower() in known else f.dataType) for f in a.fields]
    return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in b.fields if f.name.lower() not in own])


class ShardStore:
    """A table of immutable Parquet shards under `root`, a folder that driver and executors share.

    data/<run>/ holds the shards of one write, a run; versions/<number> is a version: the columns of the table, the runs that it
    adds and those it takes away, and now and then, under manifests/, all of its runs. A version comes into being by the
    rename of one file onto a name that must not exist, so readers see all of it or nothing and of two writers one fails
    (Conflict). Shards of no version, left by a lost driver, are never read and go with vacuum(). The driver handles runs, of
    which a write makes one, and never rows or single shards.

    Arrivals may lack columns (their rows have nulls there), bring new ones (rows from before have nulls) and have narrower or wider
    numbers (the column becomes the wider type); others are refused with SchemaConflict before anything is written.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 256 << 20, fanout: int = 4, small_bytes: int = 1 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.small = target_bytes, fanout, small_bytes

    # -- versions

    def _names(self, folder: str) -> list[str]:
        fs, p = hadoop_path(self.spark, f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def version(self) -> int:
        """The latest version; 0 before the first write."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def _entry(self, version: int) -> dict:
        fs, p = hadoop_path(self.spark, f"{self.root}/versions/{version:012d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def schema(self, version: int | None = None) -> T.StructType:
        """The columns of one version; none before the first write."""
        version = self.version() if version is None else version
        return T.StructType.fromJson(self._entry(version)["schema"]) if version else T.StructType([])

    def manifest(self, version: int | None = None) -> DataFrame:
        """run, files, rows, bytes and born (the version that brought it) of each run of one version: the last whole manifest,
        and what the few versions since have added and taken."""
        version = self.version() if version is None else version
        added, taken, whole = [], [], None
        while version and whole is None:
            entry = self._entry(version)
            if entry["whole"]:
                whole = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{entry['whole']}")
            else:
                added += [Row(**r) for r in entry["add"]]
                taken += entry["take"]
            version -= 1
        out = self.spark.createDataFrame([r for r in added if r.run not in set(taken)], MANIFEST)
        if whole is not None:
            gone = self.spark.createDataFrame([(r,) for r in taken], "run string")
            out = whole.join(F.broadcast(gone), "run", "left_anti").select(*out.columns).unionByName(out)
        return out

    def _commit(self, version: int, schema: T.StructType, add: list[dict], take: Iterable[str] = ()) -> int:
        own, take = uuid.uuid4().hex, sorted(take)
        entry = {"schema": schema.jsonValue(), "add": add, "take": take, "whole": None}
        if version % WHOLE == 0:
            runs = self.manifest(version - 1).where(~F.col("run").isin(take)) if take else self.manifest(version - 1)
            runs = runs.unionByName(self.spark.createDataFrame([Row(**r) for r in add], MANIFEST))
            runs.coalesce(1).write.parquet(f"{self.root}/manifests/{own}")
            entry["whole"] = own
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs, draft = hadoop_path(self.spark, f"{self.root}/drafts/{own}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, final = hadoop_path(self.spark, f"{self.root}/versions/{version:012d}")
        fs.mkdirs(final.getParent())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, final, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    # -- writes

    def _write(self, df: DataFrame, version: int) -> list[dict]:
        """Writes a shard for each task and returns its line of the manifest, none without rows."""
        run = uuid.uuid4().hex
        path = f"{self.root}/data/{run}"
        df.write.option("compression", "zstd").parquet(path)
        shards = self.spark.read.schema(df.schema).parquet(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
        shards = shards.groupBy("f").agg(F.count("*").alias("rows"), F.max("b").alias("b"))
        got = shards.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("b").alias("bytes")).first()
        return [{"run": run, "files": got.files, "rows": got.rows, "bytes": got.bytes, "born": version}] if got.files else []

    def append(self, df: DataFrame) -> int:
        """Adds the rows of df as a run of small shards, without moving them; returns the new version. An arrival without rows adds none."""
        version = self.version()
        schema = merged_schema(self.schema(version), df.schema)
        if not schema.fields:
            raise SchemaConflict("an arrival without columns")
        kinds = {f.name.lower(): f for f in schema.fields}
        df = df.select(*[F.col(f"`{c}`").cast(kinds[c.lower()].dataType).alias(kinds[c.lower()].name) for c in df.columns])
        return self._commit(version + 1, schema, self._write(df, version + 1))

    def tiers(self, manifest: DataFrame) -> DataFrame:
        """The manifest with tier: by what power of the fan-out a run's shards are above the small size on average; null from three quarters of
        the target on."""
        each = F.col("bytes") / F.col("files")
        power = F.floor(F.log(F.greatest(F.lit(1.0), each / F.lit(float(self.small)))) / F.log(F.lit(float(self.fanout)))).cast("int")
        return manifest.withColumn("tier", F.when(each < 0.75 * self.target, power))

    def due(self, manifest: DataFrame) -> list[tuple[int, int, list[Row]]]:
        """(tier, shards after the merge, runs to merge) of each tier that has fan-out shards or more. No other runs reach the driver."""
        tiers: dict[int, list[Row]] = {}
        for r in self.tiers(manifest).where("tier is not null").orderBy("born", "run").collect():
            tiers.setdefault(r.tier, []).append(r)
        out = [(t, max(1, round(sum(r.bytes for r in runs) / self.target)), runs) for t, runs in sorted(tiers.items())]
        return [(t, n, runs) for t, n, runs in out if (files := sum(r.files for r in runs)) >= self.fanout and files > n]

    def _read(self, runs: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{r}" for r in runs])

    def compact(self) -> int:
        """Merges tiers until none is due; each round is one version. Shards of a tier are alike in size, so they are merged by
        handing each task its share of whole shards (coalesce), without a shuffle. Returns the latest version."""
        while todo := self.due(self.manifest(version := self.version())):
            schema, add, take = self.schema(version), [], []
            for _, n, runs in todo:
                made = self._write(self._read([r.run for r in runs], schema).coalesce(n), version + 1)
                if sum(r["rows"] for r in made) != sum(r.rows for r in runs):
                    raise RuntimeError("a merge has lost rows; nothing was committed")
                add += made
                take += [r.run for r in runs]
            self._commit(version + 1, schema, add, take)
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Deletes runs that none of the last `keep` versions names, and older versions. For times without writers. Returns runs kept."""
        latest = self.version()
        first = max(1, latest - keep + 1)
        wanted: set[str] = set()
        for v in range(first, latest + 1):
            wanted |= {r[0] for r in self.manifest(v).select("run").toLocalIterator()}
        for run in self._names("data"):
            if run not in wanted:
                fs, p = hadoop_path(self.spark, f"{self.root}/data/{run}")
                fs.delete(p, True)
        base = first  # versions since the last whole manifest are still needed
        while base > 1 and not self._entry(base)["whole"]:
            base -= 1
        whole = {self._entry(v)["whole"] for v in range(base, latest + 1)}
        for folder, gone in (("manifests", lambda n: n not in whole), ("versions", lambda n: int(n) < base), ("drafts", lambda n: True)):
            for n in filter(gone, self._names(folder)):
                fs, p = hadoop_path(self.spark, f"{self.root}/{folder}/{n}")
                fs.delete(p, True)
        return len(wanted)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, with all its columns."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError("the store has no version")
        runs = [r[0] for r in self.manifest(version).select("run").toLocalIterator()]
        schema = self.schema(version)
        return self._read(runs, schema) if runs else self.spark.createDataFrame([], schema)


def compact_arrivals(arrivals: Iterable[DataFrame], root: str, **options) -> ShardStore:
    """Appends each arrival, compacting after each, so that few small shards are left at any time; ties, repeated rows, null values and
    columns of any name are stored as they are, texts of any length too. Returns the store."""
    store = None
    for df in arrivals:
        store = store or ShardStore(df.sparkSession, root, **options)
        store.append(df)
        store.compact()
    return store


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, arriving in four lots, as the compacted store gives them back."""
    docs = table(spark, sf_dir, "documents")
    lot = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(4)), F.lit(0))
    store = compact_arrivals((docs.where(lot == k) for k in range(4)), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex[:12]}", target_bytes=128 << 20)
    store.vacuum()
    return store.read().select(
        "doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


OP4_SQL = "SELECT doc_id, lang, source, n_chars, strlen(text) AS n_bytes, md5(text) AS text_md5 FROM documents"
