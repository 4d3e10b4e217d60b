"""URL filters by a dated list, as an as-of join in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Validity intervals are classed by length: class c holds those up to BASE ** c seconds, open ones are in the last.
BASE, CLASSES = 16, 9
MICROS = 1_000_000


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dot; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    found = F.rtrim(found, F.lit("."))
    return F.when(F.length(found) > 0, found)


def path_of(url: Column) -> Column:
    """Path of an absolute URL without its leading slashes, query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """Array of (rule, weight): what entries can match a URL, the more specific the higher. Domain rules are host suffixes
    ("d:example.org"), prefix rules are a host and whole path segments ("p:example.org/a/b")."""
    host = F.coalesce(host_of(url), F.lit(""))
    labels, steps = F.split(host, r"\."), F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    n, m = F.size(labels), F.size(steps)
    domains = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")).alias("rule"), (n - i + 1).alias("weight"))
    )
    prefixes = F.transform(
        F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")).alias("rule"), (i + 1000).alias("weight")),
    )
    return F.when(host != "", F.concat(domains, prefixes)).otherwise(F.array().cast("array<struct<rule:string,weight:int>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, action, listed_at) -> (rule, action, since, until) in microseconds, until exclusive and null while it holds.

    Each entry holds until the next one of its rule. Of entries at one moment the greatest action in text order
    holds ("block" over "allow"). The next entry is sought within the month first and then among the
    months' first entries, so a rule with very many entries is spread over its months."""
    dated = entries.where("rule is not null and action is not null and listed_at is not null")
    dated = dated.groupBy("rule", F.unix_micros(F.col("listed_at").cast("timestamp")).alias("since")).agg(F.max("action").alias("action"))
    dated = dated.withColumn("month", F.floor(F.col("since") / (30 * 86400 * MICROS)))
    firsts = dated.groupBy("rule", "month").agg(F.min("since").alias("first"))
    firsts = firsts.withColumn("next_month", F.lead("first").over(Window.partitionBy("rule").orderBy("month"))).drop("first")
    inside = F.lead("since").over(Window.partitionBy("rule", "month").orderBy("since"))
    out = dated.withColumn("inside", inside).join(firsts, ["rule", "month"])
    return out.select("rule", "action", "since", F.coalesce("inside", "next_month").alias("until"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """The rows of captures with blocked, rule and since (timestamp): what the list said of each URL when it was fetched.

    Of all entries active at that time whose rule matches, the most specific decides: path prefixes over domains,
    longer over shorter. Intervals are placed in bins as wide as the bound of their length class, two bins at most, and
    since a rule's intervals do not overlap, a bin holds few of them: a capture meets a bounded number of intervals
    in each class, whatever the length of the list. Equal (URL, time) pairs are evaluated once.

    Defined results: a null or relative URL, or a null time, is not blocked; incomplete entries are ignored; an
    empty list blocks nothing; captures may have any other columns (of the names blocked, rule and since, the result's replace them).
    """
    spark = captures.sparkSession
    scratch = Scratch(spark, "urls")
    spans = intervals(entries)
    length = F.col("until") - F.col("since")
    kind = sum((F.when(length <= BASE**c * MICROS, 0).otherwise(1) for c in range(CLASSES - 1)), F.lit(0))
    width = F.element_at(F.array(*[F.lit(BASE**c * MICROS).cast("long") for c in range(CLASSES)]), F.col("kind") + 1)
    spans = spans.withColumn("kind", F.when(F.col("until").isNull(), CLASSES - 1).otherwise(kind)).withColumn("w", width)
    last = F.when(F.col("until").isNull(), F.floor(F.col("since") / F.col("w")) + 1).otherwise(F.floor((F.col("until") - 1) / F.col("w")))
    spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("since") / F.col("w")), last))).drop("w")
    spans = scratch.keep(spans, "intervals")
    kinds = sorted(r[0] for r in spans.select("kind").distinct().collect())  # CLASSES numbers at most

    row = F.struct(*[F.col(f"`{c}`") for c in captures.columns if c not in ("blocked", "rule", "since")]).alias("row")
    captures = captures.select(row, F.col(f"`{url}`").cast("string").alias("u"), F.unix_micros(F.col(f"`{fetched_at}`").cast("timestamp")).alias("t"))
    asked = captures.where("u is not null and t is not null").select("u", "t").distinct()
    asked = asked.select("u", "t", F.explode(keys_of(F.col("u"))).alias("k")).select("u", "t", "k.*")
    at = F.array(*[F.struct(F.lit(c).alias("kind"), F.floor(F.col("t") / F.lit(BASE**c * MICROS)).alias("bin")) for c in kinds])
    none = F.array().cast("array<struct<kind:int,bin:bigint>>")
    asked = asked.withColumn("at", F.explode(at if kinds else none)).select("u", "t", "rule", "weight", "at.*")
    said = asked.join(spans, ["rule", "kind", "bin"]).where("since <= t and (until is null or t < until)")
    said = said.groupBy("u", "t").agg(F.max(F.struct("weight", "rule", "action", "since")).alias("best"))
    said = said.select(F.col("u").alias("su"), F.col("t").alias("st"), "best")
    out = captures.join(said, (F.col("u") == F.col("su")) & (F.col("t") == F.col("st")), "left")
    return out.select(
        "row.*",
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
        F.col("best.rule").alias("rule"),
        F.timestamp_micros("best.since").alias("since"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with a time of fetching. The table has none, so it follows from page_id: minutes of the year 2024."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(525600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + minute * 60).alias("fetched_at"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list for these pages: two domains blocked for part of the year, and for each host, by digits of its MD5,
    a block, for half of them lifted later, and an exempt language folder."""
    fixed = [("d:example.net", "block", 60), ("d:example.net", "allow", 200), ("d:casino-win.example.com", "block", 10)]
    spark = pages.sparkSession
    days = spark.createDataFrame(fixed, "rule string, action string, day int")
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    digit = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 4), 16, 10).cast("int")
    hosts = hosts.withColumn("d", digit)
    block = hosts.where("d % 3 = 0").select(F.concat(F.lit("d:"), "host").alias("rule"), F.lit("block").alias("action"), (F.col("d") % 180).alias("day"))
    lift = hosts.where("d % 6 = 0").select(F.concat(F.lit("d:"), "host").alias("rule"), F.lit("allow").alias("action"), (F.col("d") % 150 + 190).alias("day"))
    spare = hosts.where("d % 3 = 0").select(F.concat(F.lit("p:"), "host", F.lit("/en")).alias("rule"), F.lit("allow").alias("action"), F.lit(30).alias("day"))
    every = days.unionByName(block).unionByName(lift).unionByName(spare)
    return every.select("rule", "action", F.timestamp_seconds(F.lit(1704067200) + F.col("day") * 86400).alias("listed_at"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluates every page against the list as it was when the page was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(page_captures(pages), page_entries(pages))
    return out.select("page_id", F.unix_seconds("fetched_at").alias("fetched_s"), "blocked", "rule", F.unix_seconds("since").alias("since_s"))


OP1_SQL = r"""
WITH c AS (
  SELECT page_id, url, 1704067200 + ((page_id * 7919) % 525600) * 60 AS t,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps
  FROM pages),
h AS (SELECT DISTINCT host, (('0x' || substr(md5(host), 1, 4))::INT) AS d FROM c WHERE host IS NOT NULL),
e AS (
  SELECT 'd:example.net' AS rule, 'block' AS action, 60 AS day UNION ALL SELECT 'd:example.net', 'allow', 200
  UNION ALL SELECT 'd:casino-win.example.com', 'block', 10
  UNION ALL SELECT 'd:' || host, 'block', d % 180 FROM h WHERE d % 3 = 0
  UNION ALL SELECT 'd:' || host, 'allow', d % 150 + 190 FROM h WHERE d % 6 = 0
  UNION ALL SELECT 'p:' || host || '/en', 'allow', 30 FROM h WHERE d % 3 = 0),
s AS (SELECT rule, 1704067200 + day::BIGINT * 86400 AS since, max(action) AS action FROM e GROUP BY ALL),
v AS (SELECT *, lead(since) OVER (PARTITION BY rule ORDER BY since) AS until FROM s),
k AS (
  SELECT page_id, t, 'd:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS rule, len(string_split(host, '.')) - i + 1 AS weight
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host IS NOT NULL)
  UNION ALL
  SELECT page_id, t, 'p:' || host || '/' || array_to_string(list_slice(steps, 1, i), '/'), 1000 + i
  FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM c WHERE host IS NOT NULL)),
m AS (
  SELECT page_id, t, k.rule, action, since, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, k.rule DESC) AS nth
  FROM k JOIN v ON k.rule = v.rule AND since <= t AND (until IS NULL OR t < until))
SELECT c.page_id, c.t AS fetched_s, coalesce(m.action = 'block', false) AS blocked, m.rule, m.since AS since_s
FROM c LEFT JOIN m ON c.page_id = m.page_id AND nth = 1
"""
