"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import Scratch, join_small, table, unit_interval, word_count

#: Into how many parts the rank order is cut. Only the part in which a source's target is reached is sorted.
PARTS = 65536
#: So many parts are first summed together.
TOGETHER = 256


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeat: int) -> DataFrame:
    """(source, source_size, mass) -> the same and target. Sources by code point, null last, take the weights in
    turn. A target above max_repeat times its source stops there and the excess is shared by weight among the
    others, until none is above: the water level, found with one sort of the sources by size over weight."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("per_weight", "nth").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    full = (
        sizes.withColumn("nth", F.row_number().over(order))
        .withColumn("w", F.element_at(cycle, (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(int(max_repeat)))
        .withColumn("per_weight", F.col("source_size") / F.col("w"))
    )
    if share == 1:
        total = F.sum("source_size").over(everything)
    else:
        total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (
        full.withColumn("left", total - F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long")))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0).cast("long")))
        .withColumn("per_w", F.col("left") / F.col("w_left"))
        .withColumn("full", F.col("cap") <= F.col("per_w") * F.col("w"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("per_w"))).over(everything))
    )
    target = F.when(F.col("full") | F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return level.select("source", "source_size", "mass", target.alias("target"))


def wanted(target: Column, mass: Column, importance: Column, max_repeat: int) -> Column:
    """Copies wanted of a document, as a fraction."""
    return F.when((mass > 0) & (importance > 0), F.least(F.lit(float(max_repeat)), target * importance / mass)).otherwise(F.lit(0.0))


def reaching(hist: DataFrame, by_source: WindowSpec, order: str, before: Column | None = None) -> DataFrame:
    """The rows of each source at which the running sum of words, with `before`, has reached rest; adds that sum as upto."""
    running = F.sum("words").over(by_source.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn("upto", running if before is None else running + before).where("upto >= rest")


def mix_to_targets(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    share: float = 1.0,
    max_repeat: int = 3,
    importance: str | None = None,
    seed: str = "mix",
) -> DataFrame:
    """Chooses how often each document enters a mix whose sources have target sizes in words.

    Each document wants target * importance / (sum of size * importance in its source) copies (1 for all
    documents where no importance column is named). The whole copies in that number are certain. The
    fraction that remains is its inclusion probability p in a Pareto sample of fixed size, here in words:
    with a random number u, documents come in ascending order of (u / (1 - u)) / (p / (1 - p)), and those before the
    source's remaining words are reached are taken; the one that crosses the line is taken if that comes nearer.

    Adds (or replaces) size, source_size, target, copies and taken. u depends on seed and doc_id alone,
    so reruns agree. No source is gathered in one task: a histogram of the rank order finds the part in which
    the line lies and only that part is sorted. Defined results: null text has size 0 and is never taken;
    a null source is a source of its own; rows without doc_id draw by their text; rows equal in doc_id and text
    are taken or left together; null importance counts as 1 and negative as 0; if max_repeat stops important documents,
    their source stays below its target. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    weight = F.lit(1.0) if importance is None else F.greatest(F.lit(0.0), F.coalesce(F.col(importance).cast("double"), F.lit(1.0)))
    text = F.coalesce(F.col("text"), F.lit(""))
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary")))
    tie = F.md5(F.concat_ws("|", F.lit(f"{seed} tie"), who, text).cast("binary"))
    u = unit_interval(F.lit(seed), who)

    narrow = scratch.keep(docs.select("source", word_count(F.col("text")).alias("size"), u.alias("u"), weight.alias("a"), tie.alias("tie")), "sizes")
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("a")).alias("mass"))
    targets = scratch.keep(source_targets(sums, weights, share, max_repeat), "targets")
    n_sources = targets.count()

    t = targets.select(F.col("source").alias("t_source"), "source_size", "mass", "target")
    ranked = with_rank(join_small(narrow, t, F.col("source").eqNullSafe(F.col("t_source")), "inner", n_sources, 100), max_repeat)
    part = F.floor(F.col("rank") / (F.col("rank") + 1) * PARTS).cast("int")
    hist = ranked.where("size > 0").select(
        "source", "target", F.when(F.col("p") > 0, part).alias("part"), "size", (F.col("certain") * F.col("size")).alias("sure")
    )
    hist = hist.groupBy("source", "part").agg(F.sum("size").alias("words"), F.sum("sure").alias("sure"), F.first("target").alias("target"))
    hist = scratch.keep(hist, "histogram")
    # the line is found among parts taken together, then within those: so a source's window has no more than a few hundred rows
    by_source = Window.partitionBy("source")
    groups = hist.groupBy("source", F.floor(F.col("part") / TOGETHER).cast("int").alias("group"))
    groups = groups.agg(F.sum("words").alias("words"), F.sum("sure").alias("sure"), F.first("target").alias("target"))
    groups = groups.withColumn("rest", F.col("target") - F.sum("sure").over(by_source)).where("group is not null")
    reached = (
        reaching(groups, by_source, "group").groupBy("source")
        .agg(F.min(F.struct("group", (F.col("upto") - F.col("words")).alias("words_before"), "rest")).alias("x"))
        .select(F.col("source").alias("g_source"), F.col("x.group").alias("g_group"), F.col("x.words_before").alias("g_before"), F.col("x.rest").alias("rest"))
    )
    reached = scratch.keep(reached, "groups")
    fine = hist.where("part is not null").withColumn("group", F.floor(F.col("part") / TOGETHER).cast("int"))
    fine = join_small(fine, reached, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g_group")), "inner", n_sources, 100)
    line = scratch.keep(
        reaching(fine, by_source, "part", F.col("g_before")).groupBy("source")
        .agg(F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("words_before"), "rest")).alias("x"))
        .select("source", "x.*"), "line"
    )
    near = ranked.where("size > 0 and p > 0").withColumn("part", part)
    edge = line.select(F.col("source").alias("l_source"), F.col("part").alias("l_part"), "words_before", "rest")
    near = join_small(near, edge, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("part") == F.col("l_part")), "inner", n_sources, 100)
    near = near.groupBy("source", "rank", "tie").agg(F.sum("size").alias("words"), F.first("words_before").alias("words_before"), F.first("rest").alias("rest"))
    run = by_source.orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("words_before") + F.sum("words").over(run))
    inside = (F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("rest")) < (F.col("rest") - (F.col("upto") - F.col("words"))))
    # the last document taken, or none of its part: then all before the part
    cut = near.groupBy("source").agg(F.max(F.when(inside, F.struct("rank", "tie"))).alias("last"))
    cut = line.join(cut.withColumnRenamed("source", "c_source"), F.col("source").eqNullSafe(F.col("c_source")), "left")
    cut = scratch.keep(cut.select(F.col("source").alias("c_source"), F.col("part").alias("c_part"), F.col("last.rank").alias("c_rank"), F.col("last.tie").alias("c_tie")), "cut")
    plan = scratch.keep(
        t.join(cut, F.col("t_source").eqNullSafe(F.col("c_source")), "left").select("t_source", "source_size", "mass", "target", "c_part", "c_rank", "c_tie"), "plan"
    )

    own = ["size", "source_size", "target", "copies", "taken"]
    # names of our own could clash with extra columns, so the input's columns travel in a struct
    kept = [c for c in docs.columns if c not in own]
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "source", word_count(F.col("text")).alias("size"), u.alias("u"), weight.alias("a")
    )
    out = with_rank(join_small(named, plan, F.col("source").eqNullSafe(F.col("t_source")), "inner", n_sources, 160), max_repeat)
    row_text, row_id = F.coalesce(F.col("row.text"), F.lit("")), F.col("row.doc_id")
    row_tie = F.md5(F.concat_ws("|", F.lit(f"{seed} tie"), F.coalesce(row_id.cast("string"), F.md5(row_text.cast("binary"))), row_text).cast("binary"))
    before = F.col("c_part").isNull() | (part < F.col("c_part"))
    at = (part == F.col("c_part")) & F.col("c_rank").isNotNull() & ((F.col("rank") < F.col("c_rank")) | ((F.col("rank") == F.col("c_rank")) & (row_tie <= F.col("c_tie"))))
    chosen = F.when((F.col("p") > 0) & (F.col("size") > 0) & (before | at), 1).otherwise(0)
    copies = (F.col("certain") + chosen).cast("long")
    return out.select("row.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, each as often as mix_to_targets takes it."""
    mixed = mix_to_targets(docs.select("*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), **options)
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select("__row", times.alias("__one")).select("__row.*")


def with_rank(df: DataFrame, max_repeat: int) -> DataFrame:
    """Adds certain (whole copies), p (the fraction that remains) and rank (random odds over inclusion odds)."""
    df = df.withColumn("want", wanted(F.col("target"), F.col("mass"), F.col("a"), max_repeat))
    df = df.withColumn("certain", F.floor("want")).withColumn("p", F.col("want") - F.floor("want"))
    odds = F.col("u") / (F.lit(1.0) - F.col("u"))
    return df.withColumn("rank", F.when(F.col("p") > 0, odds / (F.col("p") / (F.lit(1.0) - F.col("p")))))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents; see mix_to_targets."""
    return mix_to_targets(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same in SQL, with one sort of each source.
OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS txt,
         coalesce(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS who
  FROM documents),
d AS (
  SELECT doc_id, source, size, md5(concat('mix tie|', who, '|', txt)) AS tie,
         ((('0x' || substr(md5(concat('mix|', who)), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM docs),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (
  SELECT source, source_size, 1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) AS w,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY source_size / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS per_w FROM n),
m AS (SELECT *, max(CASE WHEN cap > per_w * w THEN per_w END) OVER () AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN cap <= per_w * w OR level IS NULL THEN cap::DOUBLE ELSE level * w END AS target FROM m),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size::DOUBLE) ELSE 0.0::DOUBLE END AS want
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, floor(want)::BIGINT AS certain, want - floor(want) AS p,
         (u / (1.0::DOUBLE - u)) / ((want - floor(want)) / (1.0::DOUBLE - (want - floor(want)))) AS rank FROM r),
c AS (
  SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS rest,
         sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 AND size > 0 THEN 0 ELSE 1 END, rank, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM p)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN p > 0 AND size > 0 AND (upto <= rest OR upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
