"""Mixing sources to target weights (operator 5).

Sizes are aggregated per source, each source gets a repetition rate
``target / size``, and a document is emitted ``floor(rate)`` times plus one more
with probability ``rate - floor(rate)``; the draw is a hash of the document id
and a seed, so reruns and retried tasks agree.

Only the per-source table (one row per source) passes through an unpartitioned
window. It reaches the documents by a join on (source, salt), so one source
with most of the rows still spreads over all tasks.

Nulls: a null text has size 0, a null source is a source of its own and sorts
last, a null doc_id draws like the empty string. Rows with one doc_id draw
alike. Texts of any length are one document. An empty table gives an empty mix.
``emit_mix`` carries all columns along, whatever their names; in ``plan_mix`` the
operator's own columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, beside, by_place, read_documents

#: Weights of the sources in their sort order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix as a share of all sizes, and the most often a source may repeat.
SHARE, MOST = 1.5, 2.0
SALTS = 32
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source (columns source, source_size) its target: shares by weight, none above ``most`` times its size.

    Sharing out, capping and sharing the excess again ends where every source
    has min(cap, weight * level). Sorted by cap / weight the capped sources come
    first, so two running sums give the level without a loop.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    rise = Window.orderBy((F.col("cap") / F.col("weight")), F.col("place"))
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    after = rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    named = F.array(*[F.lit(int(w)) for w in weights])
    out = sizes.withColumn("place", F.row_number().over(rank))
    out = out.withColumn("weight", F.element_at(named, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    out = out.withColumn("cap", F.lit(most) * F.col("source_size"))
    out = out.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
    out = out.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    out = out.withColumn("own", F.col("left") / F.sum("weight").over(after))
    out = out.withColumn("open", F.col("weight") * F.col("own") < F.col("cap"))
    # all sources from the first open one on share its level
    whole = rise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("level", F.first(F.when(F.col("open"), F.col("own")), ignorenulls=True).over(whole))
    return out.select("source", "source_size", F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("cap")).alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the document id and the seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


OWN = ("size", "source_size", "target", "copies")


def _planned(docs: DataFrame, weights: Sequence[int], share: float, most: float, seed: str) -> DataFrame:
    """row (all columns of docs, by place) and the columns of OWN."""
    docs, names = by_place(docs, "doc_id", "source", "text"), [f"o_{i}" for i in range(len(docs.columns))]
    per_source = docs.groupBy("source").agg(F.sum(size_of(F.col("text"))).alias("source_size"))
    targets = source_targets(per_source, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target", rate.alias("rate"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t_salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    rows = docs.select(F.struct(*names).alias("row"), size_of(F.col("text")).alias("size"), salt.alias("salt"), F.col("source").alias("of"), draw(F.col("doc_id"), seed).alias("drawn"))
    joined = rows.join(targets, F.col("of").eqNullSafe(F.col("t_source")) & (F.col("salt") == F.col("t_salt")))
    whole = F.floor("rate")
    return joined.select("row", "size", "source_size", "target", (whole + (F.col("drawn") < F.col("rate") - whole).cast("int")).cast("int").alias("copies"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """docs plus size, source_size, target, copies: how often the mix takes each document."""
    at = {c: f"o_{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    return _planned(docs, weights, share, most, seed).select(*[F.col("row").getField(at[c]).alias(c) for c in beside(docs.columns, OWN)], *OWN)


def emit_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as its plan says, with their own columns."""
    planned = _planned(docs, weights, share, most, seed).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(read_documents(spark, sf_dir))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS budget FROM r
), q AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w
), o AS (
  SELECT *, weight * (l / rest) < cap AS open FROM q
), t AS (
  SELECT source, source_size, CASE WHEN open THEN weight * (SELECT arg_min(l / rest, cap / weight) FROM o WHERE open AND place =
           (SELECT arg_min(place, (cap / weight, place)) FROM o WHERE open)) ELSE cap END AS target FROM o
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
