"""The grid of candidate rules: thresholds from the records' own lower quantiles, crossed with cohorts.

Quantiles are exact order statistics of any number of records without a sort
of all: values are counted per bucket of a 64th octave, then only the buckets
that hold a wanted place are counted in 4,096 parts, then only the values of
the parts that hold one. Windows see counts of buckets, never the records.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import js_round
from tidemark.functions.scratch import stored

FREE = float("inf")
FINE = 4096
MOST_THRESHOLDS = 6
MOST_CANDIDATES = 12_000


class Axis(NamedTuple):
    """A column that is bounded, from which side, the quantiles that bound it and fixed bounds (FREE: none)."""

    column: str
    quantiles: Sequence[float]
    fixed: Sequence[float]


#: What the search tries beside the quantiles.
AXES = (
    Axis("liquidity_usd", (0.0, 0.25, 0.5, 0.75, 0.9), (0, 10_000, 20_000, 50_000)),
    Axis("volume_usd", (0.0, 0.25, 0.5, 0.75, 0.9), (0, 5_000, 10_000, 25_000, 50_000)),
    Axis("swaps", (0.25, 0.5, 0.75, 0.9, 1.0), (50, 100, 300, 600, FREE)),
    Axis("volume_per_liquidity", (0.25, 0.5, 0.75, 0.9), (1, 2, 4, 8, FREE)),
)
#: Cohort, whether its flow is balanced already (liquidity, ratio and age stay free), least numbers of repeat wallets.
COHORTS = (
    ("all", False, (0, 1, 2, 3)),
    ("controlled", False, (0, 1, 2, 3)),
    ("repeat-controlled", False, (2, 3)),
    ("control-only", False, (0, 1, 2, 3)),
    ("balanced", True, (0, 1, 2, 3)),
    ("repeat-balanced", True, (2, 3)),
    ("balanced-control", True, (0, 1, 2, 3)),
    ("excluded", False, (0, 1, 2, 3)),
)
SHARES = ((0.0, 1.0), (0.4, 0.9), (0.45, 0.85), (0.5, 0.85), (0.55, 0.8), (0.6, 0.8))
AGES = (20.0, 40.0, 120.0, FREE)


def _holding(counts: DataFrame, wanted: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The row of counts (keys, by, n) that holds each wanted rank, with the rank within it."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = counts.withColumn("_before", before).join(F.broadcast(wanted), list(keys)).where("rank >= _before AND rank < _before + n")
    return met.withColumn("rank", F.col("rank") - F.col("_before")).drop("_before", "n")


def lower_quantiles(rows: DataFrame, wanted: dict[str, Sequence[float]]) -> DataFrame:
    """(column, q, value): sorted[floor((n - 1) q)] of the finite values from 0 on; columns without any give no row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in wanted]))
    values = stored(rows.select(pairs.alias("p")).select("p.*").where((F.col("value") >= 0) & (F.col("value") < FREE)))
    values = values.withColumn("octave", F.when(F.col("value") > 0, F.floor(F.log2("value") * 64)).otherwise(-(1 << 20)))
    sizes = stored(values.groupBy("column", "octave").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))
    asked = rows.sparkSession.createDataFrame([(c, float(q)) for c, qs in wanted.items() for q in qs], "column string, q double")
    whole = sizes.groupBy("column").agg(F.sum("n").alias("n"))
    asked = asked.join(whole, "column").select("column", "q", F.floor((F.col("n") - 1) * F.col("q")).alias("rank"))
    first = stored(_holding(sizes, asked, ["column"], "octave"))
    width = F.col("high") - F.col("low")
    inside = values.join(F.broadcast(first.select("column", "octave", "low", "high").distinct()), ["column", "octave"])
    inside = inside.withColumn("part", F.when(width > 0, F.floor((F.col("value") - F.col("low")) / width * FINE)).otherwise(0))
    count = F.count(F.lit(1)).alias("n")
    second = stored(_holding(inside.groupBy("column", "octave", "part").agg(count), first.drop("low", "high"), ["column", "octave"], "part"))
    place = ["column", "octave", "part"]
    last = inside.join(F.broadcast(second.select(*place).distinct()), place).groupBy(*place, "value").agg(count)
    return _holding(last, second, place, "value").select("column", "q", "value")


def thresholds(rows: DataFrame, axes: Sequence[Axis] = AXES, most: int = MOST_THRESHOLDS) -> DataFrame:
    """(column, threshold): quantiles and fixed values of each axis to two decimals, distinct, the first ``most``; FREE, where given, is one of them.

    Quantiles of a column without values are 0. Negative values are no thresholds. At most ``most`` rows an axis.
    """
    spark = rows.sparkSession
    asked = spark.createDataFrame([(a.column, float(q)) for a in axes for q in a.quantiles], "column string, q double")
    found = lower_quantiles(rows, {a.column: a.quantiles for a in axes})
    # beyond 1e15 doubles hold no cents, and a scaled value leaves the longs
    cents = F.when(F.col("value") < 1e15, js_round(F.col("value"))).otherwise(F.col("value"))
    lower = asked.join(found, ["column", "q"], "left").select("column", F.coalesce(cents, F.lit(0.0)).alias("threshold"))
    given = spark.createDataFrame([(a.column, float(x)) for a in axes for x in a.fixed], "column string, threshold double")
    every = lower.unionByName(given).where("threshold >= 0").distinct().withColumn("free", F.col("threshold") == FREE)
    place = F.row_number().over(Window.partitionBy("column", "free").orderBy("threshold"))
    any_free = F.max(F.col("free").cast("int")).over(Window.partitionBy("column"))
    kept = every.withColumn("_place", place).withColumn("_most", F.greatest(F.lit(1), F.lit(most) - any_free))
    return kept.where("free OR _place <= _most").select("column", "threshold")


def shown(x: Column) -> Column:
    """A bound as text: no zeros after the last decimal, a free one as inf."""
    return F.when(x == FREE, "inf").otherwise(F.regexp_replace(x.cast("decimal(38,2)").cast("string"), r"\.?0+$", ""))


def candidate_grid(levels: DataFrame, cohorts: Sequence[tuple[str, bool, Sequence[int]]] = COHORTS, shares: Sequence[tuple[float, float]] = SHARES, ages: Sequence[float] = AGES) -> DataFrame:
    """Every rule: cohort x repeat wallets x thresholds x shares x ages, with label, id (of the label) and whether it is a baseline, free in all.

    ``levels`` are the thresholds of AXES' columns. Rules hang on parameters alone, so their number does not grow with the records.
    """
    names = [a.column for a in AXES]
    row = levels.groupBy().agg(*[F.sort_array(F.collect_list(F.when(F.col("column") == c, F.col("threshold")))).alias(f"of_{c}") for c in names])
    some = F.array(*[F.struct(F.lit(n).alias("cohort"), F.lit(b).alias("balanced"), F.array(*map(F.lit, r)).alias("repeats")) for n, b, r in cohorts])
    free, zero = F.array(F.lit(FREE)), F.array(F.lit(0.0))
    steps = {
        "min_repeat": F.col("repeats"),
        "min_liquidity_usd": F.when(F.col("balanced"), zero).otherwise(F.col("of_liquidity_usd")),
        "min_volume_usd": F.col("of_volume_usd"),
        "max_swaps": F.col("of_swaps"),
        "max_ratio": F.when(F.col("balanced"), free).otherwise(F.col("of_volume_per_liquidity")),
        "max_age": F.when(F.col("balanced"), free).otherwise(F.array(*map(F.lit, ages))),
        "share": F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in shares]),
    }
    out = row.withColumn("one", F.explode(some)).select("*", "one.*").drop("one")
    for i, (name, of) in enumerate(steps.items()):
        out = out.withColumn(name, F.explode(of))
        if i == 2:  # from one row, so that the rest runs on all cores
            out = out.repartition(*list(steps)[:3])
    out = out.select("cohort", *list(steps)[:-1], F.col("share.low").alias("min_share"), F.col("share.high").alias("max_share"))
    parts = {
        "repeat>=": F.col("min_repeat").cast("string"), "liq>=": shown(F.col("min_liquidity_usd")), "vol5m>=": shown(F.col("min_volume_usd")),
        "buyShare=": F.concat_ws("-", shown(F.col("min_share")), shown(F.col("max_share"))), "swaps<=": shown(F.col("max_swaps")), "vlr<=": shown(F.col("max_ratio")), "age<=": shown(F.col("max_age")),
    }
    out = out.withColumn("label", F.concat_ws(" / ", "cohort", *[F.concat(F.lit(k), v) for k, v in parts.items()]))
    least = (F.col("min_repeat") == 0) & (F.col("min_liquidity_usd") == 0) & (F.col("min_volume_usd") == 0) & (F.col("min_share") == 0) & (F.col("max_share") == 1)
    baseline = least & (F.col("max_swaps") == FREE) & (F.col("max_ratio") == FREE) & (F.col("max_age") == FREE)
    return out.withColumn("id", F.substring(F.sha2("label", 256), 1, 16)).withColumn("baseline", baseline)


def bounded(grid: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The grid, or ``most`` of it: baselines first, then by id, so that a rule's place does not hang on the order of the axes."""
    return grid.orderBy(F.desc("baseline"), "id").limit(most)
