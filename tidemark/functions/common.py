"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def js_round(x: Column, digits: int = 2) -> Column:
    """Half up towards plus infinity, as floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def steady(x: Column) -> Column:
    """x to four decimals, off the exact ties that sums in another order would tip."""
    return F.floor(x * 1e4 + 0.5001) / 1e4


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within [low, high]; nulls, NaN and infinities go to low."""
    odd = x.isNull() | F.isnan(x) | (x == float("inf")) | (x == float("-inf"))
    return F.when(odd, F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def mean0(x: Column) -> Column:
    """Average, 0 of nothing."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def deterministic_id(*parts: Column | str) -> Column:
    """Digest of the parts joined by colons; a null part counts as a character that text does not hold."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]
    return F.sha2(F.concat_ws(":", *cols), 256)


def wilson_lower(wins: Column, n: Column, z: float = 1.959963984540054) -> Column:
    p = wins / n
    z2 = z * z
    low = (p + z2 / (2 * n) - z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)).otherwise(F.lit(0.0))


def wilson_upper(p: Column, n: Column, z: float = 1.645) -> Column:
    z2 = z * z
    high = (p + z2 / (2 * n) + z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    return F.when(n > 0, F.least(F.lit(1.0), high)).otherwise(F.lit(1.0))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


#: What a task sorts without spilling.
TASK_ROWS = 1_000_000


def tasks_for(spark: SparkSession, n: int) -> int | None:
    """To how many tasks n rows are dealt for a sort; None: the session's own number does."""
    tasks = -(-n // TASK_ROWS)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def running(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], low: Column, high: Column, at: str, width: int) -> DataFrame:
    """Inner join: rows of right of equal keys whose ``at`` lies in [low, high].

    Both sides get a time bucket of ``width``; a left row is copied to each
    bucket that its interval meets, so a hot key spreads over its buckets.
    Columns of right other than keys must not clash with those of left.
    """
    rows = left.withColumn("_low", low).withColumn("_high", high)
    first, last = F.floor(F.col("_low") / width), F.floor(F.col("_high") / width)
    probe = rows.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    build = right.withColumn("_bucket", F.floor(F.col(at) / width))
    inside = probe.join(build, [*keys, "_bucket"]).where((F.col(at) >= F.col("_low")) & (F.col(at) <= F.col("_high")))
    return inside.drop("_low", "_high", "_bucket")


def near_row(left: DataFrame, right: DataFrame, keys: Sequence[str], bound: Column, at: str, ties: Sequence[str], width: int, name: str, back: bool = False) -> DataFrame:
    """left plus the struct ``name``: of the rows of right of equal keys the first by (at, ties) with at >= bound, null if none; back: the last with at <= bound.

    One pass in order instead of a join of rows: both sides are cut to time
    buckets of ``width``, a bucket is sorted once, and the last row seen is kept.
    Where the bucket has none, the next bucket's first row stands, of one row
    per key and bucket. So work grows with the rows of both sides.
    """
    keys, best, turn = list(keys), F.max if back else F.min, F.asc if back else F.desc
    rest = [c for c in right.columns if c not in (*keys, at, *ties)]
    sound = F.col(at).isNotNull()
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    build = right.where(sound).select(*keys, F.col(at).alias("_at"), F.struct(at, *ties, *rest).alias("_right"))
    probe = left.select(*keys, bound.alias("_at"), F.struct(*left.columns).alias("_left"))
    rows = build.withColumn("_left", F.lit(None).cast(probe.schema["_left"].dataType)).unionByName(probe.withColumn("_right", F.lit(None).cast(build.schema["_right"].dataType)))
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / width))
    # a row of right comes before the rows of left with the same time
    order = [turn("_at"), F.col("_left").isNotNull(), *[turn(F.col("_right")[c]) for c in ties]]
    seen = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("_near", F.last("_right", ignorenulls=True).over(seen)).where("_left IS NOT NULL")
    before = Window.partitionBy(*keys).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_bucket").agg(best("_right").alias("_end")).withColumn("_end", F.last("_end", ignorenulls=True).over(before))
    ends = ends.where("_end IS NOT NULL AND _bucket IS NOT NULL")
    found = near.join(ends, [*keys, "_bucket"], "left")
    there = F.when(F.col("_at").isNotNull(), F.coalesce("_near", "_end"))
    return found.select("_left.*", there.alias(name))
