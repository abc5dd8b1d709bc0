"""A compact star: dimensions with surrogate ids, and facts kept by day that are merged with what is stored.

Facts are compared by key: those not stored yet are inserts, those with other values
changes, and stored ones that are wanted no more removals. Only days in which one of
these lies are written again, each whole; all others keep their files, so a second
run over the same rows writes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import deterministic_id
from tidemark.functions.scratch import stored


def dimension(*sources: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """The distinct values of columns over all sources, with the id ``name``; nulls are values of their own."""
    out = sources[0].select(*columns)
    for s in sources[1:]:
        out = out.unionByName(s.select(*columns))
    return out.distinct().withColumn(name, deterministic_id(*[F.col(c) for c in columns]))


def changes(kept: DataFrame, wanted: DataFrame, keys: Sequence[str], values: Sequence[str], day: str = "day") -> DataFrame:
    """(keys, day, was_day, op) of the facts that differ: insert, change (values or day) or remove; keys are unique and not null."""
    old = kept.select(*keys, F.col(day).alias("was_day"), F.struct(*values).alias("_old"), F.lit(True).alias("_had"))
    new = wanted.select(*keys, day, F.struct(*values).alias("_new"), F.lit(True).alias("_has"))
    both = new.join(old, list(keys), "full")
    same = F.col("_new").eqNullSafe(F.col("_old")) & F.col(day).eqNullSafe(F.col("was_day"))
    op = F.when(F.col("_had").isNull(), "insert").when(F.col("_has").isNull(), "remove").when(~same, "change")
    return both.withColumn("op", op).where("op IS NOT NULL").select(*keys, day, "was_day", "op")


def merge(wanted: DataFrame, path: str, keys: Sequence[str], values: Sequence[str], day: str = "day") -> dict[str, int]:
    """Bring the facts under path (partitioned by day) to what is wanted; how many facts were inserted, changed and removed, and how many days written.

    Days are calendar days, so their list is short enough for the driver.
    """
    spark = wanted.sparkSession
    wanted = wanted.select(*keys, *values, day)
    try:
        kept = spark.read.schema(wanted.schema).parquet(path)
    except AnalysisException:
        kept = wanted.where("false")
    found = stored(changes(kept, wanted, keys, values, day))
    counts = {r["op"]: r["count"] for r in found.groupBy("op").count().collect()}
    days = {r[0] for r in found.select(day).union(found.select("was_day")).distinct().collect()} - {None}
    if days:
        rows = stored(wanted.where(F.col(day).isin(sorted(days))))
        rows.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
        # overwriting by partition leaves alone the days that have no rows any more
        for gone in days - {r[0] for r in rows.select(day).distinct().collect()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={gone}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return {"inserted": counts.get("insert", 0), "changed": counts.get("change", 0), "removed": counts.get("remove", 0), "days": len(days)}
