"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; its own only where all run in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Shuffle files of an execution go when it ends, not when the driver next collects garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what several branches read is worked out once and survives lost executors.

    The table is all that stays on disk of the work behind it.
    """
    spark = df.sparkSession
    at, before = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}", spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(at)
