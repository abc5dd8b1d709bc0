"""Tables in the shared folder."""

import os
import time

from pyspark.sql import functions as F

from tidemark.functions.common import TASK_ROWS, tasks_for
from tidemark.functions.scratch import FREE, stored


def shuffled(spark):
    """Bytes of shuffle files on disk."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(at, f)) for d in dirs for at, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_"))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, set_to = shuffled(spark), spark.conf.get(FREE, "false")
    rows = stored(spark.range(1_000_000).select(F.xxhash64("id").alias("h")).repartition(4, "h"))
    for _ in range(50):
        if shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled(spark) <= before and rows.count() == 1_000_000
    assert spark.conf.get(FREE, "false") == set_to


def test_tasks_grow_with_the_rows(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, own * TASK_ROWS) is None and tasks_for(spark, own * TASK_ROWS + 1) == own + 1
