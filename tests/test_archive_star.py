"""Archives that prove themselves, and facts merged by day."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import archive, star


@pytest.fixture
def lines(spark):
    rows = [(d, k, f"{k}-é-{i % 40}") for d in (1, 2) for k in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "day long, kind string, name string")
    return archive.json_lines(df, F.col("day"), F.col("kind"), ["name"])


def statuses(stated, frames):
    return {(r.day, r.kind): r.status for r in archive.verify(stated, frames).collect()}


def test_round_trip_whatever_the_cut(spark, lines, tmp_path, monkeypatch):
    stated = archive.write(lines, str(tmp_path / "one"))
    frames = archive.read_frames(spark, str(tmp_path / "one"))
    assert set(statuses(stated, frames).values()) == {"verified"} and stated.count() == 4
    back = archive.unpack(frames)
    assert sorted(r.line for r in back.collect()) == sorted(r.line for r in lines.collect()) and not back.where("broken").count()
    # other order and smaller frames: another archive of the same source
    monkeypatch.setattr(archive, "FRAME_BYTES", 50)
    again = archive.write(lines.orderBy(F.desc("line")).coalesce(1), str(tmp_path / "two"))
    first = {(r.day, r.kind): r for r in stated.collect()}
    for r in again.collect():
        assert (r.rows, r.bytes, r.source_sha256) == (first[r.day, r.kind].rows, first[r.day, r.kind].bytes, first[r.day, r.kind].source_sha256) and r.frames > first[r.day, r.kind].frames


def test_what_is_wrong_is_found(spark, lines, tmp_path):
    stated = archive.write(lines, str(tmp_path / "s"))
    frames = archive.read_frames(spark, str(tmp_path / "s"))
    bad = F.unhex(F.concat(F.substring(F.hex("frame"), 1, 30), F.lit("00"), F.expr("substring(hex(frame), 33)")))
    changed = frames.withColumn("frame", F.when((F.col("day") == 1) & (F.col("kind") == "a"), bad).otherwise(F.col("frame")))
    missing = changed.where("NOT (day = 2 AND kind = 'b')").unionByName(frames.where("day = 2 AND kind = 'a'").withColumn("day", F.lit(3).cast("long")))
    got = statuses(stated, missing)
    assert got == {(1, "a"): "broken", (1, "b"): "verified", (2, "a"): "verified", (2, "b"): "missing", (3, "a"): "unknown"}
    # a line once more is another segment
    more = archive.pack(lines.unionByName(lines.where("day = 1 AND kind = 'b'").limit(1)))
    assert statuses(stated, more)[1, "b"] == "changed"


def test_nothing_to_archive(spark, lines, tmp_path):
    assert archive.manifest(lines.where("false"), archive.pack(lines.where("false"))).count() == 0


def facts(spark, rows):
    return spark.createDataFrame(rows, "k string, v double, w string, day int")


def content(spark, path):
    return sorted((r.k, r.v, r.w, r.day) for r in spark.read.parquet(path).collect())


def test_merge_writes_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "facts")
    merge = lambda rows: star.merge(facts(spark, rows), path, ["k"], ["v", "w"])
    rows = [("a", 1.0, None, 1), ("b", 2.0, "x", 1), ("c", 3.0, "y", 2), ("d", None, "z", 3)]
    assert merge(rows) == {"inserted": 4, "changed": 0, "removed": 0, "days": 3}
    files = {f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert merge(rows[::-1]) == {"inserted": 0, "changed": 0, "removed": 0, "days": 0}
    assert files == {f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    # one value changes, one fact goes with its day, one moves to another day, one comes
    after = [("a", 1.0, "new", 1), ("b", 2.0, "x", 1), ("c", 3.0, "y", 4), ("e", 5.0, None, 1)]
    assert merge(after) == {"inserted": 1, "changed": 2, "removed": 1, "days": 4}
    assert content(spark, path) == sorted(after)
    assert merge([]) == {"inserted": 0, "changed": 0, "removed": 4, "days": 2} and not [d for d in os.listdir(path) if d.startswith("day=")]


def test_dimension_keeps_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    out = star.dimension(rows, columns=["x", "y"], name="id").collect()
    assert len(out) == 2 and len({r.id for r in out}) == 2
