"""Archive segments: a day and kind of records as zstd JSON lines, with a manifest that proves what was read back.

A segment is a number of frames, each a zstd stream of whole lines with a checksum
of its own, written as rows of a table partitioned by day and kind; frames one after
the other are one .zst file. Frames are cut by size within tasks, so no segment
passes through one task. The source digest of a segment depends on its lines, each
with its number of repeats, but neither on their order nor on the cut: it is the
SHA-256 of the number of lines and bytes and of the sums of parts of every line's
own SHA-256. The archive digest is that of the frames' digests in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL, FRAME_BYTES = 3, 4_000_000
#: Parts of a line's digest: four of fifteen hexadecimal digits.
PARTS, DIGITS = 4, 15
FRAMES = "day long, kind string, rows long, bytes long, frame binary, frame_sha256 string"


def json_lines(rows: DataFrame, day: Column, kind: Column, columns: Sequence[str]) -> DataFrame:
    """(day, kind, line): the columns of each row as one line of JSON, nulls left out."""
    return rows.select(day.cast("long").alias("day"), kind.cast("string").alias("kind"), F.to_json(F.struct(*columns)).alias("line"))


def _frames(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of about ``most`` bytes of rows (day, kind, line) in order of day and kind."""
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    of, lines, size = None, [], 0

    def out() -> pa.RecordBatch:
        data = b"".join(line + b"\n" for line in lines)
        frame = compressor.compress(data)
        row = [*of, len(lines), len(data), frame, hashlib.sha256(frame).hexdigest()]
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in FRAMES.split(", ")])

    for batch in batches:
        for day, kind, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lines and (of != (day, kind) or size >= most):
                yield out()
                lines, size = [], 0
            of = day, kind
            lines.append(line.encode())
            size += len(lines[-1]) + 1
    if lines:
        yield out()


def pack(lines: DataFrame) -> DataFrame:
    """FRAMES of rows (day, kind, line); a day's lines are dealt over tasks by their hash, and sorted within each."""
    dealt = lines.repartition(F.col("day"), F.col("kind"), F.pmod(F.xxhash64("line"), F.lit(32))).sortWithinPartitions("day", "kind", "line")
    most = FRAME_BYTES
    return dealt.mapInArrow(lambda batches: _frames(most, batches), FRAMES)


def source_digest(line: Column, rows: Column, size: Column) -> Column:
    """Aggregate: digest of the lines of a group, whatever their order; rows and size are their number and bytes."""
    own = F.sha2(line, 256)
    sums = [F.sum(F.conv(F.substring(own, 1 + DIGITS * k, DIGITS), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(PARTS)]
    return F.sha2(F.concat_ws(":", rows.cast("string"), size.cast("string"), *sums), 256)


def _summary(lines: DataFrame) -> DataFrame:
    rows, size = F.count(F.lit(1)), F.sum(F.octet_length("line") + 1)
    return lines.groupBy("day", "kind").agg(rows.alias("rows"), size.cast("long").alias("bytes"), source_digest(F.col("line"), rows, size).alias("source_sha256"))


def manifest(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """Per segment what its source holds (rows, bytes, digest) and what was packed (frames, archive bytes, digest)."""
    packed = frames.groupBy("day", "kind").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.octet_length("frame")).cast("long").alias("archive_bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list("frame_sha256")), ""), 256).alias("archive_sha256")
    )
    return _summary(lines).join(packed, ["day", "kind"])


def write(lines: DataFrame, path: str) -> DataFrame:
    """Write the segments under path (frames and manifest) and return the manifest, read back."""
    spark = lines.sparkSession
    pack(lines).write.partitionBy("day", "kind").option("compression", "none").parquet(f"{path}/frames")
    manifest(lines, read_frames(spark, path)).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(f"{path}/frames")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(day, kind, line, broken) of frames; a frame that its digest or its checksum disowns gives one broken row."""
    names = ["day", "kind", "line", "broken"]
    for batch in batches:
        for day, kind, _, size, frame, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                if hashlib.sha256(frame).hexdigest() != sha:
                    raise zstandard.ZstdError("digest")
                found, broken = zstandard.ZstdDecompressor().decompress(frame, max_output_size=size).split(b"\n")[:-1], False
                text = [x.decode() for x in found]
            except (zstandard.ZstdError, UnicodeDecodeError):
                text, broken = [""], True
            n = len(text)
            yield pa.RecordBatch.from_arrays([pa.array([day] * n, pa.int64()), pa.array([kind] * n, pa.string()), pa.array(text, pa.string()), pa.array([broken] * n)], names)


def unpack(frames: DataFrame) -> DataFrame:
    """(day, kind, line, broken) of frames."""
    return frames.select(*[c.split()[0] for c in FRAMES.split(", ")]).mapInArrow(_lines, "day long, kind string, line string, broken boolean")


def verify(stated: DataFrame, frames: DataFrame) -> DataFrame:
    """The manifest's segments, and any that it does not know, with status: verified, changed, broken, missing or unknown."""
    lines = unpack(frames)
    broken = lines.where("broken").groupBy("day", "kind").agg(F.count(F.lit(1)).alias("broken_frames"))
    found = manifest(lines.where("NOT broken"), frames)
    names = ("rows", "bytes", "source_sha256", "frames", "archive_bytes", "archive_sha256")
    again = found.select("day", "kind", *[F.col(c).alias(f"_{c}") for c in names])
    both = stated.join(again, ["day", "kind"], "full").join(broken, ["day", "kind"], "left")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(F.col("broken_frames") > 0, "broken").when(F.col("_rows").isNull(), "missing").when(F.col("rows").isNull(), "unknown").when(same, "verified").otherwise("changed")
    return both.select("day", "kind", *[F.coalesce(c, f"_{c}").alias(c) for c in names], F.coalesce("broken_frames", F.lit(0)).alias("broken_frames"), status.alias("status"))
