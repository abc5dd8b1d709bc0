"""Shared pieces of the training-data operators.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``. Those six
separators are single bytes in UTF-8, so the numpy helpers below work on the
UTF-8 buffer of a whole Arrow batch and never loop over words in Python.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR = r"[\x20\x09-\x0D]"

#: Bytes of text that a numpy pass handles at once; bounds a worker's memory.
SLICE_BYTES = 2_000_000

_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


# -- Spark side ---------------------------------------------------------------
def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression: lambdas over it would otherwise evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; its own only where all run in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Scratch tables of this process that have not been deleted.
_SCRATCH: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{scratch_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _SCRATCH.append(at)
    return spark.read.schema(df.schema).parquet(at)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _SCRATCH.remove(at)


def discard(df: DataFrame) -> None:
    """Delete the scratch tables that ``df`` reads; nothing may read them any more."""
    files = df.inputFiles()
    _delete(df.sparkSession, [at for at in _SCRATCH if any(at.rpartition("/")[2] in f for f in files)])


def settle(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, written; all other scratch tables that it made are deleted."""
    before = set(_SCRATCH)
    out = materialize(make())
    _delete(spark, [at for at in _SCRATCH[:-1] if at not in before])
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder; Spark's cleaner deletes it when no frame reads it any more, if it is set to clean checkpoints."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_place(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of docs as o_0, o_1, .., whose names may hold dots or differ only in case, then those needed by name: exactly if one has it, else in any case."""
    at = {c.lower(): i for i, c in reversed(list(enumerate(docs.columns)))} | {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    given = docs.toDF(*[f"o_{i}" for i in range(len(docs.columns))])
    return given.select("*", *[F.col(f"o_{at[c]}").alias(c) for c in dict.fromkeys(needed)])


def beside(columns: Sequence[str], own: Sequence[str]) -> list[str]:
    """columns without those that an operator makes itself, in any case, as Spark takes names."""
    taken = {c.lower() for c in own}
    return [c for c in columns if c.lower() not in taken]


def text_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart even where a doc_id repeats with another text."""
    return [F.col(doc_id).alias("k_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k_hash")]


#: DuckDB has no crc32: its table, and the crc32 of a list of bytes as SQL.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS crc_of)"


def crc32_sql(byte_list: str) -> str:
    return f"xor(list_reduce({byte_list}, lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


# -- workers ------------------------------------------------------------------
_KEPT: dict = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task: one thing at a time, so that operators that follow each other do not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Free what an earlier operator left in this worker."""
    _KEPT.clear()


# -- numpy side ---------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """UTF-8 bytes of several texts on end, with where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, Texts) over runs of rows of about ``limit`` bytes; nulls count as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, off, data = array.buffers()
    off = np.frombuffer(off, np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, Texts(raw[off[row] : off[end]], off[row : end + 1] - off[row])
        row = end


def ascii_lower(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data | 32, data).astype(np.uint8)


def word_spans(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words and, per text, the index of its first word (one more at the end)."""
    n = len(t.data)
    solid = ~_IS_SEP[t.data]
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, t.offsets)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        base = 0xD6E8FEB86659FD93
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any byte span follows; see span_hash."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal spans have equal hashes wherever they lie."""
    _, down = powers(len(sums) - 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def gram_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (ordered); shorter input gives none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= _ODD
        acc += hashes[j : j + n]
    return mix(acc)


def slide(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each window of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions whose value is the least of some window of ``width``; equal windows pick the same places."""
    n = len(grams)
    if n < width:
        return np.zeros(0, np.int64)
    low = slide(grams, width, np.minimum)
    wide = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(slide(wide, width, np.maximum) == grams)
