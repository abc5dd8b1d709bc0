"""Candidates for repeated stretches of a fixed number of units (bytes or words), shared by two operators.

Every window of ``width`` units is named by its least gram hash (``gram`` units).
Equal windows have equal names wherever they lie, so only windows of one name
need comparing, and consecutive windows of one name travel as one segment: each
window is in exactly one segment.

1. Names are counted over all documents. A bitmap of fixed size (``BITS``) keeps
   the names that occur twice; what shares a bit by chance only adds work.
2. Segments with such names are dealt by name; a task meets all segments of a
   name together and says which units repeat.
   Hot names, which very many windows have, go another way, so that no task holds
   all their segments. Equal segments are combined to a count; their windows are named anew by a longer gram, and only
   those whose two names together are met twice are counted by the hash of the
   whole window; a bitmap of the windows met twice cuts segments to the stretches
   that may repeat. Equal stretches are combined, first within each run of rows
   and then to a count, before they are dealt by the longer name. The spans found
   are joined back to those runs' occurrences by (name, hash, salt).
3. Those spans return to their documents by key; texts travel compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Texts, beside, by_place, forget, gram_hash, materialize, mix, prefix_hash, slices, slide, span_hash, word_spans

BITS = 1 << 26
#: Bits of one row of the bitmap, as Spark builds it.
PART = 32_768
#: A name met more often is hot, but only so many names: which ones are never changes the result.
HOT_NAME, HOT_NAMES, SALTS = 2000, 65_536, 32
#: Copies of a text that go to one task; beyond, the texts of most copies are dealt to several.
COPIES, HOT_TEXTS = 10_000, 65_536
#: Bytes of segments that a task compares at once; a name's segments are never divided.
CHUNK_BYTES = 2_000_000
SPANS = "k_id long, k_hash long, first long, last long"
SEGMENTS = "name long, k_id long, k_hash long, at long, segment binary"


class Units:
    """Texts as a run of units: bytes, or words when ``by_words``."""

    def __init__(self, t: Texts, by_words: bool):
        self.texts = t
        if by_words:
            self.starts, self.ends, self.first = word_spans(t)
            self.hashes = span_hash(prefix_hash(t.data), self.starts, self.ends)
        else:
            self.starts = self.ends = None
            self.first, self.hashes = t.offsets, None
        self.n = int(self.first[-1])

    def grams(self, k: int) -> np.ndarray:
        if self.hashes is not None:
            return gram_hash(self.hashes, k)
        places = np.arange(max(0, self.n - k + 1))
        return span_hash(prefix_hash(self.texts.data), places, places + k)

    def span(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans of the units [a, b)."""
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])


def windows(u: Units, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, least gram of each window, whether the window lies in one document)."""
    g = u.grams(gram)
    if u.n < width:
        return g, np.zeros(0, np.uint64), np.zeros(0, bool)
    low = slide(g, width - gram + 1, np.minimum)
    ends = np.repeat(u.first[1:], np.diff(u.first))[: len(low)]
    return g, low, np.arange(len(low)) + width <= ends


def name_places(u: Units, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, name) where a gram names some window, ties included: a name met once names no repeated window."""
    g, low, inside = windows(u, width, gram)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = width - gram + 1
    pad = np.zeros(w - 1, np.uint64)
    most = slide(np.concatenate([pad, np.where(inside, low, 0), pad]), w, np.maximum)
    at = np.flatnonzero((most == g) & (most > 0))
    return at, g[at]


def segments_of(u: Units, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, last window) of the runs of windows with one name; long runs are cut."""
    _, low, inside = windows(u, width, gram)
    return runs_of_names(u, low, inside, width - gram + 1)


def runs_of_names(u: Units, low: np.ndarray, inside: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = inside.copy()
    begins = np.zeros(len(low) + 1, bool)
    begins[u.first[u.first <= len(low)]] = True
    fresh[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | begins[1 : len(low)]
    starts = np.flatnonzero(fresh)
    stops = np.append(starts[1:], len(low))
    # a run ends at the next run or where windows stop lying in the document
    valid = np.concatenate([[0], np.cumsum(inside)])
    stops = starts + (valid[stops] - valid[starts])
    parts = -(-(stops - starts) // w)
    a = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * w
    return low[a], a, np.minimum(a + w, np.repeat(stops, parts)) - 1


def _count_names(by_words: bool, width: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, t in slices(batch.column(0)):
            names, n = np.unique(name_places(Units(t, by_words), width, gram)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["name", "n"])


def _bitmap(hashes: DataFrame, column: str) -> bytes:
    """Bitmap of BITS bits over a column of hashes."""
    part, place = F.expr(f"bit div {PART}").alias("part"), F.expr(f"bit % {PART}")
    rows = hashes.select(F.pmod(column, F.lit(BITS)).alias("bit")).groupBy(part).agg(F.bitmap_construct_agg(place).alias("bits"))
    out = np.zeros((BITS // PART, PART // 8), np.uint8)
    for r in rows.collect():
        out[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.tobytes()


def repeated_names(docs: DataFrame, by_words: bool, width: int, gram: int) -> tuple[bytes, np.ndarray]:
    """Bitmap of BITS bits over the names that occur at least twice in all texts, and the hot names, ascending."""
    names = docs.select("text").mapInArrow(lambda b: _count_names(by_words, width, gram, b), "name long, n long")
    twice = materialize(names.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1"))
    hot = twice.where(F.col("n") > HOT_NAME).orderBy(F.desc("n"), "name").limit(HOT_NAMES).select("name").toArrow()
    return _bitmap(twice, "name"), np.sort(np.asarray(hot["name"].combine_chunks(), np.int64))


def _has_bit(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    x = names.view(np.int64) % BITS
    return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 > 0


def _is_hot(hot: np.ndarray, names: np.ndarray) -> np.ndarray:
    x = names.view(np.int64)
    return hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x if len(hot) else np.zeros(len(x), bool)


def _segments(by_words: bool, width: int, gram: int, only_hot: bool, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits, hot = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
    for batch in batches:
        ids, hashes = (np.asarray(batch.column(i)) for i in (0, 1))
        for row, t in slices(batch.column(2)):
            u = Units(t, by_words)
            names, a, b = segments_of(u, width, gram)
            keep = _has_bit(bits, names) & (_is_hot(hot, names) == only_hot)
            names, a, b = names[keep], a[keep], b[keep] + width
            doc = np.searchsorted(u.first, a, "right") - 1
            s, e = u.span(a, b)
            raw = t.data.tobytes()
            data = pa.array([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(ids[row + doc]), pa.array(hashes[row + doc]), pa.array(a - u.first[doc]), data], ["name", "k_id", "k_hash", "at", "segment"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole names, of about CHUNK_BYTES; batches are joined once, whatever the length of a name."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        names = np.asarray(batch["name"])
        # what is held can go once a batch shows another name than the last one held
        cut = int(np.searchsorted(names, held[-1]["name"][-1].as_py(), "right")) if held else 0
        if held and size >= CHUNK_BYTES and cut < len(names):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, size, batch, names = [], 0, batch.slice(cut), names[cut:]
        last = int(np.searchsorted(names, names[-1], "left"))
        if not held and batch.nbytes >= CHUNK_BYTES and last:
            yield pa.Table.from_batches([batch.slice(0, last)])
            batch = batch.slice(last)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def distinct_segments(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct segments, how often each occurs, index of each row's) of a table of whole names."""
    encoded = table["segment"].combine_chunks().dictionary_encode()
    of = np.asarray(encoded.indices)
    return [x.as_py() for x in encoded.dictionary], np.bincount(of, minlength=len(encoded.dictionary)), of


def _spans(find: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for table in _chunks(b for b in batches if b.num_rows):
        distinct, times, of = distinct_segments(table)
        which, first, last = find(distinct, times)
        # spans of each distinct segment, for all rows that have it
        order = np.argsort(which, kind="stable")
        which, first, last = which[order], first[order], last[order]
        lo, n = np.searchsorted(which, of), np.bincount(which, minlength=len(distinct))[of]
        rows = np.repeat(np.arange(len(of)), n)
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = np.asarray(table["at"])[rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(table["k_id"])[rows]), pa.array(np.asarray(table["k_hash"])[rows]), pa.array(start + first[at]), pa.array(start + last[at])], ["k_id", "k_hash", "first", "last"])


def keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """columns, then k_id and k_hash, which tell rows apart even where a doc_id repeats with another text, then text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k_id")
    return docs.select(*columns, key, F.xxhash64(text).alias("k_hash"), text.alias("text"))


def by_text(docs: DataFrame, *columns: Column) -> DataFrame:
    """columns, then k_id and k_hash, 128 bits of hash of the text, then text: equal texts have equal spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*columns, F.xxhash64(F.lit(1), text).alias("k_id"), F.xxhash64(text).alias("k_hash"), text.alias("text"))


def repeated_spans(docs: DataFrame, by_words: bool, width: int, gram: int, find) -> DataFrame:
    """(k_id, k_hash, first, last): units [first, last) of a text that lie in windows occurring elsewhere too."""
    spark = docs.sparkSession
    bits, hot = repeated_names(docs, by_words, width, gram)
    shared = spark.sparkContext.broadcast((bits, hot))
    found = by_text(docs).mapInArrow(lambda b: _segments(by_words, width, gram, False, shared, b), SEGMENTS)
    dealt = found.repartition("name").sortWithinPartitions("name")
    spans = dealt.mapInArrow(lambda b: _spans(find, b), SPANS)
    if not len(hot):
        return spans
    segments = materialize(by_text(docs).mapInArrow(lambda b: _segments(by_words, width, gram, True, shared, b), SEGMENTS))
    return spans.unionByName(_hot_spans(segments, by_words, width, find))


def _window_hashes(u: Units, width: int) -> np.ndarray:
    return mix(u.grams(width))


def _two_names(u: Units, names: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """One hash per place of both the name of its segment and a longer one."""
    return mix(longer ^ np.repeat(mix(names.view(np.uint64)), np.diff(u.first))[: len(longer)])


def _sums(hashes: np.ndarray, times: np.ndarray, column: str) -> pa.RecordBatch:
    """Each hash and the sum of its times."""
    known, of = np.unique(hashes, return_inverse=True)
    n = np.bincount(of, weights=times, minlength=len(known)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n)], [column, "n"])


def _count_longer_names(by_words: bool, width: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        segments, times = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        for row, t in slices(batch.column(1)):
            u = Units(t, by_words)
            at, longer = name_places(u, width, gram)
            of = row + np.searchsorted(u.first, at, "right") - 1
            yield _sums(mix(longer ^ mix(segments[of].view(np.uint64))), times[of], "name")


def _count_windows(by_words: bool, width: int, gram: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        segments, times = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        for row, t in slices(batch.column(1)):
            u = Units(t, by_words)
            _, low, inside = windows(u, width, gram)
            if not inside.any():
                continue
            rows = slice(row, row + len(u.first) - 1)
            inside = inside & _has_bit(bits, _two_names(u, segments[rows], low))
            owned = np.repeat(times[rows], np.diff(u.first))[: len(low)]
            yield _sums(_window_hashes(u, width)[inside], owned[inside], "window")


SEEN = "struct<k_id: bigint, k_hash: bigint, at: bigint>"
TRIMMED = f"name long, segment binary, times long, seen array<{SEEN}>"


def _trim(by_words: bool, width: int, gram: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hot segments cut to the stretches whose windows may repeat, under names of a longer gram; those of a run of rows that are equal share a row."""
    bits = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        ids, hashes, places = (np.asarray(batch.column(i)) for i in (1, 2, 3))
        for row, t in slices(batch.column(4)):
            u = Units(t, by_words)
            _, low, inside = windows(u, width, gram)
            if len(low):
                inside = inside & _has_bit(bits, _window_hashes(u, width))
            names, a, b = runs_of_names(u, low, inside, width - gram + 1)
            b = b + width
            of = np.searchsorted(u.first, a, "right") - 1
            s, e = u.span(a, b)
            raw = t.data.tobytes()
            known: dict[tuple[int, bytes], int] = {}
            which = np.array([known.setdefault((n, raw[x:y]), len(known)) for n, x, y in zip(names.view(np.int64).tolist(), s.tolist(), e.tolist(), strict=True)], np.int64)
            times = np.bincount(which, minlength=len(known))
            at = row + of
            place = places[at] + a - u.first[of]
            # copies of a text have one text key: one occurrence for all of them
            order = np.lexsort((place, ids[at], hashes[at], which))
            line = np.stack([which[order], hashes[at][order], ids[at][order], place[order]])
            order = order[np.concatenate([[True], (line[:, 1:] != line[:, :-1]).any(axis=0)])] if len(order) else order
            seen = pa.StructArray.from_arrays([pa.array(ids[at][order]), pa.array(hashes[at][order]), pa.array(place[order])], ["k_id", "k_hash", "at"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(which[order], minlength=len(known)))]).astype(np.int32)), seen)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in known], pa.int64()), pa.array([x for _, x in known], pa.binary()), pa.array(times, pa.int64()), lists], ["name", "segment", "times", "seen"])


def _spans_of_distinct(find, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, seg, first, last) of distinct segments with their counts."""
    for table in _chunks(b for b in batches if b.num_rows):
        which, first, last = find(table["segment"].to_pylist(), np.asarray(table["times"]))
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(table["name"])[which]), pa.array(np.asarray(table["seg"])[which]), pa.array(first), pa.array(last)], ["name", "seg", "first", "last"])


def _hot_spans(segments: DataFrame, by_words: bool, width: int, find) -> DataFrame:
    """SPANS of segments with hot names: a task meets each distinct stretch once, with its count."""
    context, gram = segments.sparkSession.sparkContext, width * 3 // 4
    pieces = materialize(segments.groupBy("name", "segment").agg(F.count(F.lit(1)).alias("n")))
    named = pieces.mapInArrow(lambda b: _count_longer_names(by_words, width, gram, b), "name long, n long")
    longer = context.broadcast(_bitmap(named.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1"), "name"))
    counted = pieces.mapInArrow(lambda b: _count_windows(by_words, width, gram, longer, b), "window long, n long")
    often = context.broadcast(_bitmap(counted.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1"), "window"))
    trimmed = segments.mapInArrow(lambda b: _trim(by_words, width, gram, often, b), TRIMMED)
    trimmed = materialize(trimmed.withColumn("seg", F.xxhash64("segment")))
    distinct = trimmed.groupBy("name", "seg", "segment").agg(F.sum("times").alias("times"))
    dealt = distinct.repartition("name").sortWithinPartitions("name")
    found = dealt.mapInArrow(lambda b: _spans_of_distinct(find, b), "name long, seg long, first long, last long")
    listed = found.groupBy("name", "seg").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = trimmed.select("name", "seg", "seen", F.pmod(F.xxhash64(F.get("seen", 0)), F.lit(SALTS)).cast("int").alias("salt"))
    span = lambda o: F.transform("spans", lambda p: F.struct(o["k_id"].alias("k_id"), o["k_hash"].alias("k_hash"), (o["at"] + p["first"]).alias("first"), (o["at"] + p["last"]).alias("last")))
    return rows.join(listed, ["name", "seg", "salt"]).select(F.inline(F.flatten(F.transform("seen", span))))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [c.compress((t.as_py() or "").encode()) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], schema=pa.schema([*list(batch.schema)[:-1], pa.field("packed", pa.binary())]))


def hot_texts(docs: DataFrame, copies: int) -> DataFrame:
    """(k_id, k_hash, shares) of texts with more copies than ``copies``: the most frequent, so that each of the rest has less than one row in HOT_TEXTS of all."""
    counts = by_text(docs).groupBy("k_id", "k_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > copies)
    most = counts.orderBy(F.desc("n"), "k_id", "k_hash").limit(HOT_TEXTS)
    return materialize(most.select("k_id", "k_hash", F.ceil(F.col("n") / copies).alias("shares")))


def cut_rows(docs: DataFrame, spans: DataFrame, columns: list[str], cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: dict[str, str]) -> DataFrame:
    """The named columns of docs and the columns ``own`` that cut makes of (.., text as zstd, array of (first, last)); all rows of docs stay."""
    kept = beside(columns, own)
    at = {c: f"o_{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    given = by_place(docs, "text")
    hot = F.broadcast(hot_texts(given.select("text"), COPIES))
    # copies of a text, of the empty one too, are dealt to as many tasks as they need
    rows = by_text(given, *[F.col(at[c]).alias(f"c_{i}") for i, c in enumerate(kept)], F.monotonically_increasing_id().alias("row")).join(hot, ["k_id", "k_hash"], "left")
    names = [f"c_{i}" for i in range(len(kept))]
    rows = rows.select(*names, "k_id", "k_hash", F.coalesce(F.pmod("row", "shares"), F.lit(0)).alias("deal"), "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", packed binary"
    packed = rows.mapInArrow(_pack, schema)
    listed = spans.groupBy("k_id", "k_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    listed = listed.join(hot, ["k_id", "k_hash"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("shares"), F.lit(1)) - 1))).drop("shares")
    joined = packed.join(listed, ["k_id", "k_hash", "deal"], "left").drop("k_id", "k_hash", "deal")
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[:-2]], *[f"r_{i} {t}" for i, t in enumerate(own.values())]])
    # cut names its columns itself; Spark takes them by place
    named = joined.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays(b.columns, [*b.schema.names[: len(kept)], *[f"r_{i}" for i in range(len(own))]]) for b in cut(batches)), schema)
    return named.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], *[F.col(f"r_{i}").alias(c) for i, c in enumerate(own)])


def merge_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted disjoint spans; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def runs_of(flags: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of flagged places that belong to one item (``of``, ascending)."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on
    gap = np.flatnonzero((np.diff(on) > 1) | (np.diff(of[on]) > 0))
    return on[np.concatenate([[0], gap + 1])], on[np.concatenate([gap, [len(on) - 1]])]
