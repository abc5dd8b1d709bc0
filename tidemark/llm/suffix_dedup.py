"""Suffix-array dedup (operator 4): repeated byte strings by column-wise construction over many strings.

Segments of the corpus that may hold a repeated string of ``WIDTH`` bytes are
dealt by name (see ``repeats``). A task cuts the distinct segments of whole names
to the stretches whose windows' hashes are met twice (candidates only), and builds
the Burrows-Wheeler transform of these strings column by column: each round
inserts one more symbol of every string, from the last to the first, at the place
that the transform so far gives. The finished transform lists all suffixes in
order; a string of ``WIDTH`` bytes repeats where neighbours in that order have
that many bytes in common, which is compared symbol by symbol. Equal strings
enter once, with their number.

Symbols are ``SYMBOL`` bytes wide: each string enters as often, less 0, 1, ..
last bytes, so that its suffixes from all places are there, in an eighth of the
rounds. A round over whole documents would scan the transform once for each of
their up to hundreds of thousands of columns; here a string has at most two
windows' bytes, so rounds are few and a task's transform is small enough to be
held in memory. The sequential external files are Spark's shuffle files.

Nulls count as empty. Repeated rows are copies and lose all bytes that lie in a
repeated string; texts shorter than WIDTH lose none. Rows with one doc_id and
different texts are kept apart. Cut bytes may split a character: the operator
returns bytes. Extra columns are carried along; the operator's own columns
replace any of the same name. An empty table gives an empty result. The memory
of a task is that of the distinct segments of its largest name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import by_place, prefix_hash, read_documents, span_hash
from tidemark.llm.repeats import cut_rows, merge_spans, repeated_spans, runs_of

WIDTH, GRAM = 200, 24
#: Bytes of a symbol of the transform.
SYMBOL = 8
ROW = np.int64((1 << 32) - 1)


def insert_columns(symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray, step: int) -> np.ndarray:
    """Rows of the strings' transform sorted by symbol, those of one symbol in order.

    Symbol k of string i, from its end, is ``symbols[ends[i] - k * step]`` for k up
    to ``lengths[i]``; behind each string stands a symbol above all others. A
    suffix that begins with a symbol of the transform has the place of this symbol
    among all, sorted by symbol and row. So a round looks up the places of the
    symbols that came last, moves the rows behind them, and merges in the symbols
    before them.
    """
    m, top = len(ends), np.int64(int(symbols.max(initial=-1)) + 1) << 32
    symbol = np.full(m, top)
    some = lengths > 0
    symbol[some] = symbols[ends[some] - step].astype(np.int64) << 32
    keys = np.sort(symbol | np.arange(m))
    live = np.flatnonzero(some)
    new = symbol[live] | live
    order = np.argsort(new)
    live, new, column = live[order], new[order], 1
    while len(live):
        at = keys.searchsorted(new)
        shift = np.bincount(at - np.arange(len(at)), minlength=len(keys) + 1).astype(np.int32).cumsum(dtype=np.int32)
        keys += shift[keys & ROW]
        more = lengths[live] > column
        symbol = np.full(len(live), top)
        symbol[more] = symbols[ends[live[more]] - (column + 1) * step].astype(np.int64) << 32
        new = symbol | at
        order = np.argsort(new)
        new = new[order]
        spot = keys.searchsorted(new) + np.arange(len(new))
        merged = np.empty(len(keys) + len(new), np.int64)
        old = np.ones(len(merged), bool)
        old[spot] = False
        merged[spot] = new
        merged[old] = keys
        keys, column = merged, column + 1
        stay = more[order]
        live, new = live[order][stay], new[stay]
    return keys & ROW


def suffix_order(symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray, step: int, least: int) -> np.ndarray:
    """Places in symbols of all suffixes of at least ``least`` symbols, in suffix order, from the transform."""
    rows_by_symbol = insert_columns(symbols, ends, lengths, step)
    place = np.empty(len(rows_by_symbol), np.int64)
    place[rows_by_symbol] = np.arange(len(rows_by_symbol))
    start_of = np.full(len(place), -1, np.int64)
    m = len(ends)
    rows, live = np.arange(len(place) - m, len(place)), np.arange(m)
    for k in range(1, int(lengths.max(initial=0)) + 1):
        stay = lengths[live] >= k
        live, rows = live[stay], place[rows[stay]]
        if k >= least:
            start_of[rows] = ends[live] - k * step
    return start_of[start_of >= 0]


def numbered(data: np.ndarray, offsets: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends, lengths) of each string less its 0 to step - 1 last bytes; symbols are numbered in the order of their bytes."""
    value = np.zeros(max(0, len(data) - step + 1), np.uint64)
    for k in range(step):
        value = (value << np.uint64(8)) | data[k : k + len(value)]
    _, symbols = np.unique(value, return_inverse=True)
    ends = (offsets[1:, None] - np.arange(step)).ravel()
    lengths = np.maximum(ends - np.repeat(offsets[:-1], step), 0) // step
    return symbols, ends, lengths


def shared_windows(data: np.ndarray, offsets: np.ndarray, width: int, step: int = SYMBOL) -> np.ndarray:
    """Per place of data: whether a window starts there that another place of the collection has too."""
    shared = np.zeros(len(data), bool)
    if len(data) < width:
        return shared
    step = step if width % step == 0 else 1
    symbols, ends, lengths = numbered(data, offsets, step)
    starts = suffix_order(symbols, ends, lengths, step, width // step)
    # neighbours that agree in one symbol after the other
    left, right = starts[:-1], starts[1:]
    for k in range(0, width, step):
        same = symbols[left + k] == symbols[right + k]
        left, right = left[same], right[same]
    shared[left] = True
    shared[right] = True
    return shared


def candidates(distinct: list[bytes], times: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last) of the runs of windows whose hashes are met twice."""
    data = np.frombuffer(b"".join(distinct), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in distinct])])
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    of = np.repeat(np.arange(len(distinct)), n)
    at = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    hashes = span_hash(prefix_hash(data), at, at + width)
    order = np.argsort(hashes)
    fresh = np.ones(len(order), bool)
    fresh[1:] = hashes[order[1:]] != hashes[order[:-1]]
    total = np.add.reduceat(times[of][order], np.flatnonzero(fresh)) if len(of) else np.zeros(0, np.int64)
    met = np.empty(len(order), bool)
    met[order] = (total > 1)[np.cumsum(fresh) - 1] if len(of) else False
    a, b = runs_of(met, of)
    return of[a], at[a] - offsets[of[a]], at[b] - offsets[of[a]] + width


def repeated(distinct: list[bytes], times: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first byte, last byte) of the stretches covered by strings that occur twice, in one segment or several, or in one that itself occurs twice."""
    owner, first, last = candidates(distinct, times, width)
    none = np.zeros(0, np.int64)
    if not len(owner):
        return none, none, none
    known: dict[bytes, int] = {}
    string = np.array([known.setdefault(distinct[i][x:y], len(known)) for i, x, y in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True)])
    often = np.bincount(string, weights=times[owner]) > 1
    data = np.frombuffer(b"".join(known), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in known])])
    of = np.repeat(np.arange(len(known)), np.diff(offsets))
    inside = np.arange(len(data)) + width <= offsets[1:][of]
    x, y = runs_of((shared_windows(data, offsets, width) | often[of]) & inside, of)
    # the runs of each distinct stretch, for all that equal it
    lo, count = np.searchsorted(of[x], string), np.bincount(of[x], minlength=len(known))[string]
    rows = np.repeat(np.arange(len(string)), count)
    pick = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    base = first[rows] - offsets[string[rows]]
    return owner[rows], base + x[pick], base + y[pick] + width


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        packed, spans = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        for z, s in zip(packed, spans, strict=True):
            text, cuts = d.decompress(z.as_py()), merge_spans(s.as_py())
            edges = [0, *[x for c in cuts for x in c], len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(text), len(text) - len(kept), len(cuts), kept))
        n, removed, runs, kept = zip(*out, strict=True) if out else ((), (), (), ())
        new = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=[*batch.schema.names[:-2], *OWN])


OWN = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}


def remove_repeats(docs: DataFrame, columns: list[str], width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The named columns of docs, n_bytes, n_removed, n_spans and kept: the bytes outside repeated strings."""
    spans = repeated_spans(by_place(docs, "text").select("text"), False, width, gram, lambda distinct, times: repeated(distinct, times, width))
    return cut_rows(docs, spans, columns, _cut, OWN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read_documents(spark, sf_dir), ["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
