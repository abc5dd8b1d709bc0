"""Substring dedup (operator 9): recurring passages found by sharded Aho-Corasick automata.

Segments of the corpus that may hold a recurring window of ``WINDOW`` words are
dealt by name (see ``repeats``), so that each task has whole families of
passages: a shard. In a shard, runs of windows that occur more than once are the
confirmed passages; they are compiled into one automaton over word numbers, and
every segment of the shard streams through it. As every window of every document
lies in exactly one segment of its name's shard, that locates every occurrence.
Each word inside one is removed.

Nulls count as texts without words. Repeated rows are copies of each other and
lose all words that lie in a window; texts shorter than a window lose none.
Rows with one doc_id and different texts are kept apart. Extra columns are
carried along by ``remove_repeats``; the operator's own columns replace any of
the same name. An empty table gives an empty result. The memory of a task is
that of the distinct segments of its largest name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Texts, by_place, powers, prefix_hash, read_documents, span_hash, word_spans
from tidemark.llm.repeats import cut_rows, merge_spans, repeated_spans, runs_of

WINDOW, GRAM = 35, 8


def passages(distinct: list[bytes], times: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first word, last word) of every occurrence of a recurring passage."""
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in distinct])])
    t = Texts(np.frombuffer(b"".join(distinct), np.uint8), offsets)
    starts, ends, first = word_spans(t)
    hashes = span_hash(prefix_hash(t.data), starts, ends)
    _, numbers = np.unique(hashes, return_inverse=True)
    up, _ = powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    # windows of all distinct segments, counted with how often their segments occur
    n = np.maximum(np.diff(first) - window + 1, 0)
    of = np.repeat(np.arange(len(distinct)), n)
    at = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    _, same = np.unique(span_hash(sums, at, at + window), return_inverse=True)
    total = np.bincount(same, weights=times[of]) if len(of) else np.zeros(0)
    a, b = runs_of(total[same] > 1, of)
    none = np.zeros(0, np.int64)
    if not len(a):
        return none, none, none
    words = numbers.tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for x, y in zip(at[a].tolist(), (at[b] + window).tolist(), strict=True):
        automaton.add_word(tuple(words[x:y]), y - x)
    automaton.make_automaton()
    found: list[tuple[int, int, int]] = []
    bounds = first.tolist()
    for i in range(len(distinct)):
        covered = -1
        spans = [(e + 1 - k, e + 1) for e, k in automaton.iter(tuple(words[bounds[i] : bounds[i + 1]]))]
        for x, y in sorted(spans, key=lambda s: (s[0], -s[1])):
            if y > covered:
                found.append((i, x, y))
                covered = y
    which, x, y = (np.array(c, np.int64) for c in zip(*found, strict=True))
    return which, x, y


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends n_words, n_removed and kept (the words left, joined by a space) to the columns before packed and spans."""
    d = zstandard.ZstdDecompressor()
    for batch in batches:
        total, removed, kept = [], [], []
        packed, spans = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        for z, s in zip(packed, spans, strict=True):
            words = d.decompress(z.as_py()).split()  # bytes split at the same six separators
            cuts = merge_spans(s.as_py())
            total.append(len(words))
            removed.append(sum(b - a for a, b in cuts))
            for a, b in reversed(cuts):
                del words[a:b]
            kept.append(b" ".join(words).decode())
        new = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=[*batch.schema.names[:-2], *OWN])


OWN = {"n_words": "long", "n_removed": "long", "kept": "string"}


def remove_repeats(docs: DataFrame, columns: list[str], window: int = WINDOW, gram: int = GRAM, own: Sequence[str] = tuple(OWN)) -> DataFrame:
    """The named columns of docs, n_words, n_removed and kept (or as ``own`` names them): the words outside recurring passages."""
    spans = repeated_spans(by_place(docs, "text").select("text"), True, window, gram, lambda distinct, times: passages(distinct, times, window))
    return cut_rows(docs, spans, columns, _cut, dict(zip(own, OWN.values(), strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read_documents(spark, sf_dir), ["doc_id"])
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
