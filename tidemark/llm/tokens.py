"""Token counts (operator 6): batch encoding in Arrow functions that return lengths only.

A text is cut at safe boundaries, where every pre-token match ends whatever
stands around it: between a character that is not white space and ASCII white
space. Pieces repeat a lot, so a worker keeps the lengths of short ones (a
bounded table) and sends only new pieces to the tokenizer, in calls that hold
about the same number of bytes. Texts with white space outside ASCII are cut
only behind letters, digits and ``_`` and only when long.

Nulls count as empty (0 tokens). Special strings inside a text are handled as
the tokenizer's file says. Extra columns are ignored by the query; an empty
table gives an empty result; texts without any boundary are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import kept, read_documents

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes in one call of the tokenizer, the longest piece that is remembered, and how many are.
CALL_BYTES, KEEP_CHARS, KEEP_PIECES = 200_000, 48, 400_000
#: A text of more characters is cut even where only word characters are safe.
LONG = 20_000

_ODD_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_SAFE = re.compile(r"(?<=\w)(?=[ \t\n\r])")


def pieces(text: str) -> list[str]:
    """The text in pieces whose tokens, one after another, are those of the text."""
    if not _ODD_SPACE.search(text):
        return _PIECE.findall(text)
    if len(text) <= LONG:
        return [text]
    out, start = [], 0
    for m in _SAFE.finditer(text):
        if m.start() - start >= LONG:
            out.append(text[start : m.start()])
            start = m.start()
    return [*out, text[start:]]


class Counter:
    """Token counts of pieces by a tokenizers file, remembered for short pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}

    def learn(self, new: list[str]) -> dict[str, int]:
        """Lengths of new pieces, by calls of about CALL_BYTES."""
        found, call, size = {}, [], 0
        for i, p in enumerate(new):
            call.append(p)
            size += len(p)
            if size >= CALL_BYTES or i == len(new) - 1:
                encoded = self.tokenizer.encode_batch_fast(call, add_special_tokens=False)
                found.update(zip(call, map(len, encoded), strict=True))
                call, size = [], 0
        return found

    def counts(self, texts: list[str]) -> list[int]:
        cut = [pieces(t) for t in texts]
        if len(self.known) > KEEP_PIECES:
            self.known.clear()
        short = self.known
        new = {p for ps in cut for p in ps} - short.keys()
        found = self.learn(list(new))
        short.update((p, n) for p, n in found.items() if len(p) <= KEEP_CHARS)
        long = {p: n for p, n in found.items() if len(p) > KEEP_CHARS}
        return [sum([short[p] if len(p) <= KEEP_CHARS else long[p] for p in ps]) for ps in cut]


def _batches(column: pa.Array, limit: int) -> Iterator[list[str]]:
    """The texts in runs of about ``limit`` bytes, whatever the rows of the Arrow batch."""
    run, size = [], 0
    for t in column:
        t = t.as_py() or ""
        run.append(t)
        size += len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = kept(("tokens", path), lambda: Counter(path))
    for batch in batches:
        counts = [n for texts in _batches(batch.column(2), 4_000_000) for n in counter.counts(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(lambda batches: _count(path, batches), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_documents(spark, sf_dir))
