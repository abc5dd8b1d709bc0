"""Spelling variant grouping (operator 12) by permuterm rotations.

Words come from maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lowered; a run
whose crc32 with its doc_id is divisible by 199 loses one code point. Words are
the distinct results of enough code points and occurrences.

Each word, marked by a terminator, is turned so that one letter after the other
comes last. The turns are sorted by all but that last letter, so the words that
differ by one replaced letter lie in one prefix range; the whole turns of the word
that is one letter shorter, which lack that letter, lie there too. So a range holds
words that are all near each other, at most one for each letter and one more:
ranges are bounded by the alphabet, whatever the data. One scan of the sorted rows
gives each word of a range the number of its neighbours there and the best of
them; no pair is emitted. Two words that differ by a letter more or less meet only
where the letter begins a run of its like, so no neighbour counts twice.

Rotations are strings up to ``LONG`` letters; of longer words both parts of a
rotation are kept as 64-bit hashes, so a word of any length costs a row of bounded
size per letter.

Null texts have no words. A null doc_id counts as an empty string in the crc32.
Repeated rows count again. Ties of n take the word that is smaller by code points.
Extra columns, whatever their names, are ignored. An empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import CRC_TABLE, Texts, ascii_lower, crc32_sql, forget, materialize, prefix_hash, read_documents, slices, span_hash

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Divisor of the crc32 of runs that lose a code point.
DROP = 199
#: Distinct words that a task counts before it passes them on.
COUNTED = 300_000
LONG = 64
END = "$"
#: Kinds of rows of a prefix range: the word that lacks the letter, words whose letter begins a run of its like, others.
WHOLE, FIRST, LATER = 0, 1, 2
ROTATIONS = "prefix string, kind int, word string, n long"
NEIGHBOURS = "word string, n_near long, best_n long, best string"


# -- words ----------------------------------------------------------------------
def words_of(doc_id: object, text: str) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text with lowered A-Z."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text)).items():
        h = zlib.crc32(run.encode(), seed)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LETTERS:
            yield run, n


def _count(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for row, t in slices(batch.column(1)):
            low = Texts(ascii_lower(t.data), t.offsets)
            for i in range(len(low)):
                for word, n in words_of(ids[row + i], low.bytes_of(i).decode()):
                    counts[word] += n
                if len(counts) >= most:
                    yield out()
    yield out()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    most = COUNTED
    found = docs.select("doc_id", "text").mapInArrow(lambda batches: _count(most, batches), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# -- rotations --------------------------------------------------------------------
def rotations(word: str) -> Iterator[tuple[str, int]]:
    """(prefix, kind) of each turn of the word: without the letter that comes last, and whole."""
    size = len(word)
    if size >= LONG:
        letters, places = np.frombuffer(word.encode("utf-32-le"), np.uint8), 4 * np.arange(size + 1)
        sums = prefix_hash(letters)
        heads = span_hash(sums, np.zeros_like(places), places)
        tails = span_hash(sums, places, np.full_like(places, len(letters)))

    def part(after: int, before: int) -> str:
        if size - after + before < LONG:
            return word[after:] + END + word[:before]
        return f"{size - after}{END}{before}:{tails[after]:016x}{heads[before]:016x}"

    for i in range(size):
        yield part(i + 1, i), LATER if i and word[i - 1] == word[i] else FIRST
    for i in range(size + 1):
        yield part(i, i), WHOLE


def _rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    rows: list[tuple[str, int, str, int]] = []
    weight = 0
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for prefix, kind in rotations(word):
                rows.append((prefix, kind, word, n))
                weight += len(word) + 50
                if weight >= 4_000_000:
                    yield _table(rows)
                    rows, weight = [], 0
    yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int32(), pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["prefix", "kind", "word", "n"])


def scan(rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, neighbours, n of the best, the best) for the words of one range, given as (kind, word, n)."""
    whole = [(n, w) for kind, w, n in rows if kind == WHOLE]
    edited = sorted(((-n, w, kind) for kind, w, n in rows if kind != WHOLE))
    longer = [(-n, w) for n, w, kind in edited if kind == FIRST]
    for n, w in whole[:1]:
        if longer:
            yield w, len(longer), *longer[0]
    for minus, w, kind in edited:
        near = len(edited) - 1
        best = [(-n, x) for n, x, _ in edited[:2] if x != w][:1]
        if kind == FIRST and whole:
            near += 1
            best.append(whole[0])
        if near:
            n, x = min(best, key=lambda b: (-b[0], b[1]))
            yield w, near, n, x


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within the ranges of rows (prefix, kind, word, n) in order of prefix."""
    forget()
    prefix, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        out: list[tuple] = []
        prefixes = batch.column(0)
        fresh = np.ones(len(prefixes), bool)
        fresh[1:] = np.asarray(pc.not_equal(prefixes[1:], prefixes[:-1]))
        if prefixes[0].as_py() == prefix:
            fresh[0] = False
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(fresh))
        first = int(starts[0]) if len(starts) else len(fresh)
        take = lambda a, b: list(zip(*(batch.column(k)[a:b].to_pylist() for k in (1, 2, 3)), strict=True))  # noqa: E731, B023
        held += take(0, first)
        if len(starts):
            out += scan(held)
            # ranges of one row have no neighbours; the last may go on in the next batch
            for a, b in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):
                if b - a > 1:
                    out += scan(take(a, b))
            held, prefix = take(int(starts[-1]), len(fresh)), prefixes[len(fresh) - 1].as_py()
        yield _found(out)
    yield _found(list(scan(held)))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["word", "n_near", "best_n", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words: how many, and the one of largest n."""
    turned = words.select("word", "n").mapInArrow(_rotate, ROTATIONS)
    # the word behind a whole turn and the letter behind the others come in any order: a scan sees the range at once
    found = turned.repartitionByRange("prefix").sortWithinPartitions("prefix").mapInArrow(_scan, NEIGHBOURS)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


# -- forms --------------------------------------------------------------------------
def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): the last of the forms that follow each other.

    Every step multiplies n by RATIO at least, so a chain is as long as a logarithm
    of the corpus, and doubling its steps takes a handful of rounds.
    """
    found = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = found.join(step, "root", "left")
        if not jumped.where("next IS NOT NULL").limit(1).count():
            return found
        found = materialize(jumped.select("word", F.coalesce("next", "root").alias("root")))


def group_spellings(docs: DataFrame) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of every word of docs (doc_id, text)."""
    words = materialize(count_words(docs))
    rows = words.join(neighbours(words), "word", "left")
    common = F.col("best_n") >= RATIO * F.col("n")
    rows = materialize(rows.select("word", "n", F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).alias("n_near")))
    rows = rows.join(roots(rows.where("form IS NOT NULL")), "word", "left")
    return rows.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(read_documents(spark, sf_dir))


_BYTES = "list_transform(string_split(regexp_replace(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '(..)', '\\1 ', 'g').trim(), ' '), lambda x: ('0x' || x)::BIGINT)"
#: Near words by what is left of them without one letter, as pairs.
SQL = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY 1, 2
), hashed AS (
  SELECT run, k, {crc32_sql(_BYTES)} AS h FROM runs, crc_table
), cut AS (
  SELECT CASE WHEN h % {DROP} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LETTERS} GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT}
), lacking AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM lacking a JOIN lacking b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM lacking a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM lacking a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, min((-other_n, other)) AS top FROM near GROUP BY 1
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= {RATIO} * w.n THEN top[2] END AS form, CASE WHEN -top[1] >= {RATIO} * w.n THEN -top[1] END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word
), walk AS (
  SELECT word, word AS pos, 0 AS step FROM forms UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.pos WHERE forms.form IS NOT NULL
)
SELECT f.word, n, form, form_n, r.root, n_near FROM forms f JOIN (SELECT word, arg_max(pos, step) AS root FROM walk GROUP BY 1) r ON r.word = f.word
"""
