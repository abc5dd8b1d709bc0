"""Language identification (operator 1): known words first, character n-grams as back-off.

A model holds, per language, log frequencies of words and of character n-grams
(lengths 4 to 1, over words marked at both ends). It is fitted by Spark on a
bounded sample: about ``SAMPLE_ROWS`` training rows per language, by a hash of
the document id. All their words and n-grams are kept, for as many languages as
there are, so the model is as large as the sample makes it, and only what a
language has shown takes room.
Every text is then scored whole: a known word adds its log frequencies, an
unseen one the mean of its longest n-grams that are known, shorter ones where
those are not.

Nulls: a null text, or one without letters, is ``und`` with score 0; rows with a
null language are not learned from. Ties go to the language that sorts first.
Without training rows all texts are ``und``. Extra columns are ignored by the
query; rows with one doc_id are judged apart; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import kept, read_documents

SAMPLE_ROWS = 4000
ORDERS = (4, 3, 2, 1)
#: Kinds of entries: whole words, and n-grams by their length.
KINDS = range(1 + max(ORDERS))
#: Seen at least so often in the sample to count as a known word.
KNOWN_FROM = 2
#: Pseudo-count of what a language has not shown.
SMOOTH = 0.5
#: Weight of a word that is only known by its n-grams.
BACKOFF = 0.5
#: Scores (words times languages) that a worker remembers, and texts that are scored at once.
KEEP_SCORES, TEXTS_AT_ONCE = 1_600_000, 500

#: Words, the same in training (Spark) and in prediction.
LETTERS = r"\p{L}+"
_TOKEN = regex.compile(LETTERS)


@dataclass
class Model:
    """Entries (words or n-grams) sorted by kind and text; entry i has its languages and their log frequencies in places first[i]:first[i+1]."""

    langs: list[str]
    entries: list[str]
    kinds: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    value: np.ndarray
    base: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def training_sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows per language, chosen by a hash of the id; all of a language that has fewer."""
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang"))
    spread = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return labelled.join(counts, "lang").where(spread < F.lit(float(rows)) / F.col("n_lang"))


def fit(labelled: DataFrame) -> Model:
    """Model of rows (doc_id, text, lang); nulls and letterless texts teach nothing."""
    rows = training_sample(labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang"))
    found = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("w"))
    words = found.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).persist()
    marked = F.concat(F.lit("<"), F.col("w"), F.lit(">"))

    def cut(k: int) -> Column:
        places = F.sequence(F.lit(1), F.length(marked) - (k - 1))
        pieces = F.transform(places, lambda i: F.substring(marked, i, F.lit(k)))
        return F.when(F.length(marked) >= k, pieces).otherwise(F.array().cast("array<string>"))

    grams = words.select("lang", "n", F.explode(F.concat(*map(cut, ORDERS))).alias("w")).groupBy("lang", "w").agg(F.sum("n").alias("n"))
    kinds = words.where(f"n >= {KNOWN_FROM}").withColumn("k", F.lit(0)).unionByName(grams.withColumn("k", F.length("w")))
    kinds = kinds.select("k", "w", "lang", "n").persist()
    table = kinds.orderBy("k", "w", "lang").toArrow()
    totals = {(r.lang, r.k): r.total for r in kinds.groupBy("lang", "k").agg(F.sum("n").alias("total")).collect()}
    words.unpersist()
    kinds.unpersist()
    langs = sorted({lang for lang, _ in totals})
    total = np.array([[totals.get((lang, k), 0) for lang in langs] for k in KINDS]).reshape(len(KINDS), len(langs))
    base = np.log(SMOOTH / (total + SMOOTH))
    k, n = (np.asarray(table[c].combine_chunks()) for c in ("k", "n"))
    texts, index = table["w"].to_pylist(), {lang: i for i, lang in enumerate(langs)}
    lang = np.array([index[x] for x in table["lang"].to_pylist()], np.int64)
    fresh = [i for i in range(len(texts)) if not i or texts[i] != texts[i - 1] or k[i] != k[i - 1]]
    # what an entry adds to a language that has shown it, above what all get
    value = np.log((n + SMOOTH) / (total[k, lang] + SMOOTH)) - base[k, lang] if len(k) else np.zeros(0)
    return Model(langs, [texts[i] for i in fresh], k[fresh], np.array([*fresh, len(texts)]), lang, value, base)


class Scorer:
    """Scores of texts; rows of seen words are kept in one matrix, new ones are worked out for many texts at once."""

    def __init__(self, model: Model):
        self.model, self.langs = model, model.langs
        n_words = int(np.searchsorted(model.kinds, 1))
        self.words = {w: i for i, w in enumerate(model.entries[:n_words])}
        self.grams = {g: n_words + i for i, g in enumerate(model.entries[n_words:])}
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)))

    def parts(self, word: str) -> list[int]:
        """Rows of a word's n-grams: at each place the longest that is known."""
        marked, get, out = f"<{word}>", self.grams.get, []
        for i in range(len(marked)):
            for k in ORDERS:
                row = get(marked[i : i + k])
                if row is not None:
                    out.append(row)
                    break
        return out

    def learn(self, new: list[str]) -> None:
        rows: list[int] = []
        sizes, scales = [], []
        for w in new:
            own = self.words.get(w)
            found = self.parts(w) if own is None else [own]
            rows += found
            sizes.append(len(found))
            scales.append(1.0 if own is not None else BACKOFF / max(1, len(found)))
        added, model = np.zeros((len(new), len(self.langs))), self.model
        of, entry = np.repeat(np.arange(len(new)), sizes), np.array(rows, np.int64)
        scale = np.array(scales)[of]
        shown = np.bincount(of * len(KINDS) + model.kinds[entry], weights=scale, minlength=len(new) * len(KINDS)).reshape(len(new), len(KINDS))
        added += shown @ model.base
        each = np.diff(model.first)[entry]
        at = np.repeat(model.first[entry] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        np.add.at(added, (np.repeat(of, each), model.lang[at]), model.value[at] * np.repeat(scale, each))
        self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, added])

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts = [Counter(_TOKEN.findall(t.lower())) if t else None for t in texts]
        if len(self.known) * max(1, len(self.langs)) > KEEP_SCORES:
            self.known, self.scores = {}, self.scores[:0]
        if self.langs:
            self.learn(list({w for c in counts if c for w in c} - self.known.keys()))
        return [self.verdict(c) for c in counts]

    def verdict(self, counts: Counter | None) -> tuple[str, float]:
        if not counts or not self.langs:
            return "und", 0.0
        total = np.fromiter(counts.values(), float, len(counts)) @ self.scores[[self.known[w] for w in counts]]
        best = int(np.argmax(total))
        odds = np.exp(np.clip(total - total[best], -60, 0))
        return self.langs[best], float(1 / odds.sum())


def _predict(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = kept(("language", shared.value.name), lambda: Scorer(shared.value))
    for batch in batches:
        texts = batch.column(1).to_pylist()
        said = [x for i in range(0, len(texts), TEXTS_AT_ONCE) for x in scorer.texts(texts[i : i + TEXTS_AT_ONCE])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _predict(shared, batches), "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
