"""Quality rules with host verdicts (operator 8), DataFrame functions only.

Each document is judged by rules on its own text; failures are then counted per
host (here ``source``), the hosts' failure rates are shrunk towards a beta prior
fitted to all hosts by moments, and a host whose shrunk rate is above
``HOST_LIMIT`` rejects its documents too. Only the four numbers of the prior
reach the driver. The verdict joins back on (host, salt), so a host with a third
of all rows is spread over all tasks.

Nulls: a null text has no words and fails; a null host is a host of its own.
Rows are judged apart, also where an id or a whole row repeats. Texts of any
length are judged whole. Empty tables give empty results. ``keep_good`` carries
all columns along, whatever their names; ``judge`` returns only its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SEPARATOR, by_place, checkpointed, let, materialize, read_documents, words

MIN_WORDS = 50
#: Most percent of the words that may lie in repeated three-word windows.
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk failure rate is above this.
HOST_LIMIT = 0.5
SALTS = 32
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(ws: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that occur twice or more among ``ws``."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            n = F.size(s)
            same = lambda j, k: F.get(s, j)["x"] == F.get(s, k)["x"]
            twice = F.filter(s, lambda x, j: ((j > 0) & F.coalesce(same(j, j - 1), F.lit(False))) | ((j < n - 1) & F.coalesce(same(j, j + 1), F.lit(False))))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(at: Column) -> Column:
            zero = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
            step = lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last"))
            return F.aggregate(at, zero, step, lambda a: a["n"])

        return let(let(placed, starts), total)

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
        return F.when(F.size(w) < width, F.lit(0)).otherwise(
            let(grams, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        )

    return let(ws, of)


def metrics_of(text: Column) -> Column:
    """Struct of METRICS and base_failed of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = F.struct(
        F.size(words(text)).cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(SEPARATOR))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words(text)).cast("long").alias("n_repeat_words"),
    )
    failed = lambda m: (m["n_words"] < MIN_WORDS) | (F.lit(100) * m["n_repeat_words"] > F.lit(MAX_REPEAT_PERCENT) * m["n_words"])
    return let(measured, lambda m: F.struct(*[m[c].alias(c) for c in METRICS], failed(m).alias("base_failed")))


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate, host_ok; ``judged`` has host and base_failed.

    The prior has the mean of all documents and the spread between hosts beyond
    that of binomial draws; where hosts differ no more than chance, its weight is
    as large as the corpus and every host gets about the common rate.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failures"))
    hosts = materialize(hosts)
    p = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("f"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("ff")).first()
    total, fails = float(p["n"] or 0), float(p["f"] or 0)
    mean = fails / total if total else 0.0
    # moments of a beta-binomial: weighted variance between hosts, less its binomial part
    between = float(p["ff"] or 0) - total * mean * mean
    scale = total - float(p["nn"] or 0) / total if total else 0.0
    var = max(0.0, (between - (p["hosts"] - 1) * mean * (1 - mean)) / scale) if scale > 0 else 0.0
    weight = min(max(mean * (1 - mean) / var - 1, 1.0), max(total, 1.0)) if var > 0 else max(total, 1.0)
    rate = (F.col("failures") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= F.lit(limit))


def join_verdicts(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """judged (with columns host and spread) plus host_ok and host_rate, in place of spread."""
    right = verdicts.select(F.col("host").alias("v_host"), "host_ok", F.col("rate").alias("host_rate"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("v_salt"))
    return judged.join(right, F.col("host").eqNullSafe(F.col("v_host")) & (F.col("spread") == F.col("v_salt"))).drop("v_host", "v_salt", "spread")


def spread(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int").alias("spread")


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, metrics, base_failed, host_rate, kept: one row per row of docs, without its text."""
    measured = docs.select("doc_id", F.col(host).alias("host"), spread(), metrics_of(F.col("text")).alias("m"))
    measured = materialize(measured.select("doc_id", "host", "spread", "m.*"))
    joined = join_verdicts(measured, host_verdicts(measured))
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that pass their own rules and their host's verdict, with their columns.

    Metrics are worked out once: what is written is host and verdict of every row,
    and the row itself where it passed. It is a checkpoint, as the result reads it.
    """
    # by place, as names may hold dots or differ only in case
    given, row = by_place(docs, host, "doc_id", "text"), F.struct(*[f"o_{i}" for i in range(len(docs.columns))])
    measured = given.select(row.alias("row"), F.col(host).alias("host"), spread(), metrics_of(F.col("text"))["base_failed"].alias("base_failed"))
    measured = checkpointed(measured.withColumn("row", F.when(~F.col("base_failed"), F.col("row"))))
    verdicts = host_verdicts(measured.select("host", "base_failed"))
    return join_verdicts(measured.where(~F.col("base_failed")), verdicts).where("host_ok").select("row.*").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         row_number() OVER () AS rid FROM documents
), m AS (
  SELECT rid, doc_id, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), h AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
), r AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY rid
), b AS (
  SELECT m.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
         m.n_words < 50 OR 100 * coalesce(r.n_repeat_words, 0) > 50 * m.n_words AS base_failed
  FROM m LEFT JOIN r ON m.rid = r.rid
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS f FROM b GROUP BY source
), p AS (
  SELECT sum(n) AS t, sum(f) / sum(n) AS mean, count(*) AS hosts, sum(n * n) AS nn, sum(f * f / n) AS ff FROM hosts
), v AS (
  SELECT *, CASE WHEN t - nn / t > 0 THEN greatest(0, (ff - t * mean * mean - (hosts - 1) * mean * (1 - mean)) / (t - nn / t)) ELSE 0 END AS var FROM p
), k AS (
  SELECT mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 1), greatest(t, 1)) ELSE greatest(t, 1) END AS weight FROM v
), ok AS (
  SELECT source, (f + (SELECT mean * weight FROM k)) / (n + (SELECT weight FROM k)) <= 0.5 AS host_ok FROM hosts
)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
       NOT b.base_failed AND ok.host_ok AS kept
FROM b JOIN ok ON b.source IS NOT DISTINCT FROM ok.source
"""
