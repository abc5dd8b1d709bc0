"""Quality rules against their SQL and a plain version."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = W.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    repeat = len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)})
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)


def corpus():
    good = [" ".join(f"w{i}x{j}" for j in range(60 + i)) for i in range(20)]
    odd = [None, "", " \t\n", "a\nb\na\n\n \nb", "x y z " * 40, "é#*$ %&|<> ü", "a b c d a b c e " * 9, "line one\n" * 30, " ".join(f"w{i}" for i in range(200_000))]
    rows = [(i, t, None, "good") for i, t in enumerate(good)] + [(100 + i, t, None, "mixed") for i, t in enumerate(odd)]
    rows += [(200 + i, "too short", None, "bad") for i in range(40)] + [(300, good[0], None, "bad"), (301, good[1], None, None), (None, good[2], None, "good"), (5, good[3], None, "good"), (5, good[3], None, "good")]
    return rows


def test_equals_plain_version(documents, monkeypatch):
    rows = corpus()
    docs = documents(rows)
    monkeypatch.setattr(quality, "read_documents", lambda s, d: docs)
    got = [tuple(r) for r in quality.query(docs.sparkSession, "").collect()]
    assert sorted((r[:7] for r in got), key=repr) == sorted(((d, *plain(t)) for d, t, *_ in rows), key=repr)
    kept = {r[0] for r in got if r[7]}
    assert 300 not in kept and {0, 5, 19, 301, None} <= kept  # a good document of a bad host goes
    assert not any(r[6] and r[7] for r in got)
    stay = quality.keep_good(docs)
    assert stay.columns == docs.columns and Counter(r.doc_id for r in stay.collect()) == Counter(r[0] for r in got if r[7])


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    assert sorted(tuple(r) for r in quality.query(spark, sf_dir).collect()) == sorted(con.execute(f"SELECT {columns} FROM ({quality.SQL})").fetchall())


def test_few_failures_do_not_reject_a_host(documents):
    """One failure of one document is shrunk towards the common rate."""
    judged = documents([(i, None, None, f"h{i % 50}") for i in range(1000)] + [(5000, None, None, "new")]).select(F.col("source").alias("host"), (F.floor(F.col("doc_id") / 50) % 10 == 0).alias("base_failed"))
    verdicts = {r.host: r for r in quality.host_verdicts(judged).collect()}
    assert verdicts["new"].failures == 1 and verdicts["new"].host_ok and all(r.host_ok for r in verdicts.values())


def test_clashing_columns_and_empty_table(documents):
    docs = documents(corpus()[:30])
    for c in ("n_words", "base_failed", "host", "spread", "m", "row", "v_host", "host_ok", "kept", "rate", "m_"):
        docs = docs.withColumn(c, F.lit("own"))
    stay = quality.keep_good(docs)
    assert stay.columns == docs.columns
    rows = stay.collect()
    assert rows and all(r.n_words == r.row == r.base_failed == r.kept == "own" for r in rows)
    assert len(quality.judge(docs).collect()) == 30
    assert quality.keep_good(documents([])).collect() == [] and quality.judge(documents([])).collect() == []
