import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = W.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def run(monkeypatch, docs):
    monkeypatch.setattr(fp, "read_documents", lambda spark, d: docs)
    return {r.doc_id: r for r in fp.query(docs.sparkSession, "").collect()}


def test_matches_brute_force(spark, documents, monkeypatch):
    texts = {i: " ".join(f"w{(i * 7 + j * (1 + i % 3)) % 40}" for j in range(i * 3)) for i in range(30)}
    texts |= {30: texts[8], 31: None, 32: "", 33: "éè wörter\nund zwei", 34: " \t "}
    monkeypatch.setattr(fp, "BUCKET_ROWS", 4)
    got = run(monkeypatch, documents(list(texts.items())))
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, d in enumerate(ids):
        text, after = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = shingles(text), shingles(edited), shingles(after)
        same = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[d].near_edited - same(a, b)) < 1e-9
        assert abs(got[d].near_next - same(a, c)) < 1e-9
        assert got[d].distinct_shingles == len(a)
    assert got[30].fingerprint == got[8].fingerprint


def test_estimates_merge_across_parts(spark):
    text = " ".join(f"w{j}" for j in range(3000))
    parts = [(text[: len(text) // 2],), (text[len(text) // 2 :],)]
    rows = spark.createDataFrame(parts, "text string").select(F.lit(1).alias("k"), fp.sketch(F.col("text")).alias("s"))
    merged = fp.merge_parts(rows, "k", "s").crossJoin(spark.createDataFrame([(text,)], "t string").select(fp.sketch(F.col("t")).alias("whole")))
    r = merged.select(fp.resemblance(F.col("s"), F.col("whole")).alias("r"), fp.distinct_shingles(F.col("whole")).alias("n")).first()
    assert r.r > 0.9 and abs(r.n / 2996 - 1) < 0.3


def test_empty_table(documents, monkeypatch):
    assert run(monkeypatch, documents([])) == {}


def test_repeated_ids(documents, monkeypatch):
    docs = documents([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (2, "y")])
    monkeypatch.setattr(fp, "read_documents", lambda spark, d: docs)
    assert fp.query(docs.sparkSession, "").count() == 4


def test_far_ids_leave_no_large_bucket(documents):
    ids = [*range(200), 10**6, *range(1 << 40, (1 << 40) + 200), (1 << 62), -(1 << 62)]
    docs = documents([(i, f"text {i}") for i in ids] + [(None, "none")])
    cells, cell, bucket = fp.id_buckets(docs, 10)
    sizes = [r["count"] for r in docs.withColumn("cell", cell).join(cells, F.col("cell") == F.col("of")).groupBy(bucket).count().collect()]
    assert max(sizes) <= 30 and sum(sizes) == len(ids) + 1
    after = {r.doc_id: r.next_text for r in fp.with_next(docs, 10).collect()}
    order = [None, *sorted(ids)]
    text = lambda i: "none" if i is None else f"text {i}"
    assert after == {d: text(order[(k + 1) % len(order)]) for k, d in enumerate(order)}


def test_very_long_text_and_clashing_columns(documents, monkeypatch):
    docs = documents([(1, "é w " * 400_000), (2, "short")])
    for c in ("tie", "bucket", "cell", "of", "next", "fingerprint", "to"):
        docs = docs.withColumn(c, F.lit("x"))
    got = run(monkeypatch, docs)
    assert got[1].n_chars == 1_600_000 and got[1].distinct_shingles == 2
