"""Mixing against its SQL and a plain version."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

W = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Shares by weight, capped at twice the size, the excess shared again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_ = set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2.0 * sizes[s] for s in order if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in order}
        open_ -= over


def test_equals_plain_version(documents, monkeypatch):
    rows = [(i, " ".join(["w"] * (i % 37)), "en", None if i % 11 == 0 else "abcde"[i * i % 5]) for i in range(300)]
    rows += [(400, None, None, "a"), (401, "", None, "only empty"), (None, "x y", None, "a"), (5, "x y z", None, "b"), (5, "x y z", None, "b"), (402, "long " * 300_000, None, "z")]
    docs = documents(rows)
    monkeypatch.setattr(mixing, "read_documents", lambda s, d: docs)
    got = mixing.query(docs.sparkSession, "").collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(W.findall(t or ""))
    want = targets(sizes)
    assert len(got) == len(rows)
    ordered = lambda xs: sorted(xs, key=repr)
    assert ordered((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == ordered((d, len(W.findall(t or "")), sizes[s], round(want[s], 6)) for d, t, _, s in rows)
    assert all(r.taken <= 2 * r.size and r.taken in (0, r.size, 2 * r.size) for r in got)
    assert ordered(tuple(r) for r in got) == ordered(tuple(r) for r in mixing.query(docs.sparkSession, "").collect())
    assert len({r.taken for r in got if r.doc_id == 5 and r.size == 3}) == 1


def test_taken_words_come_near_the_target(documents, monkeypatch):
    docs = documents([(i, " ".join(["w"] * (10 + i % 9)), "en", "ab"[i % 2]) for i in range(4000)])
    monkeypatch.setattr(mixing, "read_documents", lambda s, d: docs)
    per = {}
    for r in mixing.query(docs.sparkSession, "").collect():
        t = per.setdefault(r.source_size + r.target, [0, r.target])
        t[0] += r.taken
    assert all(abs(taken / target - 1) < 0.05 for taken, target in per.values())


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cols = "doc_id, size, source_size, round(target, 6) AS target, taken"
    want = sorted(con.execute(f"SELECT {cols} FROM ({mixing.SQL})").fetchall())
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.query(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("name", ["t_source", "t_salt", "size", "source_size", "target", "copies", "row", "rate", "drawn", "of", "salt"])
def test_clashing_columns(documents, name):
    docs = documents([(i, "a b c", None, "s") for i in range(6)]).withColumn(name, F.lit(-7))
    mixed = mixing.emit_mix(docs)
    assert mixed.columns == docs.columns
    assert {r[name] for r in mixed.collect()} == {-7}
    planned = mixing.plan_mix(docs)
    assert len(planned.columns) == len(set(planned.columns))
    assert ({r[name] for r in planned.collect()} == {-7}) == (name not in mixing.OWN)


def test_empty_table(documents):
    assert mixing.plan_mix(documents([])).collect() == [] and mixing.emit_mix(documents([])).collect() == []
