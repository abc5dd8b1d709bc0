"""Columns whose names hold dots or differ from an operator's only in case, and texts of very many copies."""

from collections import Counter

import corpus_pipeline
import pytest

from tidemark.llm import bpe, mixing, quality, repeats, substring_dedup, suffix_dedup

PASSAGE = " ".join(f"word{i}" for i in range(60))
ODD = "doc_id long, text string, source string, `N_words` int, `N_Bytes` int, `SIZE` int, `N_TOKENS` int, `a.b` string"


@pytest.fixture
def odd(spark):
    rows = [(i, f"{PASSAGE} and then it says number {i}", "s", i, i, i, i, f"x{i}") for i in range(6)]
    return spark.createDataFrame(rows, ODD)


def test_case_only_clashes_and_dots(odd):
    cut = substring_dedup.remove_repeats(odd, odd.columns)
    assert "N_words" not in cut.columns and [r["a.b"] for r in cut.orderBy("doc_id").collect()] == [f"x{i}" for i in range(6)]
    assert {r.n_removed for r in cut.select("n_words", "n_removed").collect()} == {65}
    cut = suffix_dedup.remove_repeats(odd, odd.columns)
    assert "N_Bytes" not in cut.columns and cut.select("n_bytes", "SIZE").count() == 6 and cut.first()["a.b"] is not None
    plan = mixing.plan_mix(odd)
    assert "SIZE" not in plan.columns and plan.first()["a.b"] is not None and plan.select("size").distinct().count() == 1
    mixed = mixing.emit_mix(odd)
    assert mixed.columns == odd.columns and all(r["a.b"] == f"x{r.doc_id}" == f"x{r.SIZE}" for r in mixed.collect())
    good = quality.keep_good(odd)
    assert good.columns == odd.columns and good.count() == 6 and good.first()["a.b"] is not None
    ids = bpe.encode(odd, keep=["N_TOKENS", "a.b", "SIZE"])
    assert ids.columns == ["doc_id", "a.b", "SIZE", "n_tokens", "ids"] and all(r["a.b"] == f"x{r.SIZE}" for r in ids.collect())


def test_a_pipeline_stage_keeps_odd_names(spark, odd):
    out = corpus_pipeline.repeated_passages(spark, odd.withColumnRenamed("SIZE", "REMOVED_0"), "")
    assert out.columns == [c if c != "SIZE" else "REMOVED_0" for c in odd.columns]
    assert sorted((r.doc_id, r.REMOVED_0, r["a.b"], r.text) for r in out.collect()) == [(i, i, f"x{i}", str(i)) for i in range(6)]


def test_copies_of_a_text_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "COPIES", 3)
    rows = [(i, PASSAGE) for i in range(20)] + [(i, None) for i in range(20, 40)] + [(40, f"one {PASSAGE}"), (41, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.shares for r in repeats.hot_texts(docs.select("text"), 3).collect()) == [7, 7]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, ["doc_id"]).collect()}
    assert got == {i: (60, 60, "") for i in range(20)} | {i: (0, 0, "") for i in range(20, 40)} | {40: (61, 60, "one"), 41: (1, 0, "alone")}
    left = Counter(r.n_removed for r in suffix_dedup.remove_repeats(docs, ["doc_id"]).collect())
    assert left == {len(PASSAGE): 21, 0: 21}


def test_text_keys_hold_128_bits(spark):
    docs = spark.range(200).selectExpr("CAST(id AS STRING) AS text")
    keys = repeats.by_text(docs).selectExpr("k_id", "k_hash", "xxhash64(text, 1) AS seeded").collect()
    assert len({r.k_id for r in keys}) == 200 == len({r.k_hash for r in keys})
    # a constant hashed with the text's hash as seed would be a function of k_hash
    assert all(r.k_id != r.seeded for r in keys)
