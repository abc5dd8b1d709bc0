"""Creators among the wallets are excluded from the scores, however many creators there are."""

from pyspark.sql import functions as F

from tidemark.plans import scoring as P


def test_f13_excludes_creators(spark, sf_dir):
    got = {r.wallet: r.status for r in P.f13(spark, sf_dir).collect()}
    made = {r.wallet for r in P.creators(spark, sf_dir).collect()}
    assert made & set(got)
    assert {w for w, s in got.items() if s == "excluded"} == made & set(got)


def test_no_creator_is_left_out(spark, sf_dir):
    last = 1_200_000
    many = spark.range(0, last + 1, 1, 1).select(F.when(F.col("id") == last, "w1").otherwise(F.concat(F.lit("x"), "id")).alias("wallet"))
    got = {r.wallet: r.status for r in P.scores(spark, sf_dir, many).collect()}
    assert {w for w, s in got.items() if s == "excluded"} == {"w1"}
