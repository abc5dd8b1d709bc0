"""Steps that read their rows once, or deal them by one exchange."""

from pyspark.sql import functions as F

from tidemark.operators import audit as U
from tidemark.operators import wallets as W
from tidemark.plans import audit as PA
from tidemark.plans import wallets as PW


def test_balances_are_dealt_once(spark):
    b = spark.createDataFrame([("s1", "w", "m", "post", 5.0), ("s1", "w", "m", "pre", 3.0), ("s1", "x", "m", "post", 1.0), ("s2", "infra", "m", "post", 7.0)], "signature string, owner string, mint string, phase string, amount double")
    signers = b.where("owner <> 'x'").select("signature", "owner")
    out = W.balance_deltas(b, signers, spark.createDataFrame([("infra",)], "owner string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    sides = [x for x in plan.splitlines() if "Exchange hashpartitioning(signature" in x]
    assert "BroadcastHashJoin [owner" in plan and len(sides) <= 2
    assert [tuple(r) for r in out.collect()] == [("s1", "w", "m", 2.0)]


def test_market_records_are_worked_out_once(spark, sf_dir, monkeypatch):
    seen = []
    true = U.prior_history

    def watched(decisions, completions, key):
        seen.extend(df._jdf.queryExecution().analyzed().toString() for df in (decisions, completions))
        return true(decisions, completions, key)

    monkeypatch.setattr(U, "prior_history", watched)
    U.v4_grid_audit(PA.market_records(spark, sf_dir), 2400)
    assert len(seen) == 2 and not any("l_partkey" in plan for plan in seen)


def test_market_observations_are_dealt_once(spark, sf_dir):
    plan = PW.c13(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(signature") == 1 and plan.count("lineitem.parquet") == 1


def test_traded_candidates(spark):
    legs = [("s", "m", "buy", 2.0, 10.0, "w2", "p1", "k2"), ("s", "m", "buy", 1.0, 5.0, "w3", "p0", "k1"), ("s", "n", "sell", 4.0, 8.0, "w1", "p2", "k0"), ("s", "m", "sell", 1.0, 1.0, "w4", "p1", "k3"), ("r", "m", "sell", 3.0, 9.0, "w9", "p1", "k4")]
    legs = spark.createDataFrame(legs, "signature string, mint string, side string, amount double, value double, wallet string, pool string, place string")
    got = sorted((r.signature, r.side, r.mint, r.source, r.amount, r.native, r.payer, r.first_buy and tuple(r.first_buy)) for r in W.traded_candidates(legs, F.col("value"), F.when(F.col("signature") == "s", F.col("value"))).collect())
    first = ("p0", "w3")
    assert got == [
        ("r", "sell", "m", "transfer-derived", 3.0, 9.0, "w9", None),
        ("s", "buy", "m", "swap-event", 3.0, 24.0, "w1", first), ("s", "buy", "m", "transfer-derived", 3.0, 15.0, "w1", first),
        ("s", "sell", "m", "swap-event", 1.0, 24.0, "w1", first), ("s", "sell", "n", "swap-event", 4.0, 24.0, "w1", None),
    ]
