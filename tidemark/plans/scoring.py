"""Registered queries over returns, wallet scores and token scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.common import first_by, steady, wilson_lower, wilson_upper
from tidemark.functions.scratch import stored
from tidemark.operators import ledger as L
from tidemark.operators import scoring as S
from tidemark.plans.ledger import BASE, EPISODES
from tidemark.sources import adapters as A

#: Scores are taken at 2003-01-01 with windows of one and six years, as the given trades span years.
NOW = 1_041_379_200
DAYS = (365, 2190)


def returns(spark, d):
    """Realized episodes as return rows."""
    e = L.episodes(A.trades(spark, d)).where("status = 'realized' AND return_pct IS NOT NULL")
    return e.select("wallet", "token", "opened_t", F.col("closed_t").alias("t"), F.col("return_pct").alias("value"), F.concat_ws(":", "token", "episode").alias("tie"), (F.col("return_pct") < -90).alias("rugged"), "high_quality")


RETURNS = """rets AS (SELECT wallet, token, opened_t, closed_t AS t, return_pct AS value, concat_ws(':', token, episode) AS tie, return_pct < -90 AS rugged, high_quality
  FROM episodes WHERE status = 'realized' AND return_pct IS NOT NULL)"""
ROWS = BASE[:-1] + ", " + EPISODES + ", " + RETURNS


def st(x: str, name: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5001) / 1e4 AS {name}"


def metrics_sql(source: str, keys: str) -> str:
    """CTEs m0, m1 and met: METRICS per keys of source."""
    return f"""m0 AS (
  SELECT *, max(CASE WHEN value <= -100 THEN 1 ELSE 0 END) OVER w AS lost, sum(CASE WHEN value > -100 THEN ln(1 + value / 100) ELSE 0 END) OVER w AS lg,
    sum(CASE WHEN value >= 0 THEN 1 ELSE 0 END) OVER w AS island, row_number() OVER (PARTITION BY {keys} ORDER BY value, tie) AS low, count(*) OVER (PARTITION BY {keys}) AS size
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY t, tie ROWS UNBOUNDED PRECEDING)
), m1 AS (
  SELECT *, CASE WHEN lost = 1 THEN 100 ELSE (1 - exp(lg - greatest(0, max(lg) OVER w))) * 100 END AS fall,
    sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}, island ORDER BY t, tie ROWS UNBOUNDED PRECEDING) AS run
  FROM m0 WINDOW w AS (PARTITION BY {keys} ORDER BY t, tie ROWS UNBOUNDED PRECEDING)
), met AS (
  SELECT {keys}, count(*) AS n, avg(value) AS avg_pct, median(value) AS median_pct, CASE WHEN count(*) > 1 THEN (sum(value) - max(value)) / (count(*) - 1) ELSE 0 END AS avg_ex_best_pct,
    CASE WHEN max(value) > 0 THEN max(value) / sum(greatest(value, 0)) ELSE 0 END AS best_share, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
    CASE WHEN min(value) < 0 THEN sum(greatest(value, 0)) / -sum(least(value, 0)) WHEN max(value) > 0 THEN 99 ELSE 0 END AS profit_factor, min(value) AS worst_pct, max(fall) AS drawdown_pct,
    greatest(0, (avg((value > 0)::INT) + 3.841458820694124 / (2 * count(*)) - 1.959963984540054 * sqrt((avg((value > 0)::INT) * (1 - avg((value > 0)::INT)) + 3.841458820694124 / (4 * count(*))) / count(*))) / (1 + 3.841458820694124 / count(*))) AS wilson,
    (sum((value > 0)::INT) + 5) / (count(*) + 10) AS shrunk_hit, count(*) / (count(*) + 10) AS reliability, sum(rugged::INT) AS rugged, avg(rugged::INT) AS rugged_rate, sum((value <= -50)::INT) AS catastrophic,
    avg((value <= -50)::INT) AS catastrophic_rate, avg(CASE WHEN low <= greatest(1, ceil(size * 0.1)) THEN value END) AS tail_avg_pct, max(run) AS loss_run
  FROM m1 GROUP BY {keys})"""


def f1(spark, d):
    r = S.robust_stats(returns(spark, d), ["wallet"])
    return r.select("wallet", "n", *[steady(F.col(c)).alias(c) for c in ("mean_", "median_", "mean_ex_best", "best_share")])


COUNTS = ("n", "rugged", "catastrophic", "loss_run")


def f2(spark, d):
    r = S.return_metrics(returns(spark, d), ["wallet"])
    return r.select("wallet", *[F.col(c).cast("long").alias(c) if c in COUNTS else steady(F.col(c)).alias(c) for c in S.METRICS])


def f3(spark, d):
    r = returns(spark, d).groupBy("token").agg(F.count_if(F.col("value") > 0).alias("wins"), F.count(F.lit(1)).alias("n"))
    return r.select("token", "n", steady(wilson_lower(F.col("wins"), F.col("n"))).alias("low"), steady(wilson_upper(F.col("wins") / F.col("n"), F.col("n"))).alias("high"))


def f4(spark, d):
    r = S.drawdown_and_runs(returns(spark, d), ["wallet"]).groupBy("wallet").agg(F.max("fall").alias("fall"))
    return r.select("wallet", steady(F.col("fall")).alias("drawdown_pct"))


def f5(spark, d):
    return S.drawdown_and_runs(returns(spark, d), ["wallet"]).groupBy("wallet").agg(F.max("loss_run").cast("long").alias("loss_run"))


def f6(spark, d):
    r = S.recency_decay(returns(spark, d), ["wallet"], NOW)
    return r.select("wallet", (F.floor(F.col("decay") * 1e8 + 0.5001) / 1e8).alias("decay"))


def f8(spark, d):
    # a row counts in each window that it lies in
    late = S.window_slice(returns(spark, d), NOW, max(DAYS))
    spans = F.filter(F.array(*[F.lit(n) for n in DAYS]), lambda n: F.col("t") >= F.lit(NOW) - n * S.DAY)
    return late.select("wallet", F.explode(spans).alias("days")).groupBy("wallet", "days").agg(F.count(F.lit(1)).alias("n")).select("wallet", "n", "days")


def f9(spark, d):
    return S.holdouts(returns(spark, d), ["wallet"])


def f10(spark, d):
    r = S.return_metrics(returns(spark, d), ["wallet"])
    return r.select("wallet", *[S.robust_gate(g).alias(g) for g in S.ROBUST])


def f11(spark, d):
    r = S.return_metrics(returns(spark, d), ["wallet"])
    return r.select("wallet", *[S.managed_gate(g).alias(g) for g in S.MANAGED])


def f12(spark, d):
    r = S.return_metrics(returns(spark, d), ["wallet"])
    return r.select("wallet", S.quality_score().alias("score"), S.quality_score(managed=True).alias("managed_score"))


def scores(spark, d, creators=None):
    # read by both axes, both windows, holdouts, decay and shape
    positions = stored(returns(spark, d))
    follows = positions.where("high_quality").select("wallet", "t", "value", "tie", "rugged")
    return S.wallet_scores(positions, follows, NOW, DAYS, creators)


def creators(spark, d):
    """Wallets that made the first trade of a token, as the given tables name no creators."""
    return first_by(A.trades(spark, d), ["token"], ["t", "key"]).select("wallet")


def f13(spark, d):
    return scores(spark, d, creators(spark, d)).withColumn("hq_coverage", steady(F.col("hq_coverage")))


def f20(spark, d):
    return S.status_counts(scores(spark, d))


def f21(spark, d):
    return S.rankings(scores(spark, d), 50).select("wallet", "status", "overall_score", "positions")


def features(spark, d):
    """Token features from parts, for the token score."""
    p = A.table(spark, d, "part")
    n, price = F.col("p_partkey"), F.col("p_retailprice")
    return p.select(
        n.alias("token"), (n % 60).cast("double").alias("token_age_minutes"), (price * (n % 40)).alias("liquidity_usd"), (price * (n % 15)).alias("volume5m_usd"), (price * (n % 50)).alias("volume1h_usd"),
        (n % 45).cast("double").alias("top_holder_pct"), (n % 4).cast("double").alias("smart_wallets"), (n % 90).cast("double").alias("avg_smart_score"), (n % 101).cast("double").alias("creator_score"),
        (n % 3 != 0).alias("mint_revoked"), (n % 5 != 0).alias("freeze_revoked"), (n % 30).alias("buys5m"), (n % 17).alias("sells5m"), (n % 2 == 0).alias("metadata_complete"), (n % 11 == 0).alias("duplicate_branding"),
        (n % 13 == 0).alias("liquidity_removed"), (n % 50).cast("double").alias("insider_pct"), (n % 80).cast("double").alias("wash_suspicion"), (n % 95).cast("double").alias("bot_pct"),
    )


def f17(spark, d):
    return S.token_score(features(spark, d), 10_000, 5_000, 25).select("token", "score", "risk_score", "confidence", "warnings")


def f19(spark, d):
    s = S.token_score(features(spark, d), 10_000, 5_000, 25)
    return s.select("token", S.signal_action(F.col("score"), F.col("risk_score"), F.col("confidence"), 60, 65).alias("action"))


CL = "greatest(0, least(100, {}))"
FEATURES = """feat AS (SELECT p_partkey AS token, p_partkey AS n, p_retailprice AS price FROM part), sub AS (
  SELECT token, n, price * (n % 40) AS liq, price * (n % 15) AS v5, price * (n % 50) AS v1,
    (n % 3 = 0)::INT AS mint_kept, (n % 5 = 0)::INT AS freeze_kept, (n % 11 = 0)::INT AS dup, (n % 13 = 0)::INT AS removed FROM feat
), scored AS (
  SELECT *, greatest(0, least(100, mint_kept * 18 + freeze_kept * 16 + greatest(0, n % 45 - 25) * 1.4::DOUBLE + removed * 28 + (n % 50) * 0.32::DOUBLE + (n % 80) * 0.24::DOUBLE + (n % 95) * 0.18::DOUBLE + dup * 14)) AS risk,
    (liq < 10000)::INT + (v5 < 5000)::INT + mint_kept + freeze_kept + (n % 45 > 25)::INT + removed + (n % 50 > 35)::INT + (n % 80 > 60)::INT + (n % 95 > 75)::INT + dup AS warnings,
    greatest(0, least(100, 100 - (n % 60) * 1.7::DOUBLE)) * 0.1::DOUBLE + greatest(0, least(100, liq / 10000 * 70)) * 0.14::DOUBLE + greatest(0, least(100, v5 / 5000 * 75)) * 0.12::DOUBLE
      + greatest(0, least(100, 100 - (n % 45) * 2.1::DOUBLE)) * 0.13::DOUBLE + greatest(0, least(100, (n % 4) * 18 + (n % 90) * 0.55::DOUBLE)) * 0.16::DOUBLE + least(100, n % 101) * 0.1::DOUBLE
      + least(100, (1 - mint_kept) * 45 + (1 - freeze_kept) * 45 + 10) * 0.14::DOUBLE
      + greatest(0, least(100, CASE WHEN n % 30 + n % 17 > 0 THEN 55 + (n % 30 - n % 17) / (n % 30 + n % 17)::DOUBLE * 35 ELSE 25 END)) * 0.07::DOUBLE
      + greatest(0, least(100, CASE WHEN n % 2 = 0 THEN 78 ELSE 38 END - dup * 38)) * 0.04::DOUBLE AS base FROM sub
), fin AS (
  SELECT token, warnings::INTEGER AS warnings, floor(greatest(0, least(100, base - risk * 0.35)) * 100 + 0.5) / 100 AS score, floor(risk * 100 + 0.5) / 100 AS risk_score,
    floor(greatest(0, least(100, 35 + least(v1 / 5000, 8) * 5 + least(liq / 10000, 5) * 4 + CASE WHEN n % 4 > 0 THEN 12 ELSE 0 END - CASE WHEN warnings > 4 THEN 8 ELSE 0 END)) * 100 + 0.5) / 100 AS confidence FROM scored)"""
GATE = "median_pct >= 0 AND avg_ex_best_pct > 0 AND hit_rate >= {} AND profit_factor >= {} AND worst_pct >= {} AS {}"
MET = ROWS + ", " + metrics_sql("rets", "wallet")
LATE = """late AS (SELECT * FROM (SELECT *, (back <= 10)::INT AS part FROM (SELECT *, count(*) OVER (PARTITION BY wallet) AS all_, row_number() OVER (PARTITION BY wallet ORDER BY t DESC, tie DESC) AS back FROM rets)) WHERE all_ >= 30 AND back <= 20)"""


def score_sql(risk: str, name: str) -> str:
    return f"""floor(greatest(0, least(100, least(20, n * 1.25::DOUBLE) + greatest(0, least(20, median_pct + 10)) + greatest(0, least(20, wilson * 30)) + greatest(0, least(15, profit_factor * 10))
    + greatest(0, least(15, avg_ex_best_pct + 5)) + greatest(0, least(10, 10 + {risk} / 10)) - greatest(0, (best_share - 0.35) * 40))) * (0.5 + 0.5 * reliability) * 100 + 0.5) / 100 AS {name}"""


QUERIES = {
    "f1_robust_stats": (f1, MET + f" SELECT wallet, n, {st('avg_pct', 'mean_')}, {st('median_pct', 'median_')}, {st('avg_ex_best_pct', 'mean_ex_best')}, {st('best_share', 'best_share')} FROM met"),
    "f2_return_metrics": (f2, MET + " SELECT wallet, " + ", ".join(f"{c}::BIGINT AS {c}" if c in COUNTS else st(c, c) for c in S.METRICS) + " FROM met"),
    "f3_wilson_bounds": (
        f3,
        ROWS + f""", w AS (SELECT token, count(*) AS n, avg((value > 0)::INT) AS p FROM rets GROUP BY token) SELECT token, n,
        {st('greatest(0, (p + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt((p * (1 - p) + 3.841458820694124 / (4 * n)) / n)) / (1 + 3.841458820694124 / n))', 'low')},
        {st('least(1, (p + 2.706025 / (2 * n) + 1.645 * sqrt((p * (1 - p) + 2.706025 / (4 * n)) / n)) / (1 + 2.706025 / n))', 'high')} FROM w""",
    ),
    "f4_max_drawdown": (f4, MET + f" SELECT wallet, {st('drawdown_pct', 'drawdown_pct')} FROM met"),
    "f5_max_loss_run": (f5, MET + " SELECT wallet, loss_run::BIGINT AS loss_run FROM met"),
    "f6_recency_decay": (f6, ROWS + f" SELECT wallet, floor(avg(exp(-0.6931471805599453 * greatest(0, {NOW} - t) / 2592000)) * 1e8 + 0.5001) / 1e8 AS decay FROM rets GROUP BY wallet"),
    "f8_window_slice": (f8, ROWS + " " + " UNION ALL ".join(f"SELECT wallet, count(*) AS n, {x} AS days FROM rets WHERE t <= {NOW} AND t >= {NOW} - {x} * 86400 GROUP BY wallet" for x in DAYS)),
    "f9_holdouts": (f9, ROWS + ", " + LATE + ", " + metrics_sql("late", "wallet, part") + " SELECT wallet, bool_and(ok) AS holdouts_pass FROM (SELECT wallet, " + GATE.format(0.5, 1.2, -35, "ok") + " FROM met) GROUP BY wallet"),
    "f10_gates_fixed": (f10, MET + " SELECT wallet, " + ", ".join(GATE.format(*v, k) for k, v in S.ROBUST.items()) + " FROM met"),
    "f11_gates_managed": (f11, MET + " SELECT wallet, " + ", ".join(f"rugged_rate <= {a} AND catastrophic_rate <= {b} AS {k}" for k, (a, b) in S.MANAGED.items()) + " FROM met"),
    "f12_quality_score": (f12, MET + f" SELECT wallet, {score_sql('worst_pct', 'score')}, {score_sql('tail_avg_pct', 'managed_score')} FROM met"),
    "f13_wallet_scores": (f13, None),
    "f17_token_score": (f17, "WITH " + FEATURES + " SELECT token, score, risk_score, confidence, warnings FROM fin"),
    "f19_signal_action": (
        f19,
        "WITH " + FEATURES + """ SELECT token, CASE WHEN risk_score > 60 THEN 'high-risk warning' WHEN score < 42 OR confidence < 35 THEN 'ignore' WHEN confidence >= 65 AND score >= 76 AND risk_score <= 45
        THEN 'paper-trade candidate' WHEN score >= 64 AND confidence >= 55 THEN 'research candidate' ELSE 'watchlist' END AS action FROM fin""",
    ),
    "f20_status_counts": (f20, None),
    "f21_rankings": (f21, None),
}
