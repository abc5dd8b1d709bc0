"""Return metrics, gates, quality scores and wallet snapshots, all as aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import clamp, deterministic_id, first_by, js_round, running, wilson_lower

DAY = 86_400
#: Fixed values of the scoring policy.
CATASTROPHIC_PCT = -50.0
HALF_LIFE_DAYS = 30.0
PROFIT_FACTOR_TOP = 99.0
ROBUST = {
    "watch": (0.5, 1.1, -100.0),
    "watch_follow": (0.5, 1.1, -35.0),
    "candidate": (0.55, 1.2, -100.0),
    "candidate_follow": (0.55, 1.2, -35.0),
    "holdout": (0.5, 1.2, -35.0),
}
MANAGED = {"watch": (0.05, 0.05), "candidate": (0.025, 0.05), "holdout": (0.1, 0.1)}
STATUSES = ("insufficient", "observed", "watch", "candidate", "validated-paper")

METRICS = [
    "n", "avg_pct", "median_pct", "avg_ex_best_pct", "best_share", "hit_rate", "profit_factor", "worst_pct", "drawdown_pct", "wilson",
    "shrunk_hit", "reliability", "rugged", "rugged_rate", "catastrophic", "catastrophic_rate", "tail_avg_pct", "loss_run",
]


def robust_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean, median, mean without the best, share of the best in the gains; rows (keys, value)."""
    v = F.col("value")
    gains = F.sum(F.when(v > 0, v))
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean_"),
        F.percentile(v, F.lit(0.5)).alias("median_"),
        F.when(F.count(v) > 1, (F.sum(v) - F.max(v)) / (F.count(v) - 1)).otherwise(F.lit(0.0)).alias("mean_ex_best"),
        F.coalesce(F.max(F.when(v > 0, v)) / gains, F.lit(0.0)).alias("best_share"),
    )


def drawdown_and_runs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows (keys, value, t, tie) plus per row the fall of compounded equity from its peak (percent) and the length of its run of losses.

    Equity is a running sum of logarithms; from a total loss on the fall is 100.
    """
    w = running(keys, ["t", "tie"])
    out = rows.withColumn("_lost", F.max((F.col("value") <= -100).cast("int")).over(w))
    out = out.withColumn("_log", F.sum(F.when(F.col("value") > -100, F.log1p(F.col("value") / 100)).otherwise(F.lit(0.0))).over(w))
    out = out.withColumn("_peak", F.greatest(F.lit(0.0), F.max("_log").over(w)))
    out = out.withColumn("fall", F.when(F.col("_lost") == 1, F.lit(100.0)).otherwise((1 - F.exp(F.col("_log") - F.col("_peak"))) * 100))
    # losses since the last row without one
    out = out.withColumn("_losses", F.sum((F.col("value") < 0).cast("int")).over(w))
    kept = F.max(F.when(F.col("value") >= 0, F.col("_losses"))).over(w)
    return out.withColumn("loss_run", F.col("_losses") - F.coalesce(kept, F.lit(0))).drop("_lost", "_log", "_peak", "_losses")


def return_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of METRICS per key of rows (keys, value, t, tie, rugged)."""
    low = F.row_number().over(Window.partitionBy(*keys).orderBy("value", "tie"))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    marked = drawdown_and_runs(rows, keys).withColumn("_low", low).withColumn("_tail", F.greatest(F.lit(1), F.ceil(size * 0.1)))
    v, n = F.col("value"), F.count(F.lit(1))
    wins, gains, losses = F.count_if(v > 0), F.sum(F.when(v > 0, v).otherwise(F.lit(0.0))), F.abs(F.sum(F.when(v < 0, v).otherwise(F.lit(0.0))))
    bad = F.count_if(v <= CATASTROPHIC_PCT)
    return marked.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(v).alias("avg_pct"),
        F.percentile(v, F.lit(0.5)).alias("median_pct"),
        F.when(n > 1, (F.sum(v) - F.max(v)) / (n - 1)).otherwise(F.lit(0.0)).alias("avg_ex_best_pct"),
        F.when(gains > 0, F.max(v) / gains).otherwise(F.lit(0.0)).alias("best_share"),
        (wins / n).alias("hit_rate"),
        F.when(losses > 0, gains / losses).when(gains > 0, F.lit(PROFIT_FACTOR_TOP)).otherwise(F.lit(0.0)).alias("profit_factor"),
        F.min(v).alias("worst_pct"),
        F.max("fall").alias("drawdown_pct"),
        wilson_lower(wins, n).alias("wilson"),
        ((wins + 5) / (n + 10)).alias("shrunk_hit"),
        (n / (n + 10)).alias("reliability"),
        F.count_if("rugged").alias("rugged"),
        (F.count_if("rugged") / n).alias("rugged_rate"),
        bad.alias("catastrophic"),
        (bad / n).alias("catastrophic_rate"),
        F.avg(F.when(F.col("_low") <= F.col("_tail"), v)).alias("tail_avg_pct"),
        F.max("loss_run").alias("loss_run"),
    )


def window_slice(rows: DataFrame, now: int, days: int, at: str = "t") -> DataFrame:
    """Rows of the ``days`` before ``now``; future rows are left out."""
    return rows.where((F.col(at) <= now) & (F.col(at) >= now - days * DAY))


def recency_decay(rows: DataFrame, keys: Sequence[str], now: int) -> DataFrame:
    """Mean of exp(-ln 2 * age / half life) per key."""
    age = F.greatest(F.lit(0), F.lit(now) - F.col("t"))
    return rows.groupBy(*keys).agg(F.avg(F.exp(F.lit(-0.6931471805599453) * age / (HALF_LIFE_DAYS * DAY))).alias("decay"))


def robust_gate(name: str, prefix: str = "") -> Column:
    hit, factor, worst = ROBUST[name]
    c = lambda x: F.col(prefix + x)
    return (c("median_pct") >= 0) & (c("avg_ex_best_pct") > 0) & (c("hit_rate") >= hit) & (c("profit_factor") >= factor) & (c("worst_pct") >= worst)


def managed_gate(name: str, prefix: str = "") -> Column:
    rugged, bad = MANAGED[name]
    return (F.col(f"{prefix}rugged_rate") <= rugged) & (F.col(f"{prefix}catastrophic_rate") <= bad)


def holdouts(rows: DataFrame, keys: Sequence[str], managed: bool = False) -> DataFrame:
    """Per key whether, of at least 30 rows, the last 20 to 11 and the last 10 both pass the robust gate."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("tie")))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    late = rows.withColumn("_size", size).withColumn("_back", back).where("_size >= 30 AND _back <= 20").withColumn("part", (F.col("_back") <= 10).cast("int"))
    each = return_metrics(late, [*keys, "part"])
    passed = robust_gate("holdout")
    if managed:
        passed = (F.col("median_pct") >= 0) & (F.col("avg_ex_best_pct") > 0) & (F.col("hit_rate") >= 0.5) & (F.col("profit_factor") >= 1.2) & managed_gate("holdout")
    return each.groupBy(*keys).agg(F.bool_and(passed).alias("holdouts_pass"))


def quality_score(prefix: str = "", managed: bool = False) -> Column:
    """Six capped parts less concentration, scaled by reliability; 0 without samples."""
    c = lambda x: F.coalesce(F.col(prefix + x).cast("double"), F.lit(0.0))
    cap = lambda x, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), x))
    risk = c("tail_avg_pct") if managed else c("worst_pct")
    raw = (
        F.least(F.lit(20.0), c("n") * 1.25) + cap(c("median_pct") + 10, 20) + cap(c("wilson") * 30, 20) + cap(c("profit_factor") * 10, 15)
        + cap(c("avg_ex_best_pct") + 5, 15) + cap(10 + risk / 10, 10) - F.greatest(F.lit(0.0), (c("best_share") - 0.35) * 40)
    )
    score = js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)) * (0.5 + 0.5 * c("reliability")))
    return F.when(c("n") > 0, score).otherwise(F.lit(0.0))


def _wide(df: DataFrame, cases: dict[str, Column], columns: Sequence[str]) -> DataFrame:
    """One row per wallet with the columns of each case under its prefix."""
    picked = [F.any_value(F.when(when, F.col(c)), ignoreNulls=F.lit(True)).alias(prefix + c) for prefix, when in cases.items() for c in columns]
    return df.groupBy("wallet").agg(*picked)


def wallet_scores(positions: DataFrame, follows: DataFrame, now: int, days: tuple[int, int] = (30, 90), creators: DataFrame | None = None) -> DataFrame:
    """One snapshot per wallet of positions (wallet, token, opened_t, t, value, tie, rugged, high_quality) and follows (wallet, t, value, tie, rugged).

    Both axes and both windows go through one pass of metrics, keyed by (wallet, axis, window).
    """
    short, long = days
    cols = ["wallet", "t", "value", "tie", "rugged"]
    rows = positions.select(*cols, F.lit("p").alias("axis")).unionByName(follows.select(*cols, F.lit("f").alias("axis")))
    late = window_slice(rows, now, long)
    spans = F.filter(F.array(F.lit(short), F.lit(long)), lambda n: F.col("t") >= F.lit(now) - n * DAY)
    metrics = return_metrics(late.withColumn("span", F.explode(spans)), ["wallet", "axis", "span"])
    axis = {"p_": F.col("axis") == "p", "f_": F.col("axis") == "f"}
    parts = [
        _wide(metrics, {f"{k[0]}{n}_": on & (F.col("span") == n) for k, on in axis.items() for n in days}, METRICS),
        _wide(recency_decay(late, ["wallet", "axis"], now), axis, ["decay"]),
        _wide(holdouts(late, ["wallet", "axis"]), axis, ["holdouts_pass"]),
    ]
    recent = window_slice(positions, now, long)
    days_of = recent.select("wallet", F.explode(F.array(F.floor(F.col("opened_t") / DAY), F.floor(F.col("t") / DAY))).alias("day"))
    active = days_of.groupBy("wallet").agg(F.countDistinct("day").alias("active_days"))
    shape = recent.groupBy("wallet").agg(F.countDistinct("token").alias("tokens"), F.avg(F.col("high_quality").cast("double")).alias("hq_coverage"))
    out = rows.select("wallet").distinct()
    for part in (*parts, active, shape):
        out = out.join(part, "wallet", "left")
    out = out.fillna(0).fillna(False)
    p, f = f"p{long}_", f"f{long}_"
    both = lambda n, name, fname: (F.col(p + "n") >= n) & robust_gate(name, p) & (F.col(f + "n") >= n) & robust_gate(fname, f)
    gates = {
        "observed": (F.col(p + "n") >= 3) | (F.col(f + "n") >= 3),
        "watch": both(8, "watch", "watch_follow") & (F.col("active_days") >= 4),
        "candidate": both(15, "candidate", "candidate_follow") & (F.col("active_days") >= 7) & (F.col("hq_coverage") >= 0.9) & (F.col(p + "best_share") <= 0.4) & (F.col(f + "best_share") <= 0.4),
    }
    out = out.withColumns({f"is_{k}": v for k, v in gates.items()})
    proven = F.col("is_candidate") & (F.col(p + "n") >= 30) & (F.col(f + "n") >= 30) & (F.col("active_days") >= 14) & F.col("p_holdouts_pass") & F.col("f_holdouts_pass")
    status = F.when(proven, "validated-paper").when(F.col("is_candidate"), "candidate").when(F.col("is_watch"), "watch").when(F.col("is_observed"), "observed").otherwise("insufficient")
    if creators is not None:
        out = out.join(creators.select("wallet").distinct().withColumn("_creator", F.lit(True)), "wallet", "left")
        status = F.when(F.coalesce("_creator", F.lit(False)), "excluded").otherwise(status)

    def blended(a: str) -> Column:
        s, lo = quality_score(f"{a}{short}_"), quality_score(f"{a}{long}_")
        mixed = F.when(F.col(f"{a}{short}_n") > 0, s * 0.65 + lo * 0.35).otherwise(lo)
        return js_round(mixed * (0.75 + 0.25 * F.col(f"{a}_decay")))

    out = out.withColumn("status", status).withColumn("profitability_score", blended("p")).withColumn("followability_score", blended("f"))
    out = out.withColumn("overall_score", js_round(F.least(F.lit(100.0), F.col("profitability_score") * 0.55 + F.col("followability_score") * 0.45)))
    reliable = js_round(F.lit(100.0) * (F.col(p + "wilson") * F.col(p + "reliability") + F.col(f + "wilson") * F.col(f + "reliability")) / 2)
    return out.withColumn("reliability_score", reliable).select(
        "wallet", "status", "profitability_score", "followability_score", "overall_score", "reliability_score", F.col(p + "n").alias("positions"),
        F.col(f + "n").alias("follows"), "tokens", "active_days", "hq_coverage", "p_holdouts_pass", "f_holdouts_pass",
    )


def followability_returns(entries: DataFrame, outcomes: DataFrame, exit_strategy: str = "fixed-horizon") -> DataFrame:
    """Per wallet and token the first eligible entry's earliest mature outcome: (wallet, token, t, value, tie, rugged)."""
    able = entries.where((F.trim("source_key") != "") & (F.col("cohort") != "excluded-uncontrolled-flow") & F.col("risk_passed") & F.col("pool_age_minutes").between(0, 30))
    first = first_by(able, ["wallet", "token"], ["t", "entry_key"]).select("wallet", "token", "entry_key")
    mature = outcomes.where((F.col("status") == "mature") & (F.col("exit_strategy") == exit_strategy) & F.col("net_return_pct").isNotNull())
    return first.join(first_by(mature, ["entry_key"], ["outcome_t"]), "entry_key").select(
        "wallet", "token", F.col("outcome_t").alias("t"), F.col("net_return_pct").alias("value"), F.col("entry_key").alias("tie"), "rugged"
    )


def wallet_signals(scores: DataFrame, entries: DataFrame, now: int, max_age_s: int = 6 * 3600, min_liquidity: float = 10_000.0, strategy: str = "s") -> DataFrame:
    """Per token the first recent eligible entry of qualified wallets, their number, and a confidence."""
    good = scores.where(F.col("status").isin("watch", "candidate", "validated-paper")).select("wallet", "status", "overall_score")
    fresh = entries.where((F.lit(now) - F.col("t")).between(0, max_age_s) & (F.col("liquidity_usd") >= min_liquidity) & F.col("risk_passed") & F.col("pool_age_minutes").between(0, 30))
    rows = fresh.join(good, "wallet")
    each = rows.groupBy("token", "wallet").agg(F.min(F.struct("t", "entry_key", "entry_price", "pool")).alias("first"), F.first("status").alias("status"), F.first("overall_score").alias("score"))
    out = each.groupBy("token").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("wallets"), F.avg("score").alias("avg_score"), F.max(F.col("status").isin("candidate", "validated-paper").cast("int")).alias("strong"))
    confidence = js_round(F.least(F.lit(100.0), F.col("avg_score") + F.least(F.lit(15.0), (F.col("wallets") - 1) * 5.0)))
    return out.select(
        deterministic_id(F.lit(strategy), F.col("token"), "wallet-alpha-paper-signal").alias("signal_id"), "token", "first.pool", F.col("first.t").alias("t"),
        F.col("first.entry_price").alias("price_usd"), "wallets", confidence.alias("confidence"), F.when(F.col("strong") == 1, "paper-candidate").otherwise("paper-watch").alias("status"),
    )


def status_counts(scores: DataFrame) -> DataFrame:
    """Wallets by status, as one row."""
    return scores.agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES])


def rankings(scores: DataFrame, limit: int, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """The best ``limit`` wallets by status, score, positions, name."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return scores.where(F.col("status").isin(*statuses)).orderBy(rank.desc(), F.desc("overall_score"), F.desc("positions"), "wallet").limit(limit)


#: Fixed weights of the token score's nine parts.
TOKEN_WEIGHTS = (("freshness", 0.1), ("liquidity", 0.14), ("volume", 0.12), ("holders", 0.13), ("smart", 0.16), ("creator", 0.1), ("safety", 0.14), ("structure", 0.07), ("metadata", 0.04))


def token_score(features: DataFrame, min_liquidity: float, min_volume: float, max_top_holder: float) -> DataFrame:
    """score, risk_score, confidence and the number of warnings per row of token features."""
    c, flag = F.col, lambda x: F.col(x).cast("double")
    trades = c("buys5m") + c("sells5m")
    sub = {
        "freshness": 100 - c("token_age_minutes") * 1.7,
        "liquidity": c("liquidity_usd") / min_liquidity * 70,
        "volume": c("volume5m_usd") / min_volume * 75,
        "holders": 100 - c("top_holder_pct") * 2.1,
        "smart": c("smart_wallets") * 18 + c("avg_smart_score") * 0.55,
        "creator": c("creator_score"),
        "safety": flag("mint_revoked") * 45 + flag("freeze_revoked") * 45 + 10,
        "structure": F.when(trades > 0, 55 + (c("buys5m") - c("sells5m")) / trades * 35).otherwise(F.lit(25.0)),
        "metadata": F.when(c("metadata_complete"), 78.0).otherwise(38.0) - flag("duplicate_branding") * 38,
    }
    base = sum((clamp(sub[k]) * w for k, w in TOKEN_WEIGHTS), F.lit(0.0)) / sum(w for _, w in TOKEN_WEIGHTS)
    warnings = [
        c("liquidity_usd") < min_liquidity, c("volume5m_usd") < min_volume, ~c("mint_revoked"), ~c("freeze_revoked"), c("top_holder_pct") > max_top_holder,
        c("liquidity_removed"), c("insider_pct") > 35, c("wash_suspicion") > 60, c("bot_pct") > 75, c("duplicate_branding"),
    ]
    n = sum((w.cast("int") for w in warnings), F.lit(0))
    risk = clamp(
        (1 - flag("mint_revoked")) * 18 + (1 - flag("freeze_revoked")) * 16 + F.greatest(F.lit(0.0), c("top_holder_pct") - max_top_holder) * 1.4
        + flag("liquidity_removed") * 28 + c("insider_pct") * 0.32 + c("wash_suspicion") * 0.24 + c("bot_pct") * 0.18 + flag("duplicate_branding") * 14
    )
    confidence = clamp(
        35 + F.least(c("volume1h_usd") / max(min_volume, 1), F.lit(8.0)) * 5 + F.least(c("liquidity_usd") / max(min_liquidity, 1), F.lit(5.0)) * 4
        + F.when(c("smart_wallets") > 0, 12).otherwise(0) - F.when(n > 4, 8).otherwise(0)
    )
    return features.withColumn("warnings", n).withColumn("risk_score", js_round(risk)).withColumn("score", js_round(clamp(base - risk * 0.35))).withColumn("confidence", js_round(confidence))


def signal_action(score: Column, risk: Column, confidence: Column, max_risk: float, alert_confidence: float) -> Column:
    return (
        F.when(risk > max_risk, "high-risk warning")
        .when((score < 42) | (confidence < 35), "ignore")
        .when((confidence >= alert_confidence) & (score >= 76) & (risk <= 45), "paper-trade candidate")
        .when((score >= 64) & (confidence >= 55), "research candidate")
        .otherwise("watchlist")
    )
