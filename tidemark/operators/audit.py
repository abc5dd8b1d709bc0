"""Reports and audits put together from the other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import clamp, first_by, js_round
from tidemark.functions.scratch import stored
from tidemark.operators.outcomes import assess_fixed_horizon
from tidemark.operators.research import modeled_return, prior_history, split_times, trailing_runs, window_at, window_stats
from tidemark.operators.scoring import robust_stats
from tidemark.operators.threshold_cube import Audit, Dimension, cube_audit


def strict_predicate(limits: dict[str, tuple[float | None, float | None]], flags: Sequence[str]) -> Column:
    """All named columns within their limits and all flags set; a missing value fails."""
    out = F.lit(True)
    for name, (low, high) in limits.items():
        out = out & (F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high)
    for name in flags:
        out = out & F.col(name)
    return F.coalesce(out, F.lit(False))


def evidence_score(rows: DataFrame) -> DataFrame:
    """Per wallet a score of its canonical outcomes (rows wallet, value: net return in percent) and a confidence.

    ``watch``: three outcomes or more, mean and median not negative, half of them
    wins, none below -35. ``candidate``: four or more, a mean of 2, a positive mean
    without the best, no win with over 35 % of all gains, and a score of 60.
    """
    v = F.col("value")
    stats = rows.groupBy("wallet").agg(
        F.count(v).alias("n"), F.avg(v).alias("average"), F.median(v).alias("median"), F.avg((v > 0).cast("double")).alias("hit_rate"), F.min(v).alias("worst"),
        F.when(F.count(v) > 1, (F.sum(v) - F.max(v)) / (F.count(v) - 1)).otherwise(0.0).alias("ex_best"),
        F.coalesce(F.max(F.when(v > 0, v)) / F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("best_share"),
    )
    watch = F.coalesce((F.col("n") >= 3) & (F.col("average") >= 0) & (F.col("median") >= 0) & (F.col("hit_rate") >= 0.5) & (F.col("worst") >= -35), F.lit(False))
    gain = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("average")))
    score = F.when(watch, clamp(30 + F.least(F.col("n"), F.lit(10)) * 3 + gain + F.col("hit_rate") * 20 + 10)).otherwise(0.0)
    strong = watch & (F.col("n") >= 4) & (F.col("average") >= 2) & (F.col("ex_best") > 0) & (F.col("best_share") <= 0.35) & (F.col("score") >= 60)
    return stats.withColumn("score", score).withColumn("confidence", F.when(strong, "candidate").when(watch, "watch").otherwise("insufficient"))


# fixed values: thresholds of the grid, each dimension in order
SAFE_WALLETS = (("safe3", 1), ("safe3", 2), ("safe6", 1), ("safe6", 2))
LEAST_LIQUIDITY = (10_000, 20_000, 30_000, 40_000)
BUY_SHARE = ((0.5, 0.56), (0.5, 0.58), (0.5, 0.6), (0.52, 0.58), (0.52, 0.6))
VOLUME_RATIO_BELOW = (0.35, 0.4, 0.45, 0.5)
POOL_AGE = ((0, 10), (2, 20), (5, 40))
TOP10_BELOW = (15, 20)
PRIOR_CLEAN_MARKETS = (0, 1, 2)
STRICT = {"liquidity_usd": (10_000, None), "volume_5m_usd": (5_000, None), "pool_age_minutes": (5, None), "transactions_5m": (20, None), "buy_share_5m": (0.5, None)}
STRICT_BELOW = {"buy_share_5m": 0.6, "volume_liquidity_ratio": 0.5, "top10_percent": 20}
STRICT_FLAGS = ("controlled_flow", "risk_known", "risk_passed", "mint_revoked", "freeze_revoked")
V4_LEAST, V4_LEAST_TOTAL = {"train": 12, "validation": 6, "holdout1": 6, "holdout2": 6}, 30


def strict_v2() -> Column:
    """The 13 conditions that every candidate asks for."""
    below = F.lit(True)
    for name, top in STRICT_BELOW.items():
        below = below & (F.col(name) < top)
    return strict_predicate(STRICT, STRICT_FLAGS) & F.coalesce(below, F.lit(False))


def _steps(column: str, marks: Sequence[float]) -> Column:
    """How many of the marks a value has reached, less one; null below the first."""
    out = F.lit(None).cast("int")
    for k, mark in enumerate(marks):
        out = F.when(F.col(column) >= mark, k).otherwise(out)
    return out


def v4_dimensions() -> list[Dimension]:
    """The grid of 5,760 candidates; records have prior_n and prior_bad, what their creator had completed before."""
    cut = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), F.lit(2))
    safe = lambda kind, least: [k for k in range(9) if (k // 3 if kind == "safe3" else k % 3) >= least]
    edges = sorted({x for pair in BUY_SHARE for x in pair})
    shares = [[i for i, x in enumerate(edges[:-1]) if low <= x < high] for low, high in BUY_SHARE]
    ratio = F.lit(None).cast("int")
    for k, top in reversed(list(enumerate(VOLUME_RATIO_BELOW))):
        ratio = F.when(F.col("volume_liquidity_ratio") < top, k).otherwise(ratio)
    # ages have closed ends: every mark is a level, and so is what lies between two
    marks = sorted({x for pair in POOL_AGE for x in pair})
    age = F.lit(None).cast("int")
    for k, mark in enumerate(marks):
        age = F.when(F.col("pool_age_minutes") == mark, 2 * k).when(F.col("pool_age_minutes") > mark, 2 * k + 1).otherwise(age)
    ages = [list(range(2 * marks.index(low), 2 * marks.index(high) + 1)) for low, high in POOL_AGE]
    clean = F.when(F.coalesce("prior_bad", F.lit(0)) == 0, F.least(F.col("prior_n"), F.lit(2))).otherwise(0)
    return [
        Dimension("safe_wallets", cut("safe3") * 3 + cut("safe6"), [safe(*o) for o in SAFE_WALLETS]),
        Dimension("liquidity", _steps("liquidity_usd", LEAST_LIQUIDITY), [list(range(i, 4)) for i in range(4)]),
        Dimension("buy_share", F.when(F.col("buy_share_5m") < edges[-1], _steps("buy_share_5m", edges[:-1])), shares),
        Dimension("volume_ratio", ratio, [list(range(i + 1)) for i in range(4)]),
        Dimension("pool_age", age, ages),
        Dimension("top10", F.when(F.col("top10_percent") < TOP10_BELOW[0], 0).when(F.col("top10_percent") < TOP10_BELOW[1], 1), [[0], [0, 1]]),
        Dimension("creator", F.coalesce(clean, F.lit(0)), [list(range(i, 3)) for i in range(3)]),
    ]


def v4_grid_audit(records: DataFrame, embargo: int) -> Audit:
    """All candidates of the grid over market records, chosen on the first two windows and judged on the last two.

    records: market, creator, t, frozen_t, net_return_pct, cost_pct, rugged, safe3,
    safe6 and what strict_v2 reads. A creator's history counts markets frozen
    strictly before the record. Windows split all records, also those that are not
    strict.
    """
    # history, splits and the cube read them: worked out once
    rows = stored(records.withColumn("value", modeled_return(F.col("net_return_pct"), F.col("rugged"), F.col("cost_pct"))))
    named = rows.where("creator IS NOT NULL")
    past = prior_history(named.select("creator", F.col("market").alias("decision"), "t"), named.select("creator", "frozen_t", F.col("rugged").alias("bad"), "value"), "creator")
    times = split_times(rows, "t", "market")
    rows = rows.join(past.select(F.col("decision").alias("market"), "prior_n", "prior_bad"), "market", "left").fillna(0, ["prior_n", "prior_bad"])
    split = rows.withColumn("window", window_at("t", times, embargo)).where("window IS NOT NULL")
    return cube_audit(split.where(strict_v2()), v4_dimensions(), "value", "rugged", "market", V4_LEAST, V4_LEAST_TOTAL)


def replay_cohorts(rows: DataFrame, cohorts: dict[str, Column], least: int) -> DataFrame:
    """Per cohort the stats of its first row per token, and why it fails (null: it passes)."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in cohorts.items()]))
    stats = window_stats(first_by(rows.withColumn("cohort", F.explode(named)), ["cohort", "token"], ["t", "tie"]), ["cohort"])
    reason = F.when(F.col("n") < least, "too-few").when(F.col("median_") <= 0, "median").when(F.col("ex_best") <= 0, "one-winner").when(F.col("profit_factor") < 1.2, "profit-factor")
    return stats.withColumn("reason", reason)


def shadow_sample(scores: DataFrame, top: float = 0.8) -> DataFrame:
    """Wallets by score with their arm: the best share, and as many of the worst as make up the rest."""
    ranked = scores.withColumn("place", F.percent_rank().over(Window.partitionBy("status").orderBy(F.desc("overall_score"), "wallet")))
    return ranked.withColumn("arm", F.when(F.col("place") < top, "top").otherwise("bottom")).drop("place")


def wallet_persistence(runs: DataFrame, key: str, at: str, good: Column, size: str) -> DataFrame:
    """Per wallet its streak of good runs, the growth of its sample, and a verdict."""
    streak = trailing_runs(runs, key, at, good)
    growth = runs.groupBy(key).agg((F.max_by(size, at) - F.min_by(size, at)).alias("growth"))
    verdict = F.when((F.col("streak") >= 3) & (F.col("growth") > 0), "validated").when(F.col("streak") >= 1, "watch").otherwise("rejected")
    return streak.join(growth, key).withColumn("verdict", verdict)


def decision_seed(pools: DataFrame, flow: DataFrame, decided: DataFrame, now: int, ages: tuple[int, int], cap: int) -> DataFrame:
    """Young pools not decided yet, with what evidence is missing; at most ``cap`` a day, the oldest first."""
    age = F.lit(now) - F.col("created_t")
    rows = pools.where(age.between(*ages)).join(decided.select("pool").distinct(), "pool", "left_anti").join(flow, "pool", "left")
    missing = F.array_compact(F.array(F.when(F.col("liquidity_usd").isNull(), "liquidity"), F.when(F.col("buyers").isNull(), "flow")))
    rows = rows.withColumn("missing", F.array_join(missing, ",")).withColumn("day", F.floor(F.col("created_t") / 86_400))
    place = F.row_number().over(Window.partitionBy("day").orderBy("created_t", "pool"))
    return rows.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place").withColumn("eligible", F.col("missing") == "")


def track_history(obs: DataFrame, keep: int) -> DataFrame:
    """The latest ``keep`` observations per token, numbered back from the last."""
    place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("t"), F.desc("obs_key")))
    return obs.withColumn("back", place).where(F.col("back") <= keep)


def method_signals(tagged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """First observation per token and method, with its token's outcome."""
    return first_by(tagged, ["token", "method"], ["t", "obs_key"]).join(outcomes, "token", "left")


def evidence_funnel(prices: DataFrame, entries: DataFrame, outcomes: DataFrame, horizon: int, delay: int) -> DataFrame:
    """One row: how many pools, candidates, entries, outcomes and wallets reach each step, and how many rows are of low quality.

    prices: pool; entries: entry_key, wallet, token, t, linked, controlled,
    repeat_wallets, slot; outcomes: as assess_fixed_horizon takes them. Only linked
    entries and their outcomes count; an entry is mature once, however many
    canonical outcomes it has.
    """
    linked = F.coalesce(F.col("linked"), F.lit(False))
    judged = assess_fixed_horizon(outcomes.join(entries.where(linked).select("entry_key", "t", "linked"), "entry_key"), horizon, delay)
    fixed = F.col("exit_strategy") == "fixed-horizon"
    mature = fixed & (F.col("status") == "mature")
    parts = [
        prices.agg(F.count_distinct("pool").alias("pools")),
        entries.agg(
            F.count_distinct(F.when(linked & F.col("controlled"), F.col("token"))).alias("eligible"), F.count_if(linked).alias("entries"), F.count_if(~linked).alias("exploratory"),
            F.count_distinct(F.when(linked & (F.col("repeat_wallets") >= 2), F.col("wallet"))).alias("repeating_wallets"), F.count_if(linked & (F.col("slot") <= 0)).alias("missing_slots"),
        ),
        judged.agg(
            F.count_distinct(F.when(F.col("canonical"), F.col("entry_key"))).alias("mature"), F.count_if(mature & ~F.col("canonical")).alias("invalid"), F.count_if(mature & (F.col("reason") == "terminal-rug-before-horizon")).alias("early_rugs"),
            *[F.count_if(fixed & (F.col("status") == c)).alias(c) for c in ("provisional", "unresolved")],
        ),
    ]
    row, *others = [p.withColumn("_row", F.lit(1)) for p in parts]
    for p in others:
        row = row.join(p, "_row")
    return row.drop("_row")
