"""Selection rules judged in time order: splits, grids, causal histories, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import first_by, range_join, running, wilson_upper

WINDOWS = ("train", "validation", "holdout1", "holdout2")
PROFIT_FACTOR_TOP = 999.0


def ranked(rows: DataFrame, at: str, tie: str, buckets: int = 256, keys: Sequence[str] = ()) -> DataFrame:
    """rows plus place (0-based over all rows of equal keys in order of ``at``), without a single-task window.

    Rows are counted per bucket of ``at``; only the buckets' counts (at most
    ``buckets`` rows of a key) pass through one window, and each bucket is numbered apart.
    """
    keys = list(keys)
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    b = rows.withColumn("_b", F.floor((F.col(at) - F.lit(low or 0)) / width))
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, "_b", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(at, tie)) - 1
    offsets = offsets if keys else F.broadcast(offsets)
    return b.withColumn("_place", place).join(offsets, [*keys, "_b"]).withColumn("place", F.col("_place") + F.col("_before")).drop("_b", "_place", "_before")


def split_times(rows: DataFrame, at: str, tie: str, shares: Sequence[float] = (0.4, 0.6, 0.8)) -> list[int]:
    """The times at the shares of the rows in order."""
    placed = ranked(rows, at, tie)
    n = rows.count()
    marks = [int(n * s) for s in shares]
    cuts = {r.place: r[at] for r in placed.where(F.col("place").isin(marks)).select("place", at).collect()}
    return [cuts[m] for m in marks if m in cuts]


def window_at(at: str, times: Sequence[int], embargo: int) -> Column:
    """The window of a time; null within the embargo of a split."""
    window, clear = F.lit(WINDOWS[0]), F.lit(True)
    for name, t in zip(WINDOWS[1:], times, strict=False):
        window = F.when(F.col(at) >= t, name).otherwise(window)
        clear = clear & (F.abs(F.col(at) - t) >= embargo)
    return F.when(clear, window)


def walk_forward_split(rows: DataFrame, at: str, tie: str, embargo: int, shares: Sequence[float] = (0.4, 0.6, 0.8)) -> DataFrame:
    """rows with their window; times at the shares of the rows split them, and rows within the embargo of a split are dropped."""
    return rows.withColumn("window", window_at(at, split_times(rows, at, tie, shares), embargo)).where("window IS NOT NULL")


def window_stats(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, median, hit rate, profit factor, worst and mean without the best, per keys."""
    v, n = F.col(value), F.count(F.lit(1))
    gain, loss = F.sum(F.greatest(v, F.lit(0.0))), -F.sum(F.least(v, F.lit(0.0)))
    return rows.groupBy(*keys).agg(
        n.alias("n"), F.avg(v).alias("mean_"), F.percentile(v, F.lit(0.5)).alias("median_"), F.avg((v > 0).cast("double")).alias("hit_rate"),
        F.when(loss > 0, gain / loss).when(gain > 0, F.lit(PROFIT_FACTOR_TOP)).otherwise(F.lit(0.0)).alias("profit_factor"), F.min(v).alias("worst"),
        F.when(n > 1, (F.sum(v) - F.max(v)) / (n - 1)).otherwise(F.lit(0.0)).alias("ex_best"),
    )


def evaluate_candidates(rows: DataFrame, grid: DataFrame, condition: Column, least: dict[str, int]) -> DataFrame:
    """Stats of each candidate on each window's rows that meet its condition; passed tells a large enough and good enough sample.

    The grid holds parameters, a bounded table, and is broadcast; rows stay where they are and only partial sums shuffle.
    """
    hits = rows.join(F.broadcast(grid), condition)
    out = window_stats(hits, ["candidate", "window"])
    need = F.lit(max(least.values()))
    for k, n in least.items():
        need = F.when(F.col("window") == k, n).otherwise(need)
    good = (F.col("n") >= need) & (F.col("median_") > 0) & (F.col("ex_best") > 0) & (F.col("profit_factor") >= 1.2)
    return out.withColumn("passed", good).withColumn("score", F.col("median_") + F.col("ex_best") + F.least(F.col("profit_factor"), F.lit(5.0)) * 10)


def lock_best(evaluated: DataFrame) -> DataFrame:
    """The one candidate best on validation, then on training; later windows play no part."""
    pick = lambda w: evaluated.where(F.col("window") == w).select("candidate", F.col("passed").alias(f"{w}_passed"), F.col("score").alias(f"{w}_score"), F.col("n").alias(f"{w}_n"))
    both = pick("train").join(pick("validation"), "candidate")
    return both.orderBy(F.desc("validation_passed"), F.desc("validation_score"), F.desc("train_passed"), F.desc("train_score"), F.desc("validation_n"), "candidate").limit(1)


def search_decision(evaluated: DataFrame) -> DataFrame:
    """The locked candidate with whether it holds on both holdouts."""
    locked = lock_best(evaluated)
    held = evaluated.where(F.col("window").isin("holdout1", "holdout2")).groupBy("candidate").agg(F.count_if("passed").alias("holdouts_passed"), F.sum("n").alias("holdout_n"))
    out = locked.join(held, "candidate", "left").fillna(0)
    return out.withColumn("verdict", F.when(F.col("validation_passed") & (F.col("holdouts_passed") == 2), "accepted").when(F.col("validation_passed"), "failed-holdout").otherwise("rejected"))


def modeled_return(net: Column, rugged: Column, cost: Column, full_cost: float = 7.1) -> Column:
    return F.when(rugged, F.lit(-100.0)).otherwise(net - F.greatest(F.lit(0.0), F.lit(full_cost) - cost))


def prior_history(decisions: DataFrame, completions: DataFrame, key: str) -> DataFrame:
    """Per decision (key, decision, t) how many completions (key, frozen_t, bad, value) lie strictly before it, how many bad, and their mean."""
    none = F.lit(None)
    events = decisions.select(key, F.col("t"), F.lit(0).alias("kind"), F.col("decision"), none.cast("int").alias("bad"), none.cast("double").alias("value")).unionByName(
        completions.select(key, F.col("frozen_t").alias("t"), F.lit(1).alias("kind"), none.cast("long").alias("decision"), F.col("bad").cast("int").alias("bad"), F.col("value").cast("double").alias("value"))
    )
    w = Window.partitionBy(key).orderBy("t", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = events.withColumn("prior_n", F.count("bad").over(w)).withColumn("prior_bad", F.coalesce(F.sum("bad").over(w), F.lit(0))).withColumn("prior_mean", F.avg("value").over(w))
    return out.where("kind = 0").select(key, "decision", "t", "prior_n", "prior_bad", "prior_mean")


def causal_supporters(markets: DataFrame, entries: DataFrame, completions: DataFrame, span: int) -> DataFrame:
    """Per market its wallets of the span before, each judged only by outcomes frozen before the market's time."""
    near = range_join(markets.select("market", "pool", "t"), entries.select("wallet", "pool", F.col("t").alias("entry_t")), ["pool"], F.col("t") - span, F.col("t"), "entry_t", span + 1)
    who = near.select("market", "t", "wallet").distinct()
    past = prior_history(who.select("wallet", F.col("market").alias("decision"), "t"), completions, "wallet")
    return markets.select("market").join(past.groupBy(F.col("decision").alias("market")).agg(F.count(F.lit(1)).alias("supporters"), F.count_if((F.col("prior_n") >= 3) & (F.col("prior_bad") == 0)).alias("safe3"), F.sum("prior_n").alias("history")), "market", "left").fillna(0)


def delay_sensitivity(signals: DataFrame, obs: DataFrame, delays: Sequence[int], within: int, exit_at: int) -> DataFrame:
    """Per delay the coverage and return stats of entering at the first price from t + delay, and leaving at the first from t + exit_at."""
    rows = signals.withColumn("delay", F.explode(F.array(*[F.lit(x) for x in delays])))
    o = obs.select("token", F.col("t").alias("obs_t"), "obs_key", "price_usd")
    at = F.struct("obs_t", "obs_key", "price_usd")
    bought = range_join(rows, o, ["token"], F.col("t") + F.col("delay"), F.col("t") + F.col("delay") + within, "obs_t", within + 1).groupBy("signal_key", "delay").agg(F.min(at)["price_usd"].alias("buy"))
    sold = range_join(signals, o, ["token"], F.col("t") + exit_at, F.col("t") + exit_at + within, "obs_t", within + 1).groupBy("signal_key").agg(F.min(at)["price_usd"].alias("sell"))
    ret = rows.select("signal_key", "delay").join(bought, ["signal_key", "delay"], "left").join(sold, "signal_key", "left").withColumn("value", F.when(F.col("buy") > 0, (F.col("sell") / F.col("buy") - 1) * 100))
    stats = window_stats(ret.where("value IS NOT NULL"), ["delay"])
    return ret.groupBy("delay").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("coverage")).join(stats, "delay", "left")


def market_supporters(markets: DataFrame, entries: DataFrame, span: int) -> DataFrame:
    """Per market the ordered list of wallets that entered its pool in the span before."""
    near = range_join(markets.select("market", "pool", "t"), entries.select("wallet", "pool", F.col("t").alias("entry_t")), ["pool"], F.col("t") - span, F.col("t"), "entry_t", span + 1)
    return near.groupBy("market").agg(F.array_join(F.sort_array(F.collect_set("wallet")), ",").alias("wallets"), F.countDistinct("wallet").alias("n"))


def context_risk(decisions: DataFrame, completions: DataFrame, context: str, weight: float = 10.0) -> DataFrame:
    """Per decision the shrunk past risk of its context, its upper bound, and the past mean; only completions before it count."""
    past = prior_history(decisions, completions, context)
    p = (F.col("prior_bad") + weight * 0.5) / (F.col("prior_n") + weight)
    return past.withColumn("risk", p).withColumn("risk_upper", wilson_upper(p, F.col("prior_n") + weight))


def trade_metrics(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Win rate, profit factor, tails, hold time and exit shares of closed trades."""
    v, n = F.col("return_pct"), F.count(F.lit(1))
    gain, loss = F.sum(F.greatest(v, F.lit(0.0))), -F.sum(F.least(v, F.lit(0.0)))
    return trades.groupBy(*keys).agg(
        n.alias("n"), F.avg((v > 0).cast("double")).alias("win_rate"), F.when(loss > 0, gain / loss).when(gain > 0, F.lit(PROFIT_FACTOR_TOP)).otherwise(F.lit(0.0)).alias("profit_factor"),
        F.avg(v).alias("mean_"), F.percentile(v, F.lit(0.5)).alias("median_"), F.percentile(v, F.lit(0.05)).alias("tail"), F.avg("hold_minutes").alias("hold"), F.avg((F.col("reason") == "rug").cast("double")).alias("rug_rate"),
    )


#: The confidence from which a signal belongs to a bucket.
CONFIDENCE = (("0_49", None), ("50_69", 50), ("70_84", 70), ("85_100", 85))


def replay_metrics(signals: DataFrame, trades: DataFrame) -> DataFrame:
    """One row over all signals (signal_key, confidence) and their closed trades (signal_key, pnl, return_pct, hold_minutes, reason).

    tail is the return at place floor(n / 20) in ascending order. Signals without a
    trade found no liquid entry and count as liquidity failures. precision is the
    share of a bucket's signals whose trade won. Rates of nothing are 0; a null
    confidence belongs to the last bucket.
    """
    bucket = F.lit("85_100")
    for (name, _), (_, upper) in reversed(list(zip(CONFIDENCE, CONFIDENCE[1:], strict=False))):
        bucket = F.when(F.col("confidence") < upper, name).otherwise(bucket)
    rows = signals.select("signal_key", bucket.alias("bucket")).join(trades.select("signal_key", "pnl", "return_pct", "hold_minutes", "reason"), "signal_key", "left")
    won, lost, closed = F.col("pnl") > 0, F.col("pnl") <= 0, F.col("pnl").isNotNull()
    n, signalled = F.count("pnl"), F.count(F.lit(1))
    gain, loss = F.coalesce(F.sum(F.when(won, F.col("pnl"))), F.lit(0.0)), F.coalesce(-F.sum(F.when(lost, F.col("pnl"))), F.lit(0.0))
    some, none = F.greatest(n, F.lit(1)), lambda x: F.coalesce(x, F.lit(0.0))
    precision = [
        (F.count_if(won & (F.col("bucket") == b)) / F.greatest(F.count_if(F.col("bucket") == b), F.lit(1))).alias(f"precision_{b}") for b, _ in CONFIDENCE
    ]
    out = rows.agg(
        n.alias("trades"), signalled.alias("signals"), (F.count_if(won) / some).alias("win_rate"),
        F.when(loss > 0, gain / loss).when(gain > 0, F.lit(PROFIT_FACTOR_TOP)).otherwise(F.lit(0.0)).alias("profit_factor"),
        none(F.avg("return_pct")).alias("mean_"), none(F.percentile("return_pct", F.lit(0.5))).alias("median_"), none(F.avg("hold_minutes")).alias("hold"),
        (F.count_if(closed & (F.col("reason") == "rug")) / some).alias("rug_rate"),
        ((F.count_if(~closed) + F.count_if(F.col("reason") == "liquidity_failure")) / F.greatest(signalled, F.lit(1))).alias("liquidity_failure_rate"), *precision,
    )
    closed_trades = rows.where("pnl IS NOT NULL")
    place = int(closed_trades.count() * 0.05)
    tail = ranked(closed_trades, "return_pct", "signal_key").where(F.col("place") == place).agg(none(F.max("return_pct")).alias("tail"))
    return out.crossJoin(F.broadcast(tail))


def trailing_runs(runs: DataFrame, key: str, at: str, good: Column) -> DataFrame:
    """Per key the number of consecutive good runs up to the latest, and the time they span."""
    back = running([key], [F.desc(at)])
    rows = runs.withColumn("_bad", F.sum((~good).cast("int")).over(back)).where("_bad = 0")
    return runs.select(key).distinct().join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("streak"), (F.max(at) - F.min(at)).alias("span")), key, "left").fillna(0)


def rule_candidates(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Stats of the first row per token of every rule; a row counts for each rule it meets."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return window_stats(first_by(rows.withColumn("rule", F.explode(named)), ["rule", "token"], ["t", "tie"]), ["rule"])


def exit_grid(path: DataFrame, key: str, grid: Sequence[tuple[str, float, float, int]], cost_pct: float) -> DataFrame:
    """Stats per named barrier exit of the grid over all return paths, net of cost, and the share of each reason; one pass over the paths."""
    from tidemark.operators.outcomes import barrier_exit

    out = None
    for name, take, stop, timeout in grid:
        one = barrier_exit(path, key, take, stop, timeout).withColumn("exit", F.lit(name)).withColumn("value", F.col("return_pct") - cost_pct)
        out = one if out is None else out.unionByName(one)
    shares = [F.avg((F.col("reason") == r).cast("double")).alias(f"share_{r.replace('-', '_')}") for r in ("take-profit", "stop-loss", "timeout", "provisional")]
    return window_stats(out, ["exit"]).join(out.groupBy("exit").agg(*shares), "exit")


def data_quality(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("token").alias("tokens"), F.count_if(F.col("price_usd") <= 0).alias("unpriced"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def decision_digest(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Digest per key over its rows' digests in order, the same for any order of input."""
    one = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(one)), ""), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def goal_audit(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unique outcomes in time order: the slices from the 10th to the 20th and from the 20th on must both gain."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("t", "tie")) - 1
    part = F.when(F.col("place") >= 20, "late").when(F.col("place") >= 10, "middle")
    stats = window_stats(rows.withColumn("place", place).withColumn("part", part).where("part IS NOT NULL"), [*keys, "part"])
    good = (F.col("mean_") > 0) & (F.col("median_") >= 0)
    return stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), F.bool_and(good).alias("ok"), F.sum("n").alias("n"))
