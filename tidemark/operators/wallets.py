"""Balance changes as trades, and research views over wallets and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import clamp, first_by, js_round


def balance_deltas(balances: DataFrame, signers: DataFrame, skip_owners: DataFrame) -> DataFrame:
    """(signature, owner, mint, delta) of verified signers: sums of balances after less before, without infrastructure (skip_owners, a short list that is broadcast)."""
    sign = F.when(F.col("phase") == "post", F.col("amount")).otherwise(-F.col("amount"))
    # one exchange for the sums and for the signers they meet
    rows = balances.join(F.broadcast(skip_owners.distinct()), "owner", "left_anti").repartition("signature", "owner")
    sums = rows.groupBy("signature", "owner", "mint").agg(F.sum(sign).alias("delta")).where("delta <> 0")
    return sums.join(signers.distinct(), ["signature", "owner"], "left_semi")


def balance_trades(deltas: DataFrame, quote_mints: Sequence[str]) -> DataFrame:
    """One trade per signature, owner and base mint, its side by sign, its quote leg the sum over quote mints."""
    quote = F.col("mint").isin(*quote_mints)
    legs = deltas.where(quote).groupBy("signature", "owner").agg(F.sum("delta").alias("quote_delta"))
    base = deltas.where(~quote).join(legs, ["signature", "owner"], "left")
    return base.select("signature", "owner", "mint", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").alias("base_amount"), F.abs(F.coalesce("quote_delta", F.lit(0.0))).alias("quote_amount"))


def swap_candidates(swaps: DataFrame) -> DataFrame:
    """Native in: each output mint was bought; native out: each input mint was sold."""
    bought = swaps.where("native_in > 0").select("signature", F.explode("outputs").alias("o"), F.col("native_in").alias("native"), F.lit("buy").alias("side"))
    sold = swaps.where("native_out > 0").select("signature", F.explode("inputs").alias("o"), F.col("native_out").alias("native"), F.lit("sell").alias("side"))
    both = bought.unionByName(sold).groupBy("signature", F.col("o.mint").alias("mint"), "side").agg(F.sum("o.amount").alias("amount"), F.max("native").alias("native"))
    return both.withColumn("price_native", F.try_divide("native", "amount")).withColumn("confidence", F.lit(0.9))


def transfer_candidates(transfers: DataFrame) -> DataFrame:
    """Where a signature moves exactly one mint in (or out) of its payer, that mint's trade, of low confidence."""
    moved = transfers.withColumn("side", F.when(F.col("receiver") == F.col("payer"), "buy").when(F.col("sender") == F.col("payer"), "sell")).where("side IS NOT NULL")
    sums = moved.groupBy("signature", "side", "mint").agg(F.sum("amount").alias("amount"))
    lone = sums.groupBy("signature", "side").agg(F.count(F.lit(1)).alias("mints"), F.min("mint").alias("mint"), F.min("amount").alias("amount")).where("mints = 1")
    return lone.select("signature", "side", "mint", "amount", F.lit(0.55).alias("confidence"))


def entry_gate_reason(gates: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first gate that a row fails, in order; null if it passes all."""
    out = F.lit(None).cast("string")
    for name, passed in reversed(gates):
        out = F.when(~F.coalesce(passed, F.lit(False)), name).otherwise(out)
    return out


def wallet_feature_score(f: DataFrame) -> DataFrame:
    """score and category of wallet features: weighted parts less suspicion, decayed."""
    c = F.col
    suspicion = clamp(c("cluster") * 32 + c("deployer") * 45 + c("sniper") * 0.32 + c("rugged") * 1.7)
    behavior = clamp(c("discipline") * 0.35 + c("avoidance") * 25 + c("copyability") * 0.4)
    raw = (
        clamp(c("winners") / F.greatest(c("early"), F.lit(1)) * 100) * 0.2 + clamp(c("median_roi") * 0.55 + c("mean_roi") * 0.12) * 0.2 + clamp(c("win_rate") * 100) * 0.14
        + clamp(c("profit_factor") * 24) * 0.16 + behavior * 0.24 - suspicion * 0.3
    )
    out = f.withColumn("suspicion", suspicion).withColumn("score", js_round(clamp(raw * c("decay"))))
    category = (
        F.when(c("cluster") > 0.82, "bundler_cluster").when(c("deployer") > 0.25, "insider_dev_linked").when((c("sniper") > 82) & (c("copyability") < 35), "sniper_bot")
        .when((c("avoidance") < 0.45) | (c("rugged") > 20), "high_risk_wallet").when((c("score") >= 78) & (c("suspicion") < 32), "alpha_wallet")
        .when((c("score") >= 64) & (c("copyability") >= 55), "copyable_smart_wallet").when((c("score") >= 50) & (c("hold") < 25), "market_maker").otherwise("noise_wallet")
    )
    return out.withColumn("category", category)


def token_features(tokens: DataFrame, pools: DataFrame, wallets: DataFrame) -> DataFrame:
    """tokens with their best pool and the number and mean score of the scored wallets that traded them."""
    best = first_by(pools, ["token"], [F.desc("liquidity_usd"), "pool"]).select("token", "pool", "liquidity_usd")
    smart = wallets.groupBy("token").agg(F.countDistinct("wallet").alias("smart_wallets"), F.avg("score").alias("avg_score"))
    return tokens.join(best, "token", "left").join(smart, "token", "left").fillna(0, ["smart_wallets", "avg_score", "liquidity_usd"])


def qualified_pools(pools: DataFrame, risk: DataFrame, gate: Column, sent: DataFrame, limit: int) -> DataFrame:
    """Pools with their token's latest risk that pass the gate, the most liquid per token, not sent before."""
    latest = first_by(risk, ["token"], [F.desc("calculated_t")]).drop("calculated_t")
    good = pools.join(latest, "token").where(gate)
    return first_by(good, ["token"], [F.desc("liquidity_usd"), "pool"]).join(sent.select("token").distinct(), "token", "left_anti").orderBy(F.desc("liquidity_usd"), "token").limit(limit)


def token_durability(obs: DataFrame) -> DataFrame:
    """Per token the latest, greatest and least return on its first price, minutes between first and last, and a score within +-100.

    obs: token, t, obs_key, price_usd, liquidity_usd, buys5m, sells5m, wallet_events,
    cross_wallets, active_wallets; all but the prices count as last seen.
    """
    at = F.struct("t", "obs_key")
    names = ("price_usd", "liquidity_usd", "buys5m", "sells5m", "wallet_events", "cross_wallets", "active_wallets", "t")
    r = obs.where("price_usd > 0").groupBy("token").agg(F.min_by(F.struct("price_usd", "t"), at).alias("first"), F.max_by(F.struct(*names), at).alias("last"), F.max("price_usd").alias("high"), F.min("price_usd").alias("low"))
    pct = lambda c: (F.col(c) / F.col("first.price_usd") - 1) * 100
    last = lambda c: F.col(f"last.{c}")
    out = r.select("token", pct("last.price_usd").alias("last_pct"), pct("high").alias("max_pct"), pct("low").alias("min_pct"), ((last("t") - F.col("first.t")) / 60).alias("age_minutes"), "last")
    seen = last("wallet_events") * 1.4 + last("cross_wallets") * 18 + last("active_wallets") * 22
    share = last("buys5m") / F.greatest(last("buys5m") + last("sells5m"), F.lit(1))
    marks = F.when(share >= 0.55, 8).otherwise(-8) - F.when(last("liquidity_usd") < 10_000, 15).otherwise(0) - F.when(F.col("age_minutes") < 3, 10).otherwise(0)
    score = F.col("last_pct") * 0.55 + F.col("max_pct") * 0.18 + F.least(last("liquidity_usd") / 1000, F.lit(35.0)) + seen + marks
    return out.withColumn("score", clamp(score, -100.0, 100.0)).drop("last")


#: Fixed names of labels.
EARLY_LABELS = ("cross-token active degen", "very early buyer", "high-traction participant", "fast seller / possible bot", "single-token early buyer")
HISTORY_LABELS = ("active pump degen wallet", "multi-token recent buyer", "net recent accumulator", "fast churn seller", "limited recent history")


def _labels(conditions: Sequence[Column], names: Sequence[str]) -> Column:
    """The names whose condition holds, joined by commas; the last name if none does."""
    held = F.array_compact(F.array(*[F.when(c, n) for c, n in zip(conditions, names, strict=False)]))
    return F.when(F.size(held) == 0, names[-1]).otherwise(F.array_join(held, ","))


def early_wallets(events: DataFrame, most_rank: int = 18) -> DataFrame:
    """Per wallet with early buys: tokens touched, early buys, sells, mean rank and mean candidate score of its buys, pressure score, labels.

    events: wallet, token, side, rank in the token, candidate_score of the token
    (null: none). A buy is early up to ``most_rank``.
    """
    buy = F.col("side") == "buy"
    out = events.groupBy("wallet").agg(
        F.countDistinct("token").alias("tokens"), F.count_if(buy & (F.col("rank") <= most_rank)).alias("early"), F.count_if(F.col("side") == "sell").alias("sells"),
        F.coalesce(F.avg(F.when(buy, F.col("rank"))), F.lit(0.0)).alias("avg_rank"), F.coalesce(F.avg(F.when(buy, F.coalesce("candidate_score", F.lit(0.0)))), F.lit(0.0)).alias("avg_score"),
    ).where("early > 0")
    pressure = clamp(F.col("early") * 11 + F.col("tokens") * 18 + F.col("avg_score") * 0.55 - F.col("sells") * 5 - F.col("avg_rank") * 0.4)
    held = ((F.col("tokens") >= 2) & (F.col("early") >= 2), F.col("avg_rank") <= 8, F.col("avg_score") >= 75, F.col("sells") > F.col("early"))
    return out.withColumn("pressure", pressure).withColumn("labels", _labels(held, EARLY_LABELS))


def wallet_history(events: DataFrame, suffix: str) -> DataFrame:
    """Per wallet mints bought, mints with a suffix, events by side, and a clamped score."""
    buy = F.col("side") == "buy"
    out = events.groupBy("wallet").agg(F.countDistinct(F.when(buy, F.col("token"))).alias("mints"), F.countDistinct(F.when(buy & F.col("token").endswith(suffix), F.col("token"))).alias("suffixed"), F.count_if(buy).alias("buys"), F.count_if(~buy).alias("sells"))
    return out.withColumn("score", clamp((F.col("mints") * 16 + F.col("suffixed") * 18 + F.col("buys") * 3 - F.col("sells") * 2).cast("double")))


def history_labels(history: DataFrame) -> DataFrame:
    held = (F.col("suffixed") >= 3, F.col("mints") >= 4, (F.col("buys") >= 5) & (F.col("sells") <= F.col("buys")), F.col("sells") > F.col("buys"))
    return history.withColumn("labels", _labels(held, HISTORY_LABELS))


def merge_wallet_state(old: DataFrame, new: DataFrame, now: int, keep_s: int) -> DataFrame:
    """Events of both, one per (wallet, token, signature, side), as aggregates of the wallets seen lately."""
    rows = first_by(old.unionByName(new), ["wallet", "token", "signature", "side"], ["t"])
    out = rows.groupBy("wallet").agg(F.countDistinct("token").alias("tokens"), F.count(F.lit(1)).alias("events"), F.max("t").alias("last_t"))
    return out.where(F.col("last_t") >= now - keep_s)


def method_tags(events: DataFrame, wallets: DataFrame, least: int) -> DataFrame:
    """Per token the tags of its wallets and a tag for many events."""
    tags = events.join(wallets.select("wallet", F.explode("tags").alias("tag")), "wallet").select("token", "tag")
    busy = events.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("token", F.lit("busy").alias("tag"))
    return tags.unionByName(busy).groupBy("token").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))


def watch_mode(validated: dict[str, Column], watched: Sequence[Column]) -> dict[str, Column]:
    """Mode and status of a watch.

    validated: flags method, rule, exit and replay, which together make a system
    candidate, and wallet; watched: flags of methods, rules and exits under watch.
    """
    system = validated["method"] & validated["rule"] & validated["exit"] & validated["replay"]
    lone = validated["wallet"] & ~system
    watch = lone
    for w in watched:
        watch = watch | w
    mode = F.when(system, "paper-validate candidate").when(watch, "paper-watch").otherwise("observe-only")
    status = F.when(system, "validated paper system candidate").when(lone, "wallet candidate emerging").otherwise("collecting evidence")
    return {"mode": mode, "status": status, "system_candidate": system, "wallet_only": lone, "system_watch": watch}


#: What a label adds to the score of a watched wallet.
LABEL_POINTS = {"cross-token active degen": 12, "active pump degen wallet": 8, "multi-token recent buyer": 8, "net recent accumulator": 6, "fast churn seller": -30, "limited recent history": -12}


def watch_wallet_score(outcomes: DataFrame, wallets: DataFrame) -> DataFrame:
    """wallets with counts and means of their outcomes, a capped score and a confidence (high, medium, early).

    outcomes: wallet, status (mature, provisional, unresolved), return_pct,
    age_minutes; wallets: wallet, labels (joined by commas), mints, suffixed,
    history_score. Only mature outcomes count for the score. Wallets without
    outcomes stay; their means are 0.
    """
    mature, open_ = F.col("status") == "mature", F.col("status") == "provisional"
    ret = F.when(mature, F.col("return_pct"))
    seen = outcomes.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(mature).alias("matured"), F.count_if(open_).alias("provisional"), F.count_if(F.col("status") == "unresolved").alias("unresolved"),
        F.avg(ret).alias("avg_pct"), F.avg(F.when(open_, F.col("return_pct"))).alias("open_pct"), F.greatest(F.max(ret), F.lit(0.0)).alias("best_pct"), F.least(F.min(ret), F.lit(0.0)).alias("worst_pct"),
        F.avg((ret > 0).cast("double")).alias("hit_rate"), F.greatest(F.max("age_minutes"), F.lit(0)).cast("double").alias("oldest_minutes"),
    )
    counts, means = ["signals", "matured", "provisional", "unresolved"], ["avg_pct", "open_pct", "best_pct", "worst_pct", "hit_rate", "oldest_minutes"]
    out = wallets.join(seen, "wallet", "left").fillna(0, counts).fillna(0.0, means)
    n, mean, hit, worst = (F.col(c) for c in ("matured", "avg_pct", "hit_rate", "worst_pct"))
    has = lambda label: F.array_contains(F.split(F.coalesce("labels", F.lit("")), ","), label)
    points = sum((F.when(has(label), x).otherwise(0) for label, x in LABEL_POINTS.items()), F.lit(0))
    results = clamp(mean * 0.8 + F.col("best_pct") * 0.15 + worst * 0.3 + hit * 25, -60.0, 50.0)
    known = lambda c: F.coalesce(F.col(c), F.lit(0))
    raw = n * 16 + known("suffixed") * 6 + known("mints") * 4 + known("history_score") * 0.12 + points + results
    cap = F.least(
        F.when(n == 0, 25).when(n < 2, 72).otherwise(100), F.when(mean <= 0, 55).otherwise(100), F.when((n >= 3) & (hit < 0.5), 60).otherwise(100),
        F.when(worst < -50, 50).otherwise(100), F.when(has("fast churn seller"), 60).otherwise(100),
    )
    confidence = F.when((n >= 4) & (mean >= 5) & (hit >= 0.6) & (worst >= -35), "high").when((n >= 3) & (mean > 0) & (hit >= 0.5) & (worst >= -50), "medium").otherwise("early")
    return out.withColumns({"score": F.greatest(F.lit(0.0), F.least(raw, cap.cast("double"))), "confidence": confidence})


def watch_wallet_summary(scored: DataFrame) -> DataFrame:
    """One row: wallets, outcomes by status, wallets with some, three and four mature outcomes, and the most of one wallet."""
    n = F.col("matured")
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matured", "provisional", "unresolved")]
    return scored.agg(F.count(F.lit(1)).alias("wallets"), *total, F.count_if(n > 0).alias("with_one"), F.count_if(n >= 3).alias("with_three"), F.count_if(n >= 4).alias("with_four"), F.coalesce(F.max(n), F.lit(0)).alias("most"))


def near_wallets(scored: DataFrame) -> DataFrame:
    """Wallets that are no candidates (column verdict) and have two mature outcomes, two entries or a provisional one."""
    return scored.where((F.col("verdict") != "candidate") & ((F.col("matured") >= 2) | (F.col("signals") >= 2) | (F.col("provisional") > 0)))


def historical_market_obs(candidates: DataFrame, buys: DataFrame, native_usd: float, version: str) -> DataFrame:
    """Priced candidates as observations, with the pool and trader of the first purchase of that mint in their signature.

    candidates: candidate_key, signature, mint, side, amount, native, confidence,
    source, payer; buys: signature, mint, pool, trader, place. Candidates without
    a positive price or a side are left out. A match lifts the confidence of
    transfer-derived ones to 0.75 at least; without one the payer is the trader.
    """
    first = first_by(buys, ["signature", "mint"], ["place"]).select("signature", "mint", F.struct("pool", "trader").alias("first_buy"))
    return market_obs(_priced(candidates).join(first, ["signature", "mint"], "left"), native_usd, version)


def _priced(candidates: DataFrame) -> DataFrame:
    return candidates.where((F.col("amount") > 0) & (F.col("native") > 0) & F.col("side").isin("buy", "sell"))


def market_obs(candidates: DataFrame, native_usd: float, version: str) -> DataFrame:
    """As historical_market_obs, of candidates with the first purchase beside them: first_buy (pool, trader), null if there is none."""
    sure = clamp(F.col("confidence").cast("double"), 0.0, 1.0)
    price = F.col("native") / F.col("amount")
    return _priced(candidates).select(
        F.sha2(F.concat_ws(":", F.lit("history-market"), F.coalesce("candidate_key", F.lit("")), F.coalesce("first_buy.pool", F.lit("unresolved")), F.lit(version)), 256).alias("obs_id"),
        "signature", "mint", "first_buy.pool", F.coalesce("first_buy.trader", "payer").alias("trader"), "side", F.col("amount").alias("base_amount"), F.col("native").alias("quote_amount"), price.alias("price_quote"),
        (price * native_usd).alias("price_usd"), (F.col("native") * native_usd).alias("volume_usd"), "source",
        F.when(F.col("first_buy").isNotNull() & (F.col("source") == "transfer-derived"), F.greatest(sure, F.lit(0.75))).otherwise(sure).alias("confidence"),
    )


def traded_candidates(legs: DataFrame, native_in: Column, native_out: Column) -> DataFrame:
    """Candidates of swaps and transfers with payer and first_buy, all from one exchange by signature.

    legs: signature, mint, side, amount, value, wallet, pool, place. A signature's
    legs of a mint and side are one row of sums. The native value of a swap is
    native_in for what was bought, native_out for what was sold, both over
    ``value`` (the signature's whole value); a side that moves one mint alone is a
    transfer of that side's own value. first_buy: pool and trader of the purchase of
    least place of the mint in the signature.
    """
    own, of_side, of_mint = Window.partitionBy("signature"), Window.partitionBy("signature", "side"), Window.partitionBy("signature", "mint")
    buy = F.when(F.col("side") == "buy", F.struct("place", "pool", F.col("wallet").alias("trader")))
    sums = legs.repartition("signature").groupBy("signature", "side", "mint").agg(F.sum("amount").alias("amount"), F.sum("value").alias("side_value"), F.min("wallet").alias("payer"), F.min(buy).alias("first"))
    # in this order the first two windows share a sort
    sums = sums.withColumn("mints", F.count(F.lit(1)).over(of_side)).withColumn("value", F.sum("side_value").over(own)).withColumn("payer", F.min("payer").over(own)).withColumn("first", F.min("first").over(of_mint))
    native = F.when(F.col("side") == "buy", native_in).when(F.col("side") == "sell", native_out)
    kinds = F.array(
        F.when(native > 0, F.struct(F.lit("swap-event").alias("source"), native.alias("native"), F.lit(0.9).alias("confidence"))),
        F.when(F.col("mints") == 1, F.struct(F.lit("transfer-derived").alias("source"), F.col("side_value").alias("native"), F.lit(0.55).alias("confidence"))),
    )
    first = F.when(F.col("first").isNotNull(), F.struct("first.pool", "first.trader")).alias("first_buy")
    rows = sums.select("signature", "side", "mint", "amount", "payer", first, F.explode(F.array_compact(kinds)).alias("kind"))
    return rows.select("signature", "side", "mint", "amount", "payer", "first_buy", "kind.*")


#: Kinds of verdicts that a decision combines.
KINDS = ("method", "rule", "exit", "wallet")
KEYS = ("raw_candidate", "raw_watch", "validated", "watch", "leading")


def decision_status(runs: DataFrame, methods: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per run the checks of its best method, the keys of all verdicts as <kind>_<key>, mode, status and verdict.

    runs: run, n_runs, quality_tokens, replay_passed; methods: run, place (1: the
    best), method, tokens, median_pct, avg_pct, ex_best_pct, best_share, hit_rate,
    drawdown_pct, worst_pct; decisions: run, kind, and a key or null for each of
    KEYS. Runs without methods or decisions fail their checks. The verdict is
    system-candidate, wallet-only, keep-watching or stand-down. A watched wallet alone is no watch of
    the system.
    """
    best = first_by(methods, ["run"], ["place", "method"]).drop("place")
    picked = [F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in KINDS for c in KEYS]
    out = runs.join(best, "run", "left").join(decisions.groupBy("run").agg(*picked), "run", "left")
    known = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    there = lambda c: F.col(c).isNotNull()
    traction, quality = F.coalesce(F.col("method") == "high-traction", F.lit(False)), F.col("quality_tokens") > 0
    least = F.when(traction, 8).otherwise(3)
    robust = (known("median_pct", -100.0) >= 2) & (known("ex_best_pct", -100.0) >= 2) & (known("best_share", 1.0) <= 0.65)
    checks = {
        "minimum_signals": least, "enough_runs": F.col("n_runs") >= 6, "enough_tokens": known("tokens", 0) >= least, "robust_positive": robust,
        "positive_enough": (known("avg_pct", 0.0) >= 5) & (known("hit_rate", 0.0) >= 0.55) & robust,
        "risk_controlled": (known("drawdown_pct", -100.0) >= -15) & (known("worst_pct", -100.0) >= -35), "has_wallet_quality": quality, "only_traction": traction & ~quality,
    }
    mode = watch_mode({k: there(f"{k}_validated") for k in KINDS} | {"replay": F.col("replay_passed")}, [there(f"{k}_watch") for k in KINDS if k != "wallet"])
    out = out.withColumns(checks | mode)
    verdict = F.when(F.col("system_candidate"), "system-candidate").when(F.col("wallet_only"), "wallet-only").when(F.col("system_watch") | (F.col("positive_enough") & F.col("risk_controlled")), "keep-watching").otherwise("stand-down")
    return out.withColumn("verdict", verdict)
