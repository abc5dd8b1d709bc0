"""Entries, their prices afterwards, and exits on return paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import first_by, near_row, range_join, running
from tidemark.functions.scratch import stored
from tidemark.operators.research import ranked


def pending_buys(swaps: DataFrame, entries: DataFrame, keys: Sequence[str] = ("wallet", "token")) -> DataFrame:
    """Earliest swap per key that no entry is linked to."""
    return first_by(swaps, keys, ["t", "swap_key"]).join(entries.select(*keys).distinct(), list(keys), "left_anti")


def prior_token_count(entries: DataFrame) -> DataFrame:
    """Tokens that the wallet had entered strictly before each entry's time."""
    first = F.row_number().over(Window.partitionBy("wallet", "token").orderBy("t", "entry_key")) == 1
    before = Window.partitionBy("wallet").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    marked = entries.withColumn("_first", first.cast("int"))
    return marked.withColumn("prior_tokens", F.coalesce(F.sum("_first").over(before), F.lit(0))).drop("_first")


def entry_decision(controlled: Column, risk_known: Column, risk_passed: Column) -> Column:
    return F.when(~controlled, "skip-uncontrolled").when(~risk_known, "defer-unknown").when(~risk_passed, "skip-failed").otherwise("materialize")


def materialize_entries(pending: DataFrame, obs: DataFrame, within: int, controlled: Column) -> DataFrame:
    """Each pending buy with the first observation of its pool at or after it, and its cohort."""
    rows = obs.select("pool", F.col("t").alias("obs_t"), "obs_key", "price_usd", "liquidity_usd")
    near = near_row(pending.select("swap_key", "pool", "t"), rows, ["pool"], F.col("t"), "obs_t", ["obs_key"], within + 1, "near")
    seen = near.where(F.col("near.obs_t") <= F.col("t") + within).select("swap_key", "near.obs_t", "near.obs_key", "near.price_usd", "near.liquidity_usd")
    out = pending.join(seen, "swap_key")
    return out.withColumn("cohort", F.when(~controlled, "excluded-uncontrolled-flow").when(F.col("prior_tokens") >= 2, "repeat-wallet+controlled-flow").otherwise("controlled-flow-control"))


#: Rows of a block, and blocks of a block of the next level.
FANOUT = 16


def first_crossing(entries: DataFrame, rows: DataFrame, keys: Sequence[str], take_pct: float, stop_pct: float) -> DataFrame:
    """Per entry (entry_key, keys, entry_t, entry_price) that has one, ``threshold``: the first row (obs_t, obs_key, price_usd, rugged) from entry_t on that gains take_pct or loses stop_pct.

    A market's rows are numbered and cut to blocks of FANOUT, these again, and so
    on; each block knows its least and greatest price. As the gain is monotone in
    the price, they tell whether a block holds such a row. An entry looks through
    the rest of its block, climbs until a block has one, and comes down to it: it
    meets two blocks a level, however far the row is. From a price of 0 every
    price is a gain.
    """
    keys = list(keys)
    placed = stored(ranked(rows.where(_all_known(keys)), "obs_t", "obs_key", keys=keys).select(*keys, "place", "obs_t", "obs_key", "price_usd", "rugged"))
    top = placed.agg(F.max("place")).first()[0] or 0
    start = near_row(entries.select("entry_key", *keys, "entry_t", "entry_price"), placed.select(*keys, "obs_t", "obs_key", "place"), keys, F.col("entry_t"), "obs_t", ["obs_key"], 86_400, "first")
    # place is the next one to look at on the level
    left = start.where("first IS NOT NULL").select("entry_key", *keys, "entry_price", F.col("first.place").alias("place"))
    gain = lambda p: F.when(F.col("entry_price") != 0, (p / F.nullif(F.col("entry_price"), F.lit(0.0)) - 1) * 100)
    met = lambda p: F.when(F.col("entry_price") == 0, p.isNotNull()).otherwise((gain(p) >= take_pct) | (gain(p) <= stop_pct))
    levels = [placed.select(*keys, "place", F.col("price_usd").alias("low"), F.col("price_usd").alias("high"))]
    while top >= FANOUT:
        up = levels[-1].groupBy(*keys, F.floor(F.col("place") / FANOUT).alias("place")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        levels.append(stored(up))
        top //= FANOUT
    blocks = [x.groupBy(*keys, F.floor(F.col("place") / FANOUT).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("_inner")) for x in levels]

    def look(some: DataFrame, level: int) -> DataFrame:
        """some with place moved to the first child from it on, within its block, that holds a row; null if none."""
        here = some.withColumn("_block", F.floor(F.col("place") / FANOUT)).join(blocks[level], [*keys, "_block"])
        hit = F.filter("_inner", lambda b: (b["place"] >= F.col("place")) & (met(b["low"]) | met(b["high"])))
        return here.select("entry_key", *keys, "entry_price", "_block", F.get(hit, F.lit(0))["place"].alias("place"))

    found = None
    climbed = []
    for level in range(len(levels)):
        seen = stored(look(left, level))
        climbed.append(seen.where("place IS NOT NULL").drop("_block"))
        # the blocks behind, as children of the next level
        left = seen.where("place IS NULL").select("entry_key", *keys, "entry_price", (F.col("_block") + 1).alias("place"))
    for level in reversed(range(len(levels))):
        here = climbed[level] if found is None else climbed[level].unionByName(look(found, level).drop("_block"))
        found = stored(here) if level == 0 else here.withColumn("place", F.col("place") * FANOUT)
    return found.join(placed, [*keys, "place"]).select("entry_key", F.struct("obs_t", "obs_key", "price_usd", "rugged").alias("threshold"))


def _all_known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def outcomes(entries: DataFrame, obs: DataFrame, now: int, horizon: int, delay: int, exit_strategy: str = "fixed-horizon", cost_pct: float = 3.0, take_pct: float = 15.0, stop_pct: float = -20.0) -> DataFrame:
    """Per entry (entry_key, token, pool, t, entry_price) its outcome on observations (token, pool, t, obs_key, price_usd, rugged) up to now.

    Mature, once the horizon has passed: the earliest of the first rugged row,
    the first row from horizon to horizon + delay, and, for the threshold exit,
    the first row by the horizon that gains or loses enough. Otherwise the last
    row so far. An entry without a pool takes any pool of its token. Rows with
    executable false (a column that may be missing) count only if rugged. The
    rows that end an entry are found by near_row and first_crossing, without a
    join of an entry and its path.
    """
    e = entries.select("entry_key", "token", "pool", F.col("t").alias("entry_t"), "entry_price")
    if "executable" in obs.columns:
        obs = obs.where("rugged OR coalesce(executable, true)")
    o = obs.select("token", "pool", F.col("t").alias("obs_t"), "obs_key", "price_usd", "rugged").where(F.col("obs_t") <= now)
    at = F.struct("obs_t", "obs_key", "price_usd", "rugged")
    target, width = F.col("entry_t") + horizon, max(3600, horizon + delay)
    seen = None
    for some, keys in ((e.where("pool IS NOT NULL"), ["token", "pool"]), (e.where("pool IS NULL").drop("pool"), ["token"])):
        rows = o.select(*keys, "obs_t", "obs_key", "price_usd", "rugged")
        part = near_row(some, rows.where("rugged"), keys, F.col("entry_t"), "obs_t", ["obs_key"], width, "rug")
        part = near_row(part, rows, keys, target, "obs_t", ["obs_key"], width, "fixed").withColumn("fixed", F.when(F.col("fixed.obs_t") <= target + delay, F.col("fixed")))
        if exit_strategy != "fixed-horizon":
            hits = first_crossing(some, rows, keys, take_pct, stop_pct)
            part = part.join(hits, "entry_key", "left").withColumn("threshold", F.when(F.col("threshold.obs_t") <= target, F.col("threshold")))
        last = rows.groupBy(*keys).agg(F.max(at).alias("latest"))
        part = part.join(last, keys, "left")
        part = part.withColumn("latest", F.when(F.col("latest.obs_t") >= F.col("entry_t"), F.col("latest"))).drop("pool")
        part = part.withColumns({c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(c)[x].alias(x) for x in ("obs_t", "obs_key", "price_usd", "rugged")])) for c in part.columns if c in ("rug", "fixed", "threshold")})
        seen = part if seen is None else seen.unionByName(part)
    exits = ["rug", "fixed"] + (["threshold"] if exit_strategy != "fixed-horizon" else [])
    due = F.lit(now) >= F.col("entry_t") + horizon
    mature = F.when(due, F.least(*exits))
    out = seen.withColumn("_mature", mature).withColumn("_row", F.coalesce("_mature", "latest"))
    price = F.when(F.col("_row.rugged"), 0.0).otherwise(F.col("_row.price_usd"))
    gross_pct = F.when(F.col("entry_price") > 0, (price - F.col("entry_price")) / F.col("entry_price") * 100)
    return out.select(
        "entry_key",
        F.when(F.col("_mature").isNotNull(), "mature").when(~due, "provisional").otherwise("unresolved").alias("status"),
        price.alias("outcome_price"), gross_pct.alias("gross_pct"), (gross_pct - cost_pct).alias("net_pct"), F.col("_mature.obs_t").alias("frozen_t"),
        F.coalesce(F.col("_mature.rugged"), F.lit(False)).alias("rugged"), F.coalesce(F.col("_row.obs_t"), F.lit(now).cast("long")).alias("outcome_t"), F.lit(exit_strategy).alias("exit_strategy"),
    )


def assess_fixed_horizon(rows: DataFrame, horizon: int, delay: int) -> DataFrame:
    """canonical and reason for rows of outcomes joined with entries (linked, t)."""
    age = F.col("frozen_t") - F.col("t")
    inside = age.between(0, horizon + delay)
    reason = (
        F.when(~F.col("linked"), "unlinked-entry").when(F.col("status") != "mature", "not-mature").when(F.col("exit_strategy") != "fixed-horizon", "wrong-exit-strategy")
        .when(F.col("net_pct").isNull(), "missing-return").when(F.col("frozen_t").isNull(), "missing-freeze-time")
        .when(F.col("rugged") & inside & (age < horizon), "terminal-rug-before-horizon").when((F.col("rugged") & inside) | age.between(horizon, horizon + delay), "valid-window").otherwise("outside-window")
    )
    return rows.withColumn("reason", reason).withColumn("canonical", F.col("reason").isin("valid-window", "terminal-rug-before-horizon"))


def horizon_outcomes(signals: DataFrame, obs: DataFrame, horizon: int, delay: int, now: int) -> DataFrame:
    """Earliest signal per token: first positive price in [t+h, t+h+d], else the latest one by now; and the least and most return until then."""
    s = first_by(signals, ["token"], ["t", "signal_key"]).select("token", F.col("t").alias("signal_t"), "signal_price")
    path = range_join(s, obs.where("price_usd > 0").select("token", F.col("t").alias("obs_t"), "obs_key", "price_usd"), ["token"], F.col("signal_t"), F.lit(now).cast("long"), "obs_t", 86_400)
    at = F.struct("obs_t", "obs_key", "price_usd")
    hit = F.min(F.when(F.col("obs_t").between(F.col("signal_t") + horizon, F.col("signal_t") + horizon + delay), at)).over(Window.partitionBy("token"))
    marked = path.withColumn("_hit", hit)
    until = marked.where(F.col("_hit").isNull() | (at <= F.col("_hit")))
    ret = (F.col("price_usd") / F.col("signal_price") - 1) * 100
    return until.groupBy("token", "signal_t", "signal_price").agg(F.max(at).alias("_last"), F.bool_or(F.col("_hit").isNotNull()).alias("reached"), F.max(ret).alias("max_pct"), F.min(ret).alias("min_pct")).select(
        "token", "signal_t", "reached", F.col("_last.obs_t").alias("outcome_t"), ((F.col("_last.price_usd") / F.col("signal_price") - 1) * 100).alias("return_pct"), "max_pct", "min_pct"
    )


def barrier_exit(path: DataFrame, key: str, take: float, stop: float, timeout: int) -> DataFrame:
    """First of timeout, take-profit, stop-loss on rows (key, t0, t, tie, ret), in that order within a row; capped returns; else the last row, provisional."""
    reason = F.when(F.col("t") - F.col("t0") >= timeout, "timeout").when(F.col("ret") >= take, "take-profit").when(F.col("ret") <= stop, "stop-loss")
    value = F.when(reason == "take-profit", F.lit(float(take))).when(reason == "stop-loss", F.lit(float(stop))).otherwise(F.col("ret"))
    hit = F.struct("t", "tie", value.alias("ret"), reason.alias("reason"))
    out = path.groupBy(key).agg(F.min(F.when(reason.isNotNull(), hit)).alias("_hit"), F.max(F.struct("t", "tie", F.col("ret"), F.lit("provisional").alias("reason"))).alias("_last"))
    row = F.coalesce("_hit", "_last")
    return out.select(key, row["t"].alias("exit_t"), row["ret"].alias("return_pct"), row["reason"].alias("reason"))


def two_stage_exit(path: DataFrame, key: str, take: float, stop: float, secure: float, trail: float) -> DataFrame:
    """Stop before any gain of ``take``; from then on a share is secured there and the rest leaves ``trail`` below its running peak."""
    w = running([key], ["t", "tie"])
    before = Window.partitionBy(key).orderBy("t", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = path.withColumn("_took", F.max((F.col("ret") >= take).cast("int")).over(w)).withColumn("_had", F.coalesce(F.max((F.col("ret") >= take).cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("_peak", F.max(F.when(F.col("_took") == 1, F.col("ret"))).over(w))
    reason = F.when((F.col("_took") == 0) & (F.col("ret") <= stop), "stop-loss").when((F.col("_had") == 1) & (F.col("ret") <= F.col("_peak") - trail), "trailing-stop")
    hit = F.struct("t", "tie", "ret", reason.alias("reason"), F.col("_took").alias("took"))
    out = rows.groupBy(key).agg(F.min(F.when(reason.isNotNull(), hit)).alias("_hit"), F.max(F.struct("t", "tie", "ret", F.lit("provisional").alias("reason"), F.col("_took").alias("took"))).alias("_last"))
    row = F.coalesce("_hit", "_last")
    value = F.when(row["reason"] == "stop-loss", F.lit(float(stop))).when(row["took"] == 1, secure * take + (1 - secure) * row["ret"]).otherwise(row["ret"])
    return out.select(key, row["t"].alias("exit_t"), value.alias("return_pct"), row["reason"].alias("reason"))


def entry_trade_plan(signals: DataFrame, obs: DataFrame, latency: int, min_liquidity: float, hold: int, take: float, stop: float, slippage_bps: float) -> DataFrame:
    """Per signal its entry, the first liquid row after the latency, and its exit, the first later row that ends the trade."""
    o = obs.select("token", F.col("t").alias("obs_t"), "obs_key", "price_usd", "liquidity_usd", "rugged")
    able = range_join(signals, o.where((F.col("liquidity_usd") >= min_liquidity) & (F.col("price_usd") > 0)), ["token"], F.col("t") + latency, F.col("t") + latency + hold, "obs_t", hold + 1)
    first = able.groupBy("signal_key", "token").agg(F.min(F.struct("obs_t", "obs_key", "price_usd")).alias("_in"))
    first = first.select("signal_key", "token", F.col("_in.obs_t").alias("entry_t"), F.col("_in.obs_key").alias("entry_obs"), (F.col("_in.price_usd") * (1 + slippage_bps / 10_000)).alias("entry_price"))
    later = range_join(first, o, ["token"], F.col("entry_t"), F.col("entry_t") + 2 * hold, "obs_t", 2 * hold + 1).where((F.col("obs_t") > F.col("entry_t")) | (F.col("obs_key") > F.col("entry_obs")))
    ret = (F.col("price_usd") / F.col("entry_price") - 1) * 100
    reason = F.when(F.col("rugged"), "rug").when(F.col("liquidity_usd") < min_liquidity, "liquidity_failure").when(ret <= stop, "stop").when(ret >= take, "take_profit").when(F.col("obs_t") - F.col("entry_t") >= hold, "time")
    hit = F.struct("obs_t", "obs_key", "price_usd", reason.alias("reason"))
    found = later.groupBy("signal_key").agg(F.min(F.when(reason.isNotNull(), hit)).alias("_hit"), F.max(F.struct("obs_t", "obs_key", "price_usd", F.lit("end_of_data").alias("reason"))).alias("_last"))
    row = F.coalesce("_hit", "_last")
    return first.join(found, "signal_key", "left").select("signal_key", "token", "entry_t", "entry_price", row["obs_t"].alias("exit_t"), row["price_usd"].alias("exit_price"), F.coalesce(row["reason"], F.lit("end_of_data")).alias("reason"))


def trade_pnl(plans: DataFrame, size_usd: float, fee_bps: float, slippage_bps: float) -> DataFrame:
    """pnl, return and minutes held per plan; a rug or a liquidity failure loses everything."""
    lost = F.col("reason").isin("rug", "liquidity_failure")
    out_price = F.when(lost, 0.0).otherwise(F.coalesce("exit_price", "entry_price") * (1 - slippage_bps / 10_000))
    got = F.lit(size_usd) / F.col("entry_price") * out_price
    pnl = got - size_usd - (got + size_usd) * fee_bps / 10_000
    return plans.withColumns({"pnl": pnl, "return_pct": pnl / size_usd * 100, "hold_minutes": (F.coalesce("exit_t", "entry_t") - F.col("entry_t")) / 60.0})


def hash_share(name: Column) -> Column:
    """Number in [0, 1] from the first 32 bits of a sha256."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def position_size(target: float, fraction: float, cash: Column, exposure_left: Column, liquidity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(target), cash, exposure_left, liquidity * fraction))
