"""Contextual survival: every decision scored by outcomes that were complete before it, for its context and its supporters.

What is known of a context, a wallet or a wallet in a context at a decision are sums
over completions strictly before it. They are prefix sums: each key's time is cut to
buckets, buckets are summed and their sums run up once, and within a bucket
completions and decisions are put in order. So no window holds more than a bucket
of a key, and the global sums are taken in the same way.

Thresholds are order statistics of the ``LOOKBACK`` scores before a decision. Rows
are numbered, cut to blocks, and each block is given the last scores of the one
before it (a halo), so blocks are worked on apart.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import first_by
from tidemark.functions.scratch import stored
from tidemark.operators.hot_markets import carried
from tidemark.operators.research import PROFIT_FACTOR_TOP, WINDOWS, modeled_return, ranked, split_times, window_at

# fixed values of the method
FLOOR_PCT, CEILING_PCT, HAZARD_PCT = -100.0, 100.0, -80.0
LEAST_HISTORY, LOOKBACK, QUANTILE = 100, 500, 0.9
GLOBAL_STRENGTH, CONTEXT_STRENGTH, WALLET_STRENGTH = 10.0, 24.0, 8.0
RUG_PRIOR, PRIOR_VARIANCE, SCORE_Z, RISK_Z, TOP_RISK = 0.1, 900.0, 1.28, 1.645, 0.12
EXPERIENCED, SUPPORTERS_COUNTED, SHUFFLE_SHARE = 6, 2, 0.382
CONTEXT_CUTS = {"liquidity_usd": (15_000, 30_000, 60_000), "pool_age_minutes": (7, 12, 20), "top10_percent": (15, 25, 40), "volume_liquidity_ratio": (0.35, 0.75, 1.5), "buy_share_5m": (0.48, 0.58, 0.68)}
FLAGS = ("controlled_flow", "risk_known", "risk_passed", "mint_revoked", "freeze_revoked")
LEAST = {"all": (30, 7), "train": (12, 2), "validation": (8, 1), "holdout1": (8, 1), "holdout2": (8, 1)}
SUMS = ("n", "hazards", "calm_n", "calm_sum", "calm_squares", "total")
#: Rows of a block of a series, besides its halo.
BLOCK = 4000
#: A key with more decisions and completions than this is cut to buckets of time.
HOT_ROWS = 1_000_000


# -- records ------------------------------------------------------------------
def decision_records(records: DataFrame) -> DataFrame:
    """The first sound record of each market that may be decided on, with context, modelled value and one entry per supporter.

    records: market, dex, t, frozen_t, net_return_pct, cost_pct, rugged, the FLAGS,
    transactions_5m, the columns of CONTEXT_CUTS, supporters (array of wallet,
    prior_tokens). Blank wallets are no supporters; of one wallet the larger prior
    number stays.
    """
    rows = first_by(records.where("frozen_t >= t"), ["market"], ["t", "frozen_t", "net_return_pct", "cost_pct"])
    ok = (F.col("pool_age_minutes") >= 5) & (F.col("liquidity_usd") > 0) & (F.col("transactions_5m") > 0) & F.col("buy_share_5m").between(0, 1)
    for flag in FLAGS:
        ok = ok & F.col(flag)
    named = F.filter(F.transform("supporters", lambda s: F.struct(F.trim(s["wallet"]).alias("wallet"), F.greatest(F.lit(0), s["prior_tokens"]).cast("long").alias("prior_tokens"))), lambda s: s["wallet"] != "")
    most = lambda w: F.array_max(F.transform(F.filter("_named", lambda s: s["wallet"] == w), lambda s: s["prior_tokens"]))
    wallets = F.array_sort(F.array_distinct(F.transform("_named", lambda s: s["wallet"])))
    rows = rows.where(F.coalesce(ok, F.lit(False))).withColumn("_named", named)
    rows = rows.withColumn("supporters", F.transform(wallets, lambda w: F.struct(w.alias("wallet"), most(w).alias("prior_tokens")))).drop("_named").where(F.size("supporters") > 0)
    value = modeled_return(F.col("net_return_pct"), F.col("rugged"), F.col("cost_pct"))
    context = F.concat_ws("|", F.col("dex"), *[_bucket(c, cuts) for c, cuts in CONTEXT_CUTS.items()])
    return rows.select("market", "t", "frozen_t", "rugged", context.alias("context"), value.alias("value"), "supporters")


def _bucket(column: str, cuts: Sequence[float]) -> Column:
    out = F.lit(f"{len(cuts)}+")
    for k, cut in reversed(list(enumerate(cuts))):
        out = F.when(F.col(column) < cut, str(k)).otherwise(out)
    return F.when(F.col(column).isNull() | F.isnan(F.col(column).cast("double")), "unknown").otherwise(out)


# -- what was known --------------------------------------------------------------
def causal_sums(decisions: DataFrame, completions: DataFrame, scopes: dict[str, Sequence[str]], sums: Sequence[str], buckets: int = 256, hot_rows: int | None = None) -> DataFrame:
    """decisions (t, keys, ...) with, per scope (prefix: keys) and each of sums, the total of the completions (frozen_t, keys, sums) of equal keys strictly before t.

    The keys of the first scope lead those of the others, so that one exchange and
    one pass serve them all. Where they name more than ``hot_rows`` rows, time is cut
    to buckets and a bucket opens with a row of what came before it.
    """
    base, keys = list(next(iter(scopes.values()))), list(dict.fromkeys(k for ks in scopes.values() for k in ks))
    types = {f.name: f.dataType for f in decisions.schema.fields}
    none = lambda kind: F.lit(None).cast(kind)
    events = decisions.select("*", F.col("t").alias("_at"), F.lit(0).alias("_kind"), *[none("double").alias(f"_{c}") for c in sums]).unionByName(
        completions.select(*[F.col(c) if c in keys else none(kind).alias(c) for c, kind in types.items()], F.col("frozen_t").alias("_at"), F.lit(1).alias("_kind"), *[F.col(c).cast("double").alias(f"_{c}") for c in sums])
    )
    hot = None
    if base:
        hot = stored(events.groupBy(*base).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (HOT_ROWS if hot_rows is None else hot_rows)).select(*base, F.lit(True).alias("_hot")))
        hot = None if hot.isEmpty() else hot
    if base and hot is None:
        rows = events.withColumns({"_b": F.lit(0).cast("long"), "_scope": none("int")})
    else:
        low, high = (x or 0 for x in events.agg(F.min("_at"), F.max("_at")).first())
        b = F.floor((F.col("_at") - low) / max(1, (high - low) // buckets + 1)).cast("long")
        if base:
            marked = carried(events, hot, base)
            events = marked.withColumn("_b", F.when(F.col("_hot"), b).otherwise(F.lit(0).cast("long")))
            large = events.where("_hot")
            events = events.drop("_hot")
        else:
            events = large = events.withColumn("_b", b)
        rows = events.withColumn("_scope", none("int"))
        for i, ks in enumerate(scopes.values()):
            run = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
            whole = large.groupBy(*ks, "_b").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in sums])
            before = whole.select(*ks, "_b", *[F.sum(f"_{c}").over(run).alias(f"_{c}") for c in sums])
            opening = before.withColumns({"_at": F.lit(None).cast("long"), "_kind": F.lit(-1), "_scope": F.lit(i)})
            rows = rows.unionByName(opening, allowMissingColumns=True)
    for i, (prefix, ks) in enumerate(scopes.items()):
        # decisions stand before completions of the same time, the opening row before all
        inner = Window.partitionBy(*ks, "_b").orderBy(F.asc_nulls_first("_at"), "_kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        mine = F.col("_scope").isNull() | (F.col("_scope") == i)
        rows = rows.withColumns({f"{prefix}_{c}": F.coalesce(F.sum(F.when(mine, F.col(f"_{c}"))).over(inner), F.lit(0.0)) for c in sums})
    return rows.where("_kind = 0").select(*decisions.columns, *[f"{p}_{c}" for p in scopes for c in sums])


def _completions(rows: DataFrame, *keys: str) -> DataFrame:
    """What each record adds to its keys when it is frozen; learned values are cut to what the model spans."""
    hazard = F.col("rugged") | (F.col("value") <= HAZARD_PCT)
    x = F.greatest(F.lit(FLOOR_PCT), F.least(F.lit(CEILING_PCT), F.col("value")))
    calm = lambda c: F.when(~hazard, c).otherwise(0.0)
    return rows.select(*keys, "frozen_t", F.lit(1.0).alias("n"), hazard.cast("double").alias("hazards"), calm(F.lit(1.0)).alias("calm_n"), calm(x).alias("calm_sum"), calm(x * x).alias("calm_squares"), x.alias("total"))


def _shrunk(part: Column, n: Column, prior: Column, strength: float) -> Column:
    return (part + prior * strength) / F.greatest(F.lit(1.0), n + strength)


def _upper(p: Column, n: Column) -> Column:
    z2 = RISK_Z * RISK_Z
    return F.least(F.lit(1.0), (p + z2 / (2 * n) + RISK_Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n))


def market_scores(rows: DataFrame) -> DataFrame:
    """rows with history (completions known), risk, risk_upper, expected, uncertainty and market_score."""
    out = causal_sums(rows, _completions(rows, "context"), {"g": [], "c": ["context"]}, SUMS)
    c = F.col
    risk = _shrunk(c("c_hazards"), c("c_n"), _shrunk(c("g_hazards"), c("g_n"), F.lit(RUG_PRIOR), GLOBAL_STRENGTH), CONTEXT_STRENGTH)
    mean = _shrunk(c("c_calm_sum"), c("c_calm_n"), _shrunk(c("g_calm_sum"), c("g_calm_n"), F.lit(0.0), GLOBAL_STRENGTH), CONTEXT_STRENGTH)
    own = c("c_calm_sum") / c("c_calm_n")
    sample = F.greatest(F.lit(0.0), (c("c_calm_squares") - c("c_calm_n") * own * own) / F.greatest(F.lit(1.0), c("c_calm_n") - 1))
    variance = F.when(c("c_calm_n") < 2, PRIOR_VARIANCE).otherwise((sample * c("c_calm_n") + PRIOR_VARIANCE * CONTEXT_STRENGTH) / (c("c_calm_n") + CONTEXT_STRENGTH))
    out = out.withColumns({"history": c("g_n").cast("long"), "risk": risk, "_mean": mean, "_variance": variance})
    out = out.withColumn("risk_upper", _upper(c("risk"), c("c_n") + CONTEXT_STRENGTH)).withColumn("expected", (1 - c("risk")) * c("_mean") + c("risk") * FLOOR_PCT)
    doubt = F.greatest(F.lit(0.0), c("risk_upper") - c("risk")) * 100 + SCORE_Z * F.sqrt(c("_variance") / F.greatest(F.lit(1.0), c("c_calm_n") + CONTEXT_STRENGTH))
    out = out.withColumn("uncertainty", doubt).withColumn("market_score", c("expected") - c("uncertainty"))
    return out.select(*rows.columns, "history", "risk", "risk_upper", "expected", "uncertainty", "market_score")


def wallet_scores(scored: DataFrame) -> DataFrame:
    """scored (place, ...) with evidence (supporters with a past), experienced, and wallet_score: moved by the best two supporters' own pasts."""
    each = scored.select("place", "t", "frozen_t", "rugged", "context", "value", "expected", F.explode("supporters").alias("s")).select("*", F.col("s.wallet").alias("wallet"), F.col("s.prior_tokens").alias("prior_tokens")).drop("s")
    past = _completions(each, "wallet", "context").select("wallet", "context", "frozen_t", "n", "total")
    rows = causal_sums(each.select("place", "t", "context", "expected", "wallet", "prior_tokens"), past, {"w": ["wallet"], "x": ["wallet", "context"]}, ("n", "total"))
    base = _shrunk(F.col("w_total"), F.col("w_n"), F.col("expected"), WALLET_STRENGTH)
    moved = (_shrunk(F.col("x_total"), F.col("x_n"), base, WALLET_STRENGTH) - F.col("expected")) * F.col("w_n") / (F.col("w_n") + WALLET_STRENGTH)
    rows = rows.select("place", "wallet", "prior_tokens", "w_n", F.when(F.col("w_n") > 0, moved).alias("moved"))
    best = Window.partitionBy("place").orderBy(F.desc_nulls_last("moved"), F.desc("w_n"), "wallet")
    rows = rows.withColumn("_nth", F.row_number().over(best))
    top = F.avg(F.when(F.col("_nth") <= SUPPORTERS_COUNTED, F.col("moved"))).alias("adjustment")
    found = rows.groupBy("place").agg(F.count("moved").alias("evidence"), F.count_if(F.col("prior_tokens") >= EXPERIENCED).alias("experienced"), top)
    out = scored.drop("supporters").join(found, "place")
    return out.withColumn("wallet_score", F.col("market_score") + F.coalesce("adjustment", F.lit(0.0))).drop("adjustment")


# -- thresholds -------------------------------------------------------------------
def rolling_quantile(rows: DataFrame, keys: Sequence[str], value: str | Sequence[str], at: str | None, tie: str | None, name: str | Sequence[str], size: int = LOOKBACK, least: int = LEAST_HISTORY, q: float = QUANTILE) -> DataFrame:
    """rows with the value at place ceil((n - 1) q) of the ``size`` before each in its series (keys), null below ``least`` of them.

    Several values may be named, with as many names. Series are numbered (without
    ``at`` they have their place) and cut to blocks; a block also gets the last ``size`` values before it.
    """
    keys, values, names = list(keys), [value] if isinstance(value, str) else list(value), [name] if isinstance(name, str) else list(name)
    placed = ranked(rows, at, tie, keys=keys) if at else rows
    block = F.floor(F.col("place") / BLOCK)
    # a halo may reach over several blocks when they are shorter than it
    ahead = F.filter(F.sequence(F.lit(0), F.lit(math.ceil(size / BLOCK))), lambda k: (k == 0) | (F.col("place") >= (block + k) * BLOCK - size))
    own = placed.select(*keys, block.alias("_of"), "place", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(values)], F.explode(ahead).alias("_ahead"))
    own = own.select(*keys, (F.col("_of") + F.col("_ahead")).alias("_block"), "place", *[f"_v{i}" for i in range(len(values))], (F.col("_ahead") == 0).alias("_own"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}

    def quantiles(v: np.ndarray, mine: np.ndarray) -> np.ndarray:
        out, plain = np.full(len(mine), np.nan), not np.isnan(v).any()
        seen: list[float] = []
        first = last = 0
        for k, i in enumerate(mine):
            low = max(0, i - size)
            if i - low < least:
                continue
            place = math.ceil((i - low - 1) * q)
            if not plain:
                out[k] = np.partition(v[low:i], place)[place]
                continue
            # the values in view, kept in order
            if not seen:
                seen, first, last = np.sort(v[low:i]).tolist(), low, i
            for x in v[last:i].tolist():
                insort(seen, x)
            for x in v[first:low].tolist():
                del seen[bisect_left(seen, x)]
            first, last = low, i
            out[k] = seen[place]
        return out

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        mine = np.flatnonzero(part["_own"].to_numpy())
        found = part.iloc[mine][[*keys, "place"]].copy()
        for i in range(len(values)):
            found[f"_q{i}"] = quantiles(part[f"_v{i}"].to_numpy(), mine)
        return found

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "place long", *(f"_q{i} double" for i in range(len(values)))])
    found = own.groupBy(*keys, "_block").applyInPandas(solve, schema)
    found = found.select(*keys, "place", *[F.when(~F.isnan(f"_q{i}"), F.col(f"_q{i}")).alias(c) for i, c in enumerate(names)])
    out = placed.join(found, [*keys, "place"])
    return out.drop("place") if at else out


# -- decisions --------------------------------------------------------------------
def _turned(placed: DataFrame, n: int) -> DataFrame:
    shift = max(1, int(n * SHUFFLE_SHARE)) if n > 1 else 0
    given = placed.select(F.pmod(F.col("place") - shift, F.lit(max(1, n))).alias("place"), "supporters")
    return placed.drop("supporters").join(given, "place")


def shuffled_supporters(rows: DataFrame) -> DataFrame:
    """rows whose supporters are those of the record some places further, round the end: a control that breaks who supported what."""
    return _turned(ranked(rows, "t", "market"), rows.count()).drop("place")


def _scored(rows: DataFrame) -> DataFrame:
    """Records with their place in time and what does not depend on supporters, written once."""
    return stored(market_scores(stored(ranked(stored(rows), "t", "market"))))


def _by_wallet() -> Column:
    return _mature() & (F.col("evidence") > 0) & _chosen("wallet")


def _mature() -> Column:
    return (F.col("history") >= LEAST_HISTORY) & (F.col("risk_upper") <= TOP_RISK)


def _chosen(kind: str) -> Column:
    return F.coalesce((F.col(f"{kind}_score") > 0) & (F.col(f"{kind}_score") >= F.col(f"{kind}_threshold")), F.lit(False))


def decide(rows: DataFrame) -> DataFrame:
    """One row per record of decision_records: scores, thresholds, gates and the two selections."""
    return _decided(_scored(rows))


def _decided(scored: DataFrame) -> DataFrame:
    both = stored(wallet_scores(scored))
    out = rolling_quantile(both, [], ["market_score", "wallet_score"], None, None, ["market_threshold", "wallet_threshold"])
    gates = {"mature": F.col("history") >= LEAST_HISTORY, "gate": F.col("risk_upper") <= TOP_RISK}
    out = out.withColumns({**gates, "by_market": _mature() & _chosen("market"), "by_wallet": _by_wallet()})
    return out.drop("place", "frozen_t", "expected", "uncertainty")


def _control(scored: DataFrame) -> DataFrame:
    """The decisions by wallet (market, t, value, rugged, by_wallet) that the shuffled supporters lead to; all else of them is the same."""
    both = stored(wallet_scores(_turned(scored, scored.count())).select("place", "market", "t", "value", "rugged", "history", "risk_upper", "evidence", "wallet_score"))
    out = rolling_quantile(both, [], "wallet_score", None, None, "wallet_threshold")
    return out.select("market", "t", "value", "rugged", _by_wallet().alias("by_wallet"))


@dataclass(frozen=True)
class Survival:
    """decisions, and policies: one row per policy and window with figures, reasons and the verdict on all."""

    decisions: DataFrame
    policies: DataFrame


def policy_windows(decisions: DataFrame, shuffled: DataFrame, embargo: int) -> DataFrame:
    """Figures and reasons to fail of every policy on every window; also of those that select nothing."""
    picked = decisions.select("market", "t", "value", "rugged", F.array_compact(F.array(F.when(F.col("mature"), F.lit("broad")), F.when(F.col("by_market"), F.lit("market")), F.when(F.col("by_wallet"), F.lit("wallet")))).alias("p"))
    control = shuffled.select("market", "t", "value", "rugged", F.array_compact(F.array(F.when(F.col("by_wallet"), F.lit("shuffled")))).alias("p"))
    window = window_at("t", split_times(decisions, "t", "market"), embargo)
    rows = picked.unionByName(control).select("market", "t", "value", "rugged", F.explode("p").alias("policy"))
    # rows within the embargo have no window of their own
    rows = rows.withColumn("window", F.explode(F.array_compact(F.array(F.lit("all"), window))))
    v, n = F.col("value"), F.coalesce("n", F.lit(0))
    gain, loss = F.sum(F.greatest(v, F.lit(0.0))), -F.sum(F.least(v, F.lit(0.0)))
    stats = rows.groupBy("policy", "window").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.floor(F.col("t") / 86_400)).alias("days"), F.avg(v).alias("average"), F.percentile(v, F.lit(0.5)).alias("median"),
        F.when(F.count(v) > 1, (F.sum(v) - F.max(v)) / (F.count(v) - 1)).otherwise(0.0).alias("ex_best"), F.avg((v > 0).cast("double")).alias("hit_rate"),
        F.when(loss > 0, gain / loss).when(gain > 0, PROFIT_FACTOR_TOP).otherwise(0.0).alias("profit_factor"), F.avg(F.col("rugged").cast("double")).alias("rug_rate"),
        F.avg((v <= -50).cast("double")).alias("catastrophic_rate"), F.min(v).alias("worst"), F.when(gain > 0, F.greatest(F.max(v), F.lit(0.0)) / gain).otherwise(0.0).alias("best_share"),
    )
    spark = decisions.sparkSession
    kinds = spark.createDataFrame([(p, w) for p in ("broad", "market", "shuffled", "wallet") for w in ("all", *WINDOWS)], "policy string, window string")
    out = kinds.join(F.broadcast(stats), ["policy", "window"], "left").fillna(0)
    least, days = F.lit(0), F.lit(0)
    for w, (few, short) in LEAST.items():
        least, days = F.when(F.col("window") == w, few).otherwise(least), F.when(F.col("window") == w, short).otherwise(days)
    fails = {
        "count": n < least, "active-days": F.col("days") < days, "median<=0": F.col("median") <= 0, "average-ex-best<=2": F.col("ex_best") <= 2, "hit-rate<60%": F.col("hit_rate") < 0.6, "profit-factor<1.3": F.col("profit_factor") < 1.3,
        "rug-rate>3%": F.col("rug_rate") > 0.03, "catastrophic-rate>3%": F.col("catastrophic_rate") > 0.03, "best-winner-share>30%": F.col("best_share") > 0.3,
    }
    return out.withColumn("reasons", F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in fails.items()]))


def contextual_survival(records: DataFrame, embargo: int = 40 * 60) -> Survival:
    """Decisions and policies; the verdict allows a shadow if the wallet policy passes on all windows and beats both controls on the later three."""
    scored = _scored(decision_records(records))
    decisions, control = stored(_decided(scored)), stored(_control(scored))
    windows = stored(policy_windows(decisions, control, embargo))
    later = windows.where(F.col("window").isin(*WINDOWS[1:])).groupBy("window").agg(*[F.max(F.when(F.col("policy") == p, F.col("ex_best"))).alias(p) for p in ("wallet", "market", "shuffled")])
    beats = later.agg(F.bool_and((F.col("wallet") > F.col("market")) & (F.col("wallet") > F.col("shuffled"))).alias("beats"))
    passed = windows.where("policy = 'wallet'").agg(F.bool_and(F.col("reasons") == "").alias("passed"))
    verdict = passed.crossJoin(beats).select(F.when(F.col("passed") & F.col("beats"), "future-shadow-only").otherwise("reject").alias("verdict"))
    return Survival(decisions, windows.crossJoin(F.broadcast(verdict)))
