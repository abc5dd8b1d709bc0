"""Coverage, queues, decisions, incremental ledgers and star tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import first_by
from tidemark.operators.market import window_flow

CHECKPOINTS_S = (0, 15, 30, 60, 120, 300)


def partition_heads(events: DataFrame, keys: Sequence[str], now: int) -> DataFrame:
    """First unresolved event per partition in slot order, and whether it is due and final enough."""
    head = first_by(events.where(~F.col("status").isin("processed", "rolled_back")), keys, ["slot", "key"])
    ready = (F.col("next_t") <= now) & (~F.col("finality_required") | (F.col("commitment") == "finalized"))
    return head.withColumn("ready", ready)


def changed_wallets(evidence: DataFrame, scores: DataFrame) -> DataFrame:
    """Wallets with evidence since their last score; the greatest priority, 2 only for qualified wallets."""
    last = scores.select("wallet", "scored_t", "status")
    rows = evidence.join(last, "wallet", "left").where(F.col("scored_t").isNull() | (F.col("t") > F.col("scored_t")))
    good = F.col("status").isin("watch", "candidate", "validated-paper")
    return rows.groupBy("wallet").agg(F.max(F.when((F.col("priority") == 2) & ~F.coalesce(good, F.lit(False)), 1).otherwise(F.col("priority"))).alias("priority"))


def admission_ready(trades: DataFrame, entries: DataFrame, mature: DataFrame, now: int, days: int, least: int) -> DataFrame:
    """Wallets with enough recent sells, entered tokens and tokens with a mature outcome."""
    sells = trades.where((F.col("side") == "sell") & (F.col("t") > now - days * 86_400) & (F.col("t") <= now)).groupBy("wallet").agg(F.count(F.lit(1)).alias("sells"))
    tokens = entries.groupBy("wallet").agg(F.countDistinct("token").alias("tokens"))
    done = mature.groupBy("wallet").agg(F.countDistinct("token").alias("mature_tokens"))
    out = sells.join(tokens, "wallet", "full").join(done, "wallet", "full").fillna(0)
    return out.withColumn("ready", (F.col("sells") >= least) & (F.col("tokens") >= least) & (F.col("mature_tokens") >= least))


def evidence_bounds(counts: dict[str, tuple[DataFrame, int]], key: str = "wallet") -> DataFrame:
    """Rows per key in each table, and whether any is over its limit."""
    out, over = None, F.lit(False)
    for name, (df, limit) in counts.items():
        n = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, key, "full")
        over = over | (F.col(name) > limit)
    return out.fillna(0).withColumn("over", over)


def gap_anti_join(rows: DataFrame, gaps: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """Rows whose time lies in no gap [low, high] of their key.

    Closed gaps are copied to the time buckets they meet. A gap with a null end
    taints all that follows, so per key only the first one counts.
    """
    closed = gaps.where("high IS NOT NULL").select(key, F.col("low").alias("g_low"), F.col("high").alias("g_high"))
    spread = closed.withColumn("_b", F.explode(F.sequence(F.floor(F.col("g_low") / width), F.floor(F.col("g_high") / width))))
    keyed = rows.withColumn("_b", F.floor(F.col(at) / width))
    clean = keyed.join(spread, (keyed[key] == spread[key]) & (keyed["_b"] == spread["_b"]) & F.col(at).between(F.col("g_low"), F.col("g_high")), "left_anti").drop("_b")
    open_ = gaps.where("high IS NULL").groupBy(key).agg(F.min("low").alias("_open"))
    return clean.join(open_, key, "left").where(F.col("_open").isNull() | (F.col(at) < F.col("_open"))).drop("_open")


def incident_transitions(incidents: DataFrame, sent: DataFrame) -> DataFrame:
    """Latest opening or closing per program that was not sent yet."""
    opened = incidents.select("program", F.col("low").alias("t"), F.lit("opened").alias("kind"))
    closed = incidents.where("high IS NOT NULL").select("program", F.col("high").alias("t"), F.lit("closed").alias("kind"))
    return first_by(opened.unionByName(closed), ["program"], [F.desc("t"), F.desc("kind")]).join(sent, ["program", "t", "kind"], "left_anti")


def gap_repair_proof(gaps: DataFrame, repairs: DataFrame) -> DataFrame:
    """Gaps with a completed repair that covers the same target."""
    return gaps.join(repairs.where("status = 'completed'"), ["program", "low", "target"], "left_semi")


def decision_checkpoints(decisions: DataFrame, terminal: DataFrame) -> DataFrame:
    """Each eligible decision at all horizons with its due time; later ones are usable once horizon 0 is terminal."""
    rows = decisions.where("eligible").select("decision", "t", F.explode(F.array(*[F.lit(h) for h in CHECKPOINTS_S])).alias("horizon"))
    return rows.withColumn("due", F.col("t") + F.col("horizon")).join(terminal.select("decision").distinct().withColumn("_done", F.lit(True)), "decision", "left").withColumn("usable", (F.col("horizon") == 0) | F.coalesce("_done", F.lit(False))).drop("_done")


def flow_since_decision(decisions: DataFrame, trades: DataFrame, span: int) -> DataFrame:
    """Distinct buyers and sellers in the span after each decision."""
    ends = decisions.select(F.col("decision").alias("id"), "token", (F.col("t") + span).alias("end"))
    seen = window_flow(ends, trades.withColumns({"volume": F.lit(None).cast("double"), "price": F.lit(None).cast("double")}), span).select(F.col("id").alias("decision"), "buyers", "sellers")
    return decisions.select("decision").join(seen, "decision", "left").fillna(0)


def checkpoint_status(liquidity: Column, first_liquidity: Column, late_s: Column, tolerance_s: int) -> Column:
    state = F.when(liquidity.isNull(), "missing").when(liquidity <= 0, "liquidity-zero").when(liquidity < first_liquidity * 0.2, "liquidity-removed").otherwise("live")
    return F.concat_ws("/", state, F.when(late_s <= tolerance_s, "on-time").otherwise("late"))


def surface_violations(quotes: DataFrame) -> DataFrame:
    """Checkpoints whose quotes are not exactly 3 or 6, or repeat a direction and notional."""
    out = quotes.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("direction", "notional").alias("different"))
    return out.where(~F.col("n").isin(3, 6) | (F.col("n") != F.col("different")))


def growth_slopes(samples: DataFrame, key: str, now: int, days: Sequence[int]) -> DataFrame:
    """Per series the least-squares slope per day over each trailing window, with one sample before its start."""
    before = Window.partitionBy(key).orderBy("t")
    rows = samples.where(F.col("t") <= now).withColumn("_next", F.lead("t").over(before))
    out = None
    for n in days:
        start = now - n * 86_400
        inside = rows.where((F.col("t") >= start) | (F.coalesce("_next", F.lit(0)) >= start))
        slope = inside.groupBy(key).agg(F.regr_slope(F.col("size").cast("double"), (F.col("t") - start) / 86_400.0).alias(f"slope_{n}d"))
        out = slope if out is None else out.join(slope, key, "full")
    return out


def decoder_coverage(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count_if("decoded").alias("decoded"), F.count_if(~F.col("decoded")).alias("unmatched"), F.avg(F.col("decoded").cast("double")).alias("ratio"))


def classify_finality(error: Column, finalized: Column, known: Column, age_s: Column, limit_s: int) -> Column:
    return F.when(error, "failed").when(finalized, "finalized").when(~known & (age_s > limit_s), "unresolved").otherwise("pending")


def parity_digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (count, two sums of digest halves) that does not depend on the order of rows."""
    name = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
    half = lambda k: F.sum(F.conv(F.substring(name, k, 12), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count(F.lit(1)).alias("n"), half(1).cast("string").alias("digest0"), half(13).cast("string").alias("digest1"))


def portfolio_snapshot(portfolios: DataFrame, events: DataFrame) -> DataFrame:
    """Start plus cash changes, realized gains, and open exposure per portfolio."""
    sums = events.groupBy("portfolio").agg(F.sum("cash_delta").alias("_cash"), F.sum("realized").alias("realized"), F.sum(F.when(F.col("open"), -F.col("cash_delta"))).alias("exposure"), F.count_if("open").alias("positions"))
    return portfolios.join(sums, "portfolio", "left").fillna(0).select("portfolio", (F.col("start") + F.col("_cash")).alias("cash"), "realized", "exposure", "positions")


def affected_episodes(episodes: DataFrame, trades: DataFrame, market: Sequence[str], day: int) -> DataFrame:
    """Episodes that overlap a day, of markets traded on it."""
    touched = trades.where(F.col("slot") == day).select(*market).distinct()
    low, high = day * 86_400, day * 86_400 + 86_399
    return episodes.join(touched, list(market), "left_semi").where((F.col("opened_t") <= high) & (F.coalesce("closed_t", F.lit(high)) >= low))


def top_per_key(rows: DataFrame, key: str, order: Sequence[Column | str], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def signal_fanout(signals: DataFrame, known: DataFrame, destinations: Sequence[str]) -> DataFrame:
    """New signals only, once per destination."""
    return signals.join(known.select("signal_key").distinct(), "signal_key", "left_anti").withColumn("destination", F.explode(F.array(*[F.lit(x) for x in destinations])))


#: Bounds within which a pipeline is ok: rows in its inbox, and ages in seconds.
OK_BACKLOG, OK_READY_S, OK_SIGNAL_S, OK_POOL_S = 100, 3_600, 300, 300


def open_incidents(incidents: DataFrame) -> DataFrame:
    """Open incidents in the order of their start, each with what it means for the evidence; rows, as their number has no bound."""
    return incidents.where("high IS NULL").withColumn("disposition", F.lit("alpha_excluded_unreconciled")).orderBy("low", "program")


def pipeline_status(inbox: DataFrame, queue: DataFrame, signals: DataFrame, deliveries: DataFrame, trades: DataFrame, incidents: DataFrame, strategy: str, version: str, now: int) -> DataFrame:
    """One row: counts and ages of inbox, work queue, signals, deliveries and incidents, and status (ok or degraded).

    inbox: status, type, t; queue: strategy, revision, completed, admission,
    priority, not_before, locked_until, pending_since, failed, quarantined;
    signals: t; deliveries: type, status, version, t; trades: t; incidents: high
    (null: open). Null ages mean that there is no such row; without any pool the
    status is degraded. The size of the storage is not known here.
    """
    pending, work = F.col("revision") > F.col("completed"), queue.where(F.col("strategy") == strategy)
    ready = pending & (F.col("not_before") <= now) & (F.col("locked_until").isNull() | (F.col("locked_until") <= now))
    due = ready & ~F.col("quarantined")
    oldest = lambda c: F.lit(now) - F.min(F.when(c, F.col("pending_since")))
    day = F.col("t") >= now - 86_400
    parts = [
        inbox.agg(F.count_if(F.col("status").isin("pending", "processing", "retry")).alias("backlog"), F.count_if(F.col("status") == "dead_letter").alias("dead_letters"), (F.lit(now) - F.max(F.when(F.col("type") == "pool_created", F.col("t")))).alias("pool_age_s")),
        work.agg(
            F.count_if(pending).alias("pending"), F.count_if(F.col("admission") == "deferred").alias("deferred"), F.count_if(pending & (F.col("admission") == "unchecked")).alias("unchecked"), F.count_if(ready).alias("ready"),
            F.count_if(pending & F.col("failed") & ~F.col("quarantined")).alias("failed"), F.count_if(pending & F.col("quarantined") & (F.col("not_before") > now)).alias("quarantined"),
            *[F.count_if(pending & (F.col("priority") == i)).alias(f"{name}_pending") for i, name in enumerate(("background", "elevated", "signal"))],
            oldest(due).alias("oldest_ready_s"), oldest(due & (F.col("priority") == 2)).alias("oldest_signal_s"),
        ),
        signals.agg(F.count_if(day).alias("signals_24h")),
        deliveries.agg(F.count_if((F.col("type") == "qualified-pool") & (F.col("status") == "delivered") & (F.col("version") == version) & day).alias("pools_24h")),
        trades.agg((F.lit(now) - F.max("t")).alias("trade_age_s")),
        incidents.agg(F.count_if(F.col("high").isNull()).alias("open_incidents")),
    ]
    row, *others = [p.withColumn("_row", F.lit(1)) for p in parts]
    for p in others:
        row = row.join(p, "_row")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    ok = (F.col("backlog") <= OK_BACKLOG) & (F.col("dead_letters") == 0) & (F.col("open_incidents") == 0) & (F.col("failed") == 0) & (none("oldest_ready_s") <= OK_READY_S) & (none("oldest_signal_s") <= OK_SIGNAL_S)
    return row.drop("_row").withColumn("status", F.when(ok & F.coalesce(F.col("pool_age_s") <= OK_POOL_S, F.lit(False)), "ok").otherwise("degraded"))
