"""Ledgers that go on from a carried state, and the rows that must not be continued from it.

What is carried: per wallet the last trade in evidence order and the cost model;
per market whether its first buy is known and at which pool age, its number of
round trips and its decimals; and the open lots. A wallet whose new trades all lie
behind its last one goes on from its open lots, taken as buys of what is left of
them; its history is not read. A wallet with a late trade, with one that it had
before (the same or a corrected one), with another cost model or with a market of
more decimals than carried is built anew from its whole history; only the history
of such wallets is read. Both ways give the rows of the full ledger.

A trade that repeats a key within the new ones counts once, the first in evidence
order; a corrected trade takes the place of the earlier one. Trades without
decimals have none.

Whole trades are dealt once, by market: keys meet by their hashes, and only trades
whose hash is met twice are compared; only wallets whose new trades may be late or
finer are classed trade by trade; open lots, what is known of a market and its new
trades go through one pass, from which realized sells and the new state are taken.
History and new trades are read several times, so they should be tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import tasks_for
from tidemark.functions.scratch import stored
from tidemark.operators.ledger import COST_PCT, MARKET, ORDER, dedupe_trades, inventory, match_rows, realizations

WALLET = ["chain", "strategy", "wallet"]
CONTENT = ["side", "qty", "value_usd", "pool_age_minutes", "data_quality"]
TRADE = [*MARKET, *ORDER, *CONTENT, "decimals"]


@dataclass(frozen=True)
class Carried:
    """wallets (last, cost_pct), markets (has_buy, first_age, episode, decimals), lots (what is open) and the wallets that were continued, rebuilt or started."""

    wallets: DataFrame
    markets: DataFrame
    lots: DataFrame


@dataclass(frozen=True)
class Advance:
    """realized: new sells of continued wallets and all sells of rebuilt or started ones; modes: how each touched wallet was taken; carried: the new state, written when it is first asked for."""

    realized: DataFrame
    modes: DataFrame
    state: Callable[[], Carried]

    @cached_property
    def carried(self) -> Carried:
        return self.state()


def _order() -> Column:
    return F.struct(*ORDER)


def _hash() -> Column:
    return F.xxhash64("key").alias("_hash")


def _content() -> Column:
    return F.struct(*MARKET, *ORDER, *CONTENT)


def _whole(trades: DataFrame) -> DataFrame:
    return (trades if "decimals" in trades.columns else trades.withColumn("decimals", F.lit(0))).select(*TRADE)


def _trades(trades: DataFrame) -> DataFrame:
    """The trades, of those that share a key the first one. Only trades whose hash is met twice are dealt by key."""
    rows = _whole(trades)
    often = stored(rows.select(_hash()).repartition("_hash").groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_hash"))
    if often.isEmpty():
        return rows
    marked = rows.withColumn("_hash", _hash()).join(often.withColumn("_often", F.lit(True)), "_hash", "left").drop("_hash")
    return marked.where("_often IS NULL").drop("_often").unionByName(dedupe_trades(marked.where("_often").drop("_often")))


def _known(rows: DataFrame, history: DataFrame) -> DataFrame:
    """key and content (_old) of the trades of history whose keys rows may hold: their hashes meet."""
    sides = history.select(_hash(), F.lit(0).alias("_side")).unionByName(rows.select(_hash(), F.lit(1).alias("_side"))).repartition("_hash")
    meet = stored(sides.groupBy("_hash").agg(F.min("_side").alias("low"), F.max("_side").alias("high")).where("low < high").select("_hash"))
    met = _whole(history).withColumn("_hash", _hash()).join(meet, "_hash", "left_semi")
    return stored(dedupe_trades(met.drop("_hash")).select("key", _content().alias("_old")))


def _ledger(trades: DataFrame, n: int, lots: DataFrame | None = None, markets: DataFrame | None = None) -> DataFrame:
    """Ledger rows of about n trades, or of open lots and the trades behind them, with remaining and remaining_value of what is left of a buy, and on the market's last row its state (end).

    Markets keep their first buy and count round trips on. One exchange, by market; not all rows are used.
    """
    known = "struct<has_buy: boolean, first_age: double, episode: bigint, decimals: int>"
    rows = trades.select(*TRADE, F.lit(0).alias("_lot"), F.lit(None).cast(known).alias("_known"))
    if lots is not None:
        bought = [F.lit("buy").alias("side"), F.col("remaining").alias("qty"), F.col("remaining_value").alias("value_usd"), F.lit(0.0).alias("pool_age_minutes")]
        rows = rows.unionByName(lots.select(*MARKET, *ORDER, *bought, "data_quality", "decimals", F.lit(1).alias("_lot"), F.lit(None).cast(known).alias("_known")))
        nothing = [F.lit(None).alias(c) for c in (*ORDER, *CONTENT, "decimals")]
        rows = rows.unionByName(markets.select(*MARKET, *nothing, F.lit(0).alias("_lot"), F.struct("has_buy", "first_age", "episode", "decimals").cast(known).alias("_known")))
    tasks = tasks_for(rows.sparkSession, n)
    rows = rows if tasks is None else rows.repartition(tasks, *MARKET)
    turn = Window.partitionBy(*MARKET).orderBy(*ORDER)
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    trade = F.col("_known").isNull() & (F.col("_lot") == 0)
    rows = rows.withColumns(
        {
            "_first": F.first(F.when(trade & (F.col("side") == "buy"), F.struct("pool_age_minutes")), ignorenulls=True).over(whole),
            "_before": F.first("_known", ignorenulls=True).over(whole),
            "_held": F.max("_lot").over(whole),
            "_finest": F.max("decimals").over(whole),
            "_last": F.lead(F.lit(1)).over(turn).isNull(),
        }
    )
    rows = rows.withColumn("_age", F.when(F.col("_before.has_buy"), F.col("_before.first_age")).otherwise(F.col("_first.pool_age_minutes")))
    used = F.coalesce((F.col("_age") >= 0) & (F.col("_age") <= 30) & (F.col("qty") > 0) & (F.col("value_usd") > 0), F.lit(False))
    rows = inventory(rows.withColumn("used", used), F.col("used"))
    # a market that holds lots is still in its last round trip
    rows = rows.withColumn("episode", F.coalesce(F.col("episode"), F.lit(0)) + F.coalesce("_before.episode", F.lit(0)) - F.col("_held"))
    # units are sold in the order of the running purchases
    left = F.least("qty", F.greatest(F.lit(0.0), F.col("bought_end") - F.sum("sold").over(whole)))
    rows = rows.withColumn("remaining", F.when(F.col("used") & (F.col("side") == "buy"), left))
    part = F.when(F.col("remaining") == F.col("qty"), F.col("value_usd")).otherwise(F.col("value_usd") * F.col("remaining") / F.col("qty"))
    has_buy = F.coalesce("_before.has_buy", F.lit(False)) | F.col("_first").isNotNull()
    end = F.struct(has_buy.alias("has_buy"), F.col("_age").alias("first_age"), F.col("episode").cast("long").alias("episode"), F.greatest("_finest", "_before.decimals").alias("decimals"), trade.alias("traded"))
    return rows.withColumns({"remaining_value": part, "end": F.when(F.col("_last"), end)})


def _state(rows: DataFrame, cost_pct: float) -> Carried:
    """The state that ledger rows leave: open lots, the ends of markets, and their wallets; one table."""
    lot = [*MARKET, *ORDER, "remaining", "remaining_value", "data_quality", "decimals", "episode"]
    rows = stored(rows.where("remaining > 0 OR end IS NOT NULL").select(*lot, "end"))
    wallets = rows.where("end.traded").groupBy(*WALLET).agg(F.max(_order()).alias("last")).withColumn("cost_pct", F.lit(float(cost_pct)))
    markets = rows.where("end IS NOT NULL").select(*MARKET, "end.has_buy", "end.first_age", "end.episode", "end.decimals")
    return Carried(wallets, markets, rows.where("remaining > 0").select(*lot))


def carry(trades: DataFrame, cost_pct: float = COST_PCT) -> Carried:
    """The state after all of the trades."""
    return _state(_ledger(_trades(trades), trades.count()), cost_pct)


def classify(carried: Carried, delta: DataFrame, history: DataFrame) -> DataFrame:
    """delta with kind: new, late (before the wallet's last trade), repeated, corrected (a known key), or precision (more decimals than its market had)."""
    rows = _trades(delta)
    return _classes(carried, rows, _known(rows, history))


def _classes(carried: Carried, rows: DataFrame, known: DataFrame) -> DataFrame:
    rows = rows.join(carried.wallets.select(*WALLET, "last"), WALLET, "left").join(carried.markets.select(*MARKET, F.col("decimals").alias("_decimals")), MARKET, "left").join(known, "key", "left")
    late = F.coalesce(_order() <= F.col("last"), F.lit(False))
    kind = (
        F.when(F.col("_old").isNotNull() & F.col("_old").eqNullSafe(_content()), "repeated")
        .when(F.col("_old").isNotNull(), "corrected")
        .when(late, "late")
        .when(F.col("decimals") > F.col("_decimals"), "precision")
        .otherwise("new")
    )
    return rows.withColumn("kind", kind).select(*TRADE, "kind")


def _modes(carried: Carried, rows: DataFrame, known: DataFrame, cost_pct: float) -> DataFrame:
    """(wallet, mode) of the wallets with new trades or with another cost model."""
    slot = lambda x: F.coalesce(x, F.lit(-(2**63)))
    touched = stored(rows.groupBy(*WALLET).agg(F.min(slot(F.col("slot"))).alias("_slot"), F.max("decimals").alias("_finest")))
    least = carried.markets.groupBy(*WALLET).agg(F.min("decimals").alias("_least"))
    # a wallet whose new trades all lie behind its last slot, no finer than any market of its own and of unknown keys, has only new ones
    doubt = touched.join(carried.wallets, WALLET).join(least, WALLET, "left").where((F.col("_slot") <= slot(F.col("last.slot"))) | (F.col("_finest") > F.col("_least"))).select(*WALLET)
    doubt = stored(doubt.unionByName(rows.join(known.select("key"), "key", "left_semi").select(*WALLET)).distinct())
    of = lambda x: x.join(doubt, WALLET, "left_semi")
    classes = _classes(Carried(of(carried.wallets), of(carried.markets), of(carried.lots)), of(rows), known)
    odd = classes.groupBy(*WALLET).agg(F.bool_or(F.col("kind") != "new").alias("odd"))
    told = touched.join(odd, WALLET, "left").select(*WALLET, F.coalesce("odd", F.lit(False)).alias("odd"))
    wallets = carried.wallets.select(*WALLET, (F.col("cost_pct") != cost_pct).alias("dear")).join(told, WALLET, "full")
    mode = F.when(F.col("odd") | F.col("dear"), "rebuilt").when(F.col("dear").isNull(), "started").when(F.col("odd").isNotNull(), "continued")
    return wallets.withColumn("mode", mode).where("mode IS NOT NULL").select(*WALLET, "mode")


def advance(carried: Carried, delta: DataFrame, history: DataFrame, cost_pct: float = COST_PCT) -> Advance:
    """The ledgers after delta; history holds the trades before it and is read for repeated keys and for wallets to rebuild."""
    fresh = _trades(delta)
    known = _known(fresh, history)
    modes = stored(_modes(carried, fresh, known, cost_pct))
    of = lambda mode, rows: rows.join(modes.where(mode).select(*WALLET), WALLET, "left_semi")
    going, whole = "mode = 'continued'", "mode <> 'continued'"
    # wallets to build anew, or for the first time
    old, new = of(whole, _whole(history)), of(whole, fresh)
    if not known.isEmpty():
        old = old.join(stored(new.join(known, "key", "left_semi").select("key")), "key", "left_anti")
    trades = _trades(old.unionByName(new))
    # wallets that go on: only open lots, markets and the new trades are read
    rows = _ledger(trades.unionByName(of(going, fresh)), history.count() + delta.count(), of(going, carried.lots), of(going, carried.markets))

    def state() -> Carried:
        # wallets without news stay as they are
        still = lambda x: x.join(modes.select(*WALLET), WALLET, "left_anti")
        after = _state(rows, cost_pct)
        return Carried(*(still(a).unionByName(b) for a, b in ((carried.wallets, after.wallets), (carried.markets, after.markets), (carried.lots, after.lots))))

    return Advance(realizations(match_rows(rows.where("used"), cost_pct)), modes, state)
