"""FIFO position ledgers by window algebra: no per-wallet loop, no pair join.

With running sums over a market's trades in evidence order, the inventory
before each trade is the running sum less its running minimum below zero; sells
are cut to it. Lots are then intervals of the cumulative bought quantity, sells
intervals of the cumulative sold quantity, and the matches are the pieces
between all interval ends. Each piece belongs to the next lot end and the next
sell end, so one sort per market finds all matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import first_by, running

MARKET = ["chain", "strategy", "wallet", "token"]
ORDER = ["slot", "t", "signature", "key"]
COST_PCT = 3.0


def dedupe_trades(trades: DataFrame) -> DataFrame:
    """First row per key in evidence order, then by content."""
    return first_by(trades, ["key"], ["slot", "t", "signature", "wallet", "token", "side", "qty", "value_usd"])


def trade_value(trades: DataFrame) -> DataFrame:
    """value_usd: the quote value if positive, else price times quantity, else null."""
    price = F.when((F.col("price_usd") > 0) & (F.col("qty") > 0), F.col("price_usd") * F.col("qty"))
    return trades.withColumn("value_usd", F.when(F.col("quote_value_usd") > 0, F.col("quote_value_usd")).otherwise(price))


def eligible_markets(trades: DataFrame) -> DataFrame:
    """Rows of markets whose first buy, priced or not, came at a pool age of 0 to 30 minutes."""
    first_age = F.first(F.when(F.col("side") == "buy", F.struct("pool_age_minutes")), ignorenulls=True)
    whole = Window.partitionBy(*MARKET).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return trades.withColumn("_age", first_age.over(whole)["pool_age_minutes"]).where("_age BETWEEN 0 AND 30").drop("_age")


def ledger_rows(trades: DataFrame) -> DataFrame:
    """Usable trades with before and after (inventory), sold (what a sell takes from it), bought_end, sold_end and episode."""
    return inventory_rows(eligible_markets(trades))


def inventory_rows(rows: DataFrame) -> DataFrame:
    """As ledger_rows, of rows whose markets are known to be eligible."""
    return inventory(rows.where("qty > 0 AND value_usd > 0"), F.lit(True))


def inventory(rows: DataFrame, used: Column) -> DataFrame:
    """rows with the columns of ledger_rows, to which only the used rows add; no more than one sort by market."""
    w = running(MARKET, ORDER)
    rows = rows.withColumn("signed", F.when(used & (F.col("side") == "buy"), F.col("qty")).when(used, -F.col("qty")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("level", F.sum("signed").over(w))
    rows = rows.withColumn("floor_", F.least(F.lit(0.0), F.min("level").over(w)))
    rows = rows.withColumn("after", F.col("level") - F.col("floor_"))
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(Window.partitionBy(*MARKET).orderBy(*ORDER)), F.lit(0.0)))
    rows = rows.withColumn("sold", F.when(used & (F.col("side") == "sell"), F.least("qty", "before")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("bought", F.when(used & (F.col("side") == "buy"), F.col("qty")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("starts", (used & (F.col("side") == "buy") & (F.col("before") == 0)).cast("int"))
    return rows.select(
        "*", F.sum("bought").over(w).alias("bought_end"), F.sum("sold").over(w).alias("sold_end"), F.sum("starts").over(w).alias("episode")
    ).drop("signed", "level", "floor_", "starts")


def fifo_match(trades: DataFrame, cost_pct: float = COST_PCT) -> DataFrame:
    """One row per lot and sell that share units: market, lot_key, sell_key, qty, invested, proceeds, times, episode, high_quality."""
    return match_rows(ledger_rows(trades), cost_pct)


def match_rows(rows: DataFrame, cost_pct: float = COST_PCT) -> DataFrame:
    """As fifo_match, of ledger rows."""
    return priced_pieces(_pieces(rows.where("side = 'buy' OR sold > 0")), cost_pct)


def _pieces(rows: DataFrame) -> DataFrame:
    """rows, each the end of a lot's or sell's interval of cumulative quantity, with the piece that ends there: end, from_, lot, sell (null: none)."""
    buy = F.col("side") == "buy"
    own = F.struct("key", "t", "qty", "value_usd", "episode", F.col("data_quality").isin("observed-execution", "oracle-converted").alias("good"))
    rows = rows.withColumns({"end": F.when(buy, F.col("bought_end")).otherwise(F.col("sold_end")), "kind": F.when(buy, 0).otherwise(1), "_own": own})
    # in descending order the next end is the last one seen, so the frame only ever grows; the end before is the next row's
    down = Window.partitionBy(*MARKET).orderBy(F.desc("end"), F.desc("kind"), F.desc("key"))
    back = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("from_", F.coalesce(F.lead("end").over(down), F.lit(0.0)))
    last = lambda of: F.last(F.when(of, F.col("_own")), ignorenulls=True).over(back)
    return rows.withColumns({"lot": last(buy), "sell": last(~buy)}).drop("_own")


def _met() -> tuple[Column, Column]:
    """Whether a lot and a sell share units in a piece, and how many."""
    units = F.col("end") - F.col("from_")
    return (units > 0) & F.col("lot").isNotNull() & F.col("sell").isNotNull(), units


def priced_pieces(pieces: DataFrame, cost_pct: float) -> DataFrame:
    """Pieces from from_ to end with their lot and sell, as rows of fifo_match; empty ones and those without either go."""
    pieces = pieces.withColumn("units", F.col("end") - F.col("from_")).where("units > 0 AND lot IS NOT NULL AND sell IS NOT NULL")
    return pieces.select(
        *MARKET,
        F.col("lot.key").alias("lot_key"),
        F.col("sell.key").alias("sell_key"),
        "units",
        (F.col("lot.value_usd") * (1 + cost_pct / 200) * F.col("units") / F.col("lot.qty")).alias("invested"),
        (F.col("sell.value_usd") * (1 - cost_pct / 200) * F.col("units") / F.col("sell.qty")).alias("proceeds"),
        F.col("lot.t").alias("lot_t"),
        F.col("sell.t").alias("sell_t"),
        F.col("lot.episode").alias("episode"),
        (F.col("lot.good") & F.col("sell.good")).alias("high_quality"),
    )


def realizations(matches: DataFrame) -> DataFrame:
    """One row per sell that closed units."""
    out = matches.groupBy(*MARKET, "sell_key").agg(
        F.min("lot_t").alias("opened_t"),
        F.max("sell_t").alias("closed_t"),
        F.max("episode").alias("episode"),
        F.sum("units").alias("units"),
        F.sum("invested").alias("invested"),
        F.sum("proceeds").alias("proceeds"),
        F.bool_and("high_quality").alias("high_quality"),
    )
    out = out.withColumn("pnl", F.col("proceeds") - F.col("invested"))
    return out.withColumn("return_pct", F.col("pnl") / F.col("invested") * 100)


def episodes(trades: DataFrame, cost_pct: float = COST_PCT) -> DataFrame:
    """One row per round trip: from a buy into an empty inventory until it is empty again.

    One pass over the trades: an interval's end tells of its own round trip, the
    piece that ends there of the lot's, which is another one only where sums of
    quantities are not exact.
    """
    rows = ledger_rows(trades.dropna(subset=MARKET)).where("side = 'buy' OR sold > 0")
    ends = _pieces(rows.withColumn("_place", F.row_number().over(Window.partitionBy(*MARKET).orderBy(*ORDER))))
    buy, (met, units) = F.col("side") == "buy", _met()
    part = {
        "invested": F.when(met, F.col("lot.value_usd") * (1 + cost_pct / 200) * units / F.col("lot.qty")),
        "proceeds": F.when(met, F.col("sell.value_usd") * (1 - cost_pct / 200) * units / F.col("sell.qty")),
        "sell_key": F.when(met, F.col("sell.key")),
        "good": F.when(met, F.col("lot.good") & F.col("sell.good")),
    }
    own = {"bought": buy, "opened_t": F.when(buy, F.col("t")), "after": F.col("after"), "last_t": F.col("t"), "_place": F.col("_place")}
    fields = [*own, *part]

    def told(episode: Column, *kept: dict[str, Column]) -> Column:
        there = {k: v for some in kept for k, v in some.items()}
        return F.struct(episode.alias("episode"), *[there.get(c, F.lit(None)).alias(c) for c in fields])

    away = met & (F.col("lot.episode") != F.col("episode"))
    both = F.array(told(F.col("episode"), own, part))
    rows = ends.select(*MARKET, F.explode(F.when(away, F.array(told(F.col("episode"), own), told(F.col("lot.episode"), part))).otherwise(both)).alias("_e")).select(*MARKET, "_e.*")
    out = rows.groupBy(*MARKET, "episode").agg(
        F.min("opened_t").alias("opened_t"), F.count_if("bought").alias("lots"), F.max_by("after", "_place").alias("open_units"), F.max_by("last_t", "_place").alias("last_t"),
        F.sum("invested").alias("invested"), F.sum("proceeds").alias("proceeds"), F.countDistinct("sell_key").alias("sells"), F.bool_and("good").alias("high_quality"),
    )
    out = out.where("lots > 0")
    out = out.withColumn("status", F.when(F.col("open_units") == 0, "realized").otherwise("open"))
    out = out.withColumn("closed_t", F.when(F.col("open_units") == 0, F.col("last_t"))).drop("last_t")
    out = out.fillna({"invested": 0.0, "proceeds": 0.0, "sells": 0})
    out = out.withColumn("pnl", F.col("proceeds") - F.col("invested"))
    return out.withColumn("return_pct", F.when(F.col("invested") > 0, F.col("pnl") / F.col("invested") * 100))


def lots(trades: DataFrame, cost_pct: float = COST_PCT) -> DataFrame:
    """One row per buy: units left, status, cost, and the sells that closed it. One pass over the trades."""
    ends = _pieces(ledger_rows(trades).where("side = 'buy' OR sold > 0"))
    met, units = _met()
    bought = F.when(F.col("side") == "buy", F.struct("key", F.struct(F.col("t").alias("lot_t"), "qty", F.col("value_usd").alias("v")).alias("lot")))
    sold = F.when(met, F.struct(F.col("lot.key").alias("key"), F.struct(units.alias("units"), F.col("sell.t").alias("sell_t"), F.col("sell.key").alias("sell_key")).alias("part")))
    told = lambda key, lot, part: F.struct(key.alias("lot_key"), lot.alias("_lot"), part.alias("_part"))
    one = told(bought["key"], bought["lot"], sold["part"])
    two = F.filter(F.array(told(bought["key"], bought["lot"], F.when(F.lit(False), sold["part"])), told(sold["key"], F.when(F.lit(False), bought["lot"]), sold["part"])), lambda x: x["_lot"].isNotNull() | x["_part"].isNotNull())
    rows = ends.select(*MARKET, F.explode(F.when(bought["key"] == sold["key"], F.array(one)).otherwise(two)).alias("_e")).select(*MARKET, "_e.*")
    used = rows.groupBy(*MARKET, "lot_key").agg(
        F.collect_list("_lot").alias("_lots"), F.sum("_part.units").alias("closed_units"), F.max("_part.sell_t").alias("last_sell_t"), F.sort_array(F.collect_list("_part.sell_key")).alias("sell_keys"), F.count("_part").alias("_n")
    )
    # buys of one key share their sells; without any there is no list
    out = used.select(*MARKET, "lot_key", F.explode("_lots").alias("_lot"), "closed_units", "last_sell_t", F.when(F.col("_n") > 0, F.col("sell_keys")).alias("sell_keys"))
    out = out.select(*MARKET, "lot_key", "_lot.*", "closed_units", "last_sell_t", "sell_keys")
    out = out.withColumn("remaining", F.col("qty") - F.coalesce("closed_units", F.lit(0.0)))
    out = out.withColumn("status", F.when(F.col("remaining") == 0, "realized").when(F.col("closed_units") > 0, "partially-realized").otherwise("open"))
    out = out.withColumn("cost", F.col("v") * (1 + cost_pct / 200)).withColumn("remaining_cost", F.col("cost") * F.col("remaining") / F.col("qty"))
    return out.withColumn("closed_t", F.when(F.col("remaining") == 0, F.col("last_sell_t"))).drop("v", "closed_units", "last_sell_t")


def open_inventory(lot_rows: DataFrame) -> DataFrame:
    """Units, cost and lots still open per market."""
    return lot_rows.where("remaining > 0").groupBy(*MARKET).agg(F.sum("remaining").alias("units"), F.sum("remaining_cost").alias("cost"), F.count(F.lit(1)).alias("lots"))
