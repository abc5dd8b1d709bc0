"""FIFO ledgers of markets too large for one task.

A market with more than its share of the trades is cut, in evidence order, to
blocks of about equal size, whose bounds are found before the rows are dealt, so
that they are dealt once. Each block scans its own rows; one row per block and
market carries what the blocks before it left (inventory, running minimum,
bought, sold, episodes), and is added afterwards. The matches are found the same
way in order of cumulative quantity: a block takes the end before it and the next
lot and sell after it from its neighbours, which the bounds tell beforehand.
All other markets go the plain way. Rows are the same as without blocks;
quantities whose sums doubles cannot hold may differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.common import running, tasks_for
from tidemark.functions.scratch import stored
from tidemark.operators import ledger as L

#: A market is cut if it has more trades than this and more than one in ``PARTS`` of all.
HOT_ROWS = 1_000_000
PARTS = 4096
BLOCK = [*L.MARKET, "block"]
#: Places looked at to bound a block, and blocks to a task where the session's number of tasks would not do.
PLACES = 100
BLOCKS = 4


def hot_markets(trades: DataFrame, hot_rows: int = HOT_ROWS, parts: int = PARTS) -> DataFrame:
    """Markets of more than ``hot_rows`` trades and more than one in ``parts`` of all, with their number: fewer than ``parts`` rows."""
    seen = Observation()
    counts = trades.groupBy(*L.MARKET).agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("all"))
    large = stored(counts.where(F.col("n") > hot_rows))
    return large.where(F.col("n") * parts > (seen.get["all"] or 0)).select(*L.MARKET, "n")


def carried(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns that small, one row per keys of bounded number, holds for them; null keys meet."""
    named = small.withColumnsRenamed({k: f"_{k}" for k in keys})
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(F.broadcast(named), same, "left").drop(*[f"_{k}" for k in keys])


def held(small: DataFrame) -> DataFrame:
    """small, of a row per block and market, worked out once and held by the driver, as it is broadcast several times."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def in_blocks(rows: DataFrame, order: Sequence[str], n: int | None = None) -> DataFrame:
    """rows, about n, with their block: ranges of (market, order), so that a market's blocks ascend with its order and equal places share one."""
    spark, keys = rows.sparkSession, [*L.MARKET, *order]
    n = rows.count() if n is None else n
    tasks = tasks_for(spark, n)
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions")) if tasks is None else BLOCKS * tasks
    places = rows.select(*keys).sample(min(1.0, PLACES * blocks / max(n, 1)), 7).repartition(1).sortWithinPartitions(*keys).collect()
    kinds = dict(rows.select(*keys).dtypes)
    bounds = [places[i * len(places) // blocks] for i in range(1, blocks) if places]
    if not bounds:
        return rows.withColumn("block", F.lit(0))
    bounds = F.array(*[F.struct(*[F.lit(b[k]).cast(kinds[k]).alias(k) for k in keys]) for b in bounds])
    # halving steps count the bounds at or before a row
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(blocks.bit_length()))])
    count = lambda place: F.aggregate(steps, F.lit(0), lambda low, step: low + F.when(place >= F.get(bounds, low + step - 1), step).otherwise(0))
    # as an element of an array the row's place is put together once, not at each step
    return rows.withColumn("block", F.transform(F.array(F.struct(*keys)), count)[0])


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """n rows dealt by their blocks."""
    tasks = tasks_for(rows.sparkSession, n)
    return rows.repartition("block") if tasks is None else rows.repartition(tasks, "block")


def _before(column: Column) -> Column:
    """column, an aggregate, over the market's earlier blocks."""
    return column.over(Window.partitionBy(*L.MARKET).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))


def block_ledger_rows(trades: DataFrame, columns: Sequence[str] | None = None, n: int | None = None) -> DataFrame:
    """As ledger.ledger_rows, with these columns of the n trades or all. Blocks and markets make at most shuffle partitions + markets rows, which are broadcast; markets must be few."""
    buys = trades.where("side = 'buy'")
    age = buys.groupBy(*L.MARKET).agg(F.min_by("pool_age_minutes", F.struct(*L.ORDER)).alias("_age"))
    rows = carried(trades, age, L.MARKET).where("_age BETWEEN 0 AND 30 AND qty > 0 AND value_usd > 0").drop("_age")
    buy, w, own = F.col("side") == "buy", running(BLOCK, L.ORDER), Window.partitionBy(*BLOCK).orderBy(*L.ORDER)
    columns = trades.columns if columns is None else columns
    n = trades.count() if n is None else n
    rows = _dealt(in_blocks(rows.select(*dict.fromkeys([*columns, *L.ORDER])), L.ORDER, n), n).withColumn("_level", F.sum(F.when(buy, F.col("qty")).otherwise(-F.col("qty"))).over(w))
    rows = rows.withColumn("_low", F.min("_level").over(w)).withColumn("_last", F.lead(F.lit(1)).over(own).isNull())
    rows = rows.withColumn("_level_before", F.coalesce(F.lag("_level").over(own), F.lit(0.0))).withColumn("_low_before", F.lag("_low").over(own))
    # buys at the lowest level of the block so far: whether they start an episode follows from what came before the block
    rows = rows.withColumn("_lowest", buy & (F.col("_level_before") <= F.least(F.lit(0.0), "_low_before")))
    sums = {"_bought": F.when(buy, F.col("qty")).otherwise(F.lit(0.0)), "_starts": F.col("_lowest").cast("long")}
    told = ["block", "_last", "_level", "_low", "_level_before", "_low_before", "_lowest"]
    local = stored(rows.select(*columns, *told, *[F.sum(x).over(w).alias(c) for c, x in sums.items()]))
    ends = local.groupBy(*BLOCK).agg(F.max(F.when(F.col("_last"), F.col("_level"))).alias("change"), F.min("_low").alias("low"), F.max("_bought").alias("bought"))
    ends = ends.withColumn("_base", F.coalesce(_before(F.sum("change")), F.lit(0.0))).withColumn("least", F.col("_base") + F.col("low"))
    ends = ends.withColumn("_floor", F.least(F.lit(0.0), _before(F.min("least")))).withColumn("_bought_base", F.coalesce(_before(F.sum("bought")), F.lit(0.0)))
    ends = held(ends.select(*BLOCK, "_base", "_floor", "_bought_base"))
    # the lowest levels only fall, so those above the floor are the block's first
    above = F.col("_lowest") & (F.col("_base") + F.col("_level_before") > F.col("_floor"))
    starts = carried(local.select(*BLOCK, "_lowest", "_level_before"), ends, BLOCK).groupBy(*BLOCK).agg(F.count_if(above).alias("_above"), F.count_if(F.col("_lowest") & ~above).alias("n"))
    starts = held(starts.select(*BLOCK, "_above", F.coalesce(_before(F.sum("n")), F.lit(0)).alias("_episodes")))

    def inventory(level: Column, low: Column) -> Column:
        # least passes over the null low of a block's first row
        return F.col("_base") + level - F.least("_floor", F.col("_base") + low)

    rows = carried(carried(local, ends, BLOCK), starts, BLOCK).withColumn("after", inventory(F.col("_level"), F.col("_low")))
    rows = rows.withColumn("before", inventory(F.col("_level_before"), F.col("_low_before")))
    rows = rows.withColumn("sold", F.when(~buy, F.least("qty", "before")).otherwise(F.lit(0.0))).withColumn("bought_end", F.col("_bought_base") + F.col("_bought"))
    # what was bought and is not there was sold
    rows = rows.withColumn("sold_end", F.col("bought_end") - F.col("after"))
    rows = rows.withColumn("episode", F.col("_episodes") + F.greatest(F.lit(0), F.col("_starts") - F.col("_above")))
    return rows.select(*columns, "after", "before", "sold", "bought_end", "sold_end", "episode")


def block_match_rows(rows: DataFrame, cost_pct: float = L.COST_PCT, n: int | None = None) -> DataFrame:
    """As ledger.match_rows, of the n ledger rows of few markets."""
    n = rows.count() if n is None else n
    buy, own = F.col("buy"), F.struct("key", "t", "qty", "value_usd", "episode", "good")
    ends = rows.where("side = 'buy' OR sold > 0").withColumn("buy", F.col("side") == "buy")
    good = F.col("data_quality").isin("observed-execution", "oracle-converted").alias("good")
    ends = in_blocks(ends.select(*L.MARKET, F.when(buy, F.col("bought_end")).otherwise(F.col("sold_end")).alias("end"), "buy", "key", "t", "qty", "value_usd", "episode", good), ["end"], n)
    # what a block's neighbours must know of it: its last end, and its first lot and sell, which are looked up by their ends
    firsts = held(ends.groupBy(*BLOCK).agg(F.max("end").alias("last"), F.min(F.when(buy, F.col("end"))).alias("_lot_end"), F.min(F.when(~buy, F.col("end"))).alias("_sell_end")))
    found = carried(ends, firsts, BLOCK).where(F.col("end") == F.when(buy, F.col("_lot_end")).otherwise(F.col("_sell_end")))
    found = found.groupBy(*BLOCK).agg(F.first("last").alias("last"), F.min_by(own, F.when(buy, F.struct("key"))).alias("lot"), F.min_by(own, F.when(~buy, F.struct("key"))).alias("sell"))
    later = Window.partitionBy(*L.MARKET).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    small = found.select(
        *BLOCK, _before(F.max("last")).alias("_from"), F.last("lot", ignorenulls=True).over(later).alias("_lot"), F.last("sell", ignorenulls=True).over(later).alias("_sell")
    )
    # in descending order the next end is the last one seen; the end before is the next row's
    down = Window.partitionBy(*BLOCK).orderBy(F.desc("end"), F.col("buy"), F.desc("key"))
    back = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda of: F.last(F.when(of, own), ignorenulls=True).over(back)
    local = _dealt(ends, n).select(*BLOCK, "end", F.lead("end").over(down).alias("from_"), last(buy).alias("next_lot"), last(~buy).alias("next_sell"))
    pieces = carried(local, held(small), BLOCK)
    pieces = pieces.withColumn("from_", F.coalesce("from_", "_from", F.lit(0.0)))
    pieces = pieces.withColumn("lot", F.coalesce("next_lot", "_lot")).withColumn("sell", F.coalesce("next_sell", "_sell"))
    return L.priced_pieces(pieces, cost_pct)


def fifo_match(trades: DataFrame, cost_pct: float = L.COST_PCT, hot_rows: int = HOT_ROWS, parts: int = PARTS) -> DataFrame:
    """As ledger.fifo_match, whatever share of the trades one market has.

    Nulls in the market's columns are values of their own. Trades without
    quantity or value take no part. An empty table gives no rows. The hot
    markets are found when this is called, by one count over the trades, which
    are read several times and should be a table. Hot markets go by their number.
    """
    hot = hot_markets(trades, hot_rows, parts)
    if hot.isEmpty():
        return L.fifo_match(trades, cost_pct)
    n = hot.agg(F.sum("n")).first()[0]
    hot = stored(hot.select(*L.MARKET, F.row_number().over(Window.orderBy(*L.MARKET)).cast("string").alias("_hot")))
    marked = carried(trades, hot, L.MARKET)
    plain = L.fifo_match(marked.where("_hot IS NULL").drop("_hot"), cost_pct)
    kinds = dict(trades.dtypes)
    number = {c: F.lit(None).cast(kinds[c]) for c in L.MARKET} | {"token": F.col("_hot")}
    large = block_ledger_rows(marked.where("_hot IS NOT NULL").withColumns(number).drop("_hot"), [*L.MARKET, "key", "t", "side", "qty", "value_usd", "data_quality"], n)
    large = block_match_rows(large, cost_pct, n).drop(*L.MARKET[:-1]).withColumnRenamed("token", "_hot").join(F.broadcast(hot), "_hot")
    return plain.unionByName(large.drop("_hot"))
