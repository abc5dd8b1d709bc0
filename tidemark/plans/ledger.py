"""Registered queries over position ledgers, each with the same result as DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions.common import steady
from tidemark.functions.scratch import stored
from tidemark.operators import continuation as K
from tidemark.operators import hot_markets as H
from tidemark.operators import ledger as L
from tidemark.sources import adapters as A

MARKET = "chain, strategy, wallet, token"
#: The oracle matches lots and sells by joining their intervals, another way than the operator's.
LEDGER = f"""led0 AS (
  SELECT *, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER w AS level FROM trades
  WINDOW w AS (PARTITION BY {MARKET} ORDER BY slot, t, signature, key ROWS UNBOUNDED PRECEDING)
), led1 AS (
  SELECT *, level - least(0, min(level) OVER w) AS after_ FROM led0
  WINDOW w AS (PARTITION BY {MARKET} ORDER BY slot, t, signature, key ROWS UNBOUNDED PRECEDING)
), led2 AS (
  SELECT *, coalesce(lag(after_) OVER (PARTITION BY {MARKET} ORDER BY slot, t, signature, key), 0) AS before_ FROM led1
), led3 AS (
  SELECT *, CASE WHEN side = 'sell' THEN least(qty, before_) ELSE 0 END AS sold FROM led2
), led AS (
  SELECT *, sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) OVER w AS bought_end, sum(sold) OVER w AS sold_end,
    sum(CASE WHEN side = 'buy' AND before_ = 0 THEN 1 ELSE 0 END) OVER w AS episode FROM led3
  WINDOW w AS (PARTITION BY {MARKET} ORDER BY slot, t, signature, key ROWS UNBOUNDED PRECEDING)
), matches AS (
  SELECT b.chain, b.strategy, b.wallet, b.token, b.key AS lot_key, s.key AS sell_key, b.t AS lot_t, s.t AS sell_t, b.episode,
    least(b.bought_end, s.sold_end) - greatest(b.bought_end - b.qty, s.sold_end - s.sold) AS units,
    b.value_usd * 1.015 * (least(b.bought_end, s.sold_end) - greatest(b.bought_end - b.qty, s.sold_end - s.sold)) / b.qty AS invested,
    s.value_usd * 0.985 * (least(b.bought_end, s.sold_end) - greatest(b.bought_end - b.qty, s.sold_end - s.sold)) / s.qty AS proceeds,
    b.data_quality = 'observed-execution' AND s.data_quality = 'observed-execution' AS high_quality
  FROM led b JOIN led s ON b.wallet = s.wallet AND b.token = s.token AND b.side = 'buy' AND s.sold > 0
    AND b.bought_end - b.qty < s.sold_end AND s.sold_end - s.sold < b.bought_end
)"""
REAL = f"""real AS (
  SELECT {MARKET}, sell_key, min(lot_t) AS opened_t, max(sell_t) AS closed_t, max(episode) AS episode, sum(units) AS units, sum(invested) AS invested,
    sum(proceeds) AS proceeds, bool_and(high_quality) AS high_quality FROM matches GROUP BY {MARKET}, sell_key)"""
EPISODES = f"""last_rows AS (
  SELECT {MARKET}, episode, after_ AS open_units, t AS last_t FROM (SELECT *, row_number() OVER (PARTITION BY {MARKET}, episode ORDER BY slot DESC, t DESC, signature DESC, key DESC) AS n
    FROM led WHERE side = 'buy' OR sold > 0) WHERE n = 1
), shape AS (
  SELECT {MARKET}, episode, min(t) AS opened_t, count(*) AS lots FROM led WHERE side = 'buy' GROUP BY {MARKET}, episode
), money AS (
  SELECT {MARKET}, episode, sum(invested) AS invested, sum(proceeds) AS proceeds, count(DISTINCT sell_key) AS sells, bool_and(high_quality) AS high_quality FROM matches GROUP BY {MARKET}, episode
), episodes AS (
  SELECT s.chain, s.strategy, s.wallet, s.token, s.episode, s.opened_t, s.lots, l.open_units, CASE WHEN l.open_units = 0 THEN l.last_t END AS closed_t,
    CASE WHEN l.open_units = 0 THEN 'realized' ELSE 'open' END AS status, coalesce(m.invested, 0) AS invested, coalesce(m.proceeds, 0) AS proceeds,
    coalesce(m.sells, 0) AS sells, m.high_quality, CASE WHEN m.invested > 0 THEN (m.proceeds - m.invested) / m.invested * 100 END AS return_pct
  FROM shape s JOIN last_rows l USING (chain, strategy, wallet, token, episode) LEFT JOIN money m USING (chain, strategy, wallet, token, episode))"""
BASE = A.with_views(A.TRADES, LEDGER)


def _round(df, *names):
    return df.withColumns({n: steady(F.col(n)) for n in names})


def b2(spark, d):
    rows = L.dedupe_trades(A.trades(spark, d, short_key=True))
    return rows.select("key", "slot", "signature", "wallet", "token", "side", "qty", "value_usd")


def b11(spark, d):
    lines = A.table(spark, d, "lineitem")
    quote = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).when(F.col("l_linenumber") % 3 == 1, F.lit(0.0)).otherwise(F.col("l_extendedprice"))
    price = F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice") / F.col("l_quantity"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("qty"), quote.cast("double").alias("quote_value_usd"), price.alias("price_usd"))
    return _round(L.trade_value(rows), "value_usd").select("l_orderkey", "l_linenumber", "l_partkey", "value_usd")


def e1(spark, d):
    return _round(L.fifo_match(A.trades(spark, d)), "invested", "proceeds").select("wallet", "token", "lot_key", "sell_key", "units", "invested", "proceeds", "high_quality")


#: Of a market with more trades than this, the tables' blocks are cut.
HOT_ROWS = 2_000


def e1_hot(spark, d):
    """The matches if nine in ten suppliers trade as one wallet in one token: a market with most of the trades."""
    alone = F.col("wallet").endswith("0")
    rows = A.trades(spark, d).withColumn("token", F.when(alone, F.col("token")).otherwise("pooled")).withColumn("wallet", F.when(alone, F.col("wallet")).otherwise("desk"))
    return _round(H.fifo_match(stored(rows), hot_rows=HOT_ROWS), "invested", "proceeds").select("wallet", "token", "lot_key", "sell_key", "units", "invested", "proceeds", "high_quality")


def e2(spark, d):
    rows = L.realizations(L.fifo_match(A.trades(spark, d)))
    return _round(rows, "invested", "proceeds", "return_pct").select("wallet", "token", "sell_key", "opened_t", "closed_t", "units", "invested", "proceeds", "return_pct", "high_quality")


def e3(spark, d):
    rows = L.episodes(A.trades(spark, d))
    return _round(rows, "invested", "proceeds", "return_pct").select("wallet", "token", "episode", "opened_t", "closed_t", "lots", "sells", "status", "invested", "proceeds", "return_pct", "high_quality")


def e4(spark, d):
    rows = L.lots(A.trades(spark, d))
    return _round(rows, "cost", "remaining_cost").select("wallet", "token", "lot_key", "qty", "remaining", "status", "cost", "remaining_cost", "closed_t", F.coalesce(F.size("sell_keys"), F.lit(0)).alias("n_sells"))


def e5(spark, d):
    return _round(L.open_inventory(L.lots(A.trades(spark, d))), "cost").select("wallet", "token", "units", "cost", "lots")


#: The first part of the trades: shipped up to this day, but for orders of the last order day, which arrive late.
CUT = 10_900


def _parts(spark, d):
    """(history, delta) of the trades."""
    orders = A.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("signature"), "o_orderdate")
    last_day = orders.agg(F.max("o_orderdate").alias("last_day"))
    last = orders.join(F.broadcast(last_day), F.col("o_orderdate") == F.col("last_day")).select("signature").distinct().withColumn("late", F.lit(True))
    # one day's orders as a table, whose size is known before the trades are dealt for a join with it
    rows = A.trades(spark, d).join(stored(last), "signature", "left").withColumn("early", (F.col("slot") <= CUT) & F.col("late").isNull()).drop("late")
    rows = stored(rows)
    return rows.where("early").drop("early"), rows.where("NOT early").drop("early")


def _advanced(spark, d):
    """The ledgers advanced by delta; suppliers of nation 3 were carried with another cost model."""
    history, delta = _parts(spark, d)
    carried = K.carry(history)
    dear = A.table(spark, d, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("w"), "s_suppkey").alias("wallet"), F.lit(2.0).alias("dear"))
    wallets = carried.wallets.join(dear, "wallet", "left").withColumn("cost_pct", F.coalesce("dear", "cost_pct")).drop("dear")
    return K.advance(replace(carried, wallets=wallets), delta, history)


def e6(spark, d):
    """What the advance realizes, with how each wallet was taken."""
    out = _advanced(spark, d)
    rows = out.realized.join(out.modes, K.WALLET)
    return _round(rows, "invested", "proceeds").select("wallet", "token", "sell_key", "mode", "episode", "opened_t", "units", "invested", "proceeds", "high_quality")


def e6_lots(spark, d):
    """The open lots that are carried on after the advance."""
    return _round(_advanced(spark, d).carried.lots, "remaining_value").select("wallet", "token", F.col("key").alias("lot_key"), "remaining", "remaining_value", "episode")


ADVANCE = f"""arrived AS (
  SELECT *, NOT (slot <= {CUT} AND o_orderdate < (SELECT max(o_orderdate) FROM orders)) AS in_delta FROM trades JOIN orders ON signature = CAST(o_orderkey AS VARCHAR)
), last_seen AS (
  SELECT wallet, max((slot, t, signature, key)) AS last FROM arrived WHERE NOT in_delta GROUP BY wallet
), wallet_modes AS (
  SELECT wallet, CASE WHEN bool_or(l.last IS NOT NULL AND (slot, t, signature, key) <= l.last) OR wallet IN (SELECT 'w' || s_suppkey FROM supplier WHERE s_nationkey = 3) AND max(l.last) IS NOT NULL
    THEN 'rebuilt' WHEN max(l.last) IS NULL THEN 'started' ELSE 'continued' END AS mode FROM arrived LEFT JOIN last_seen l USING (wallet) WHERE in_delta GROUP BY wallet
  UNION ALL SELECT wallet, 'rebuilt' FROM last_seen WHERE wallet IN (SELECT 'w' || s_suppkey FROM supplier WHERE s_nationkey = 3) AND wallet NOT IN (SELECT wallet FROM arrived WHERE in_delta))"""

#: Pairs of intervals of one market would be too many to join here: the pieces between ends, by windows.
POOLED = "pooled AS (SELECT * REPLACE (CASE WHEN wallet LIKE '%0' THEN token ELSE 'pooled' END AS token, CASE WHEN wallet LIKE '%0' THEN wallet ELSE 'desk' END AS wallet) FROM trades)"
PIECES = """ends AS (
  SELECT wallet, token, key, CASE WHEN side = 'buy' THEN bought_end ELSE sold_end END AS e, CASE WHEN side = 'buy' THEN 0 ELSE 1 END AS kind,
    CASE WHEN side = 'buy' THEN {'k': key, 'q': qty, 'v': value_usd, 'good': data_quality = 'observed-execution'} END AS lot,
    CASE WHEN side = 'sell' THEN {'k': key, 'q': qty, 'v': value_usd, 'good': data_quality = 'observed-execution'} END AS sell FROM led WHERE side = 'buy' OR sold > 0
), pieces AS (
  SELECT wallet, token, e - coalesce(lag(e) OVER up, 0) AS units, first_value(lot IGNORE NULLS) OVER rest AS b, first_value(sell IGNORE NULLS) OVER rest AS s FROM ends
  WINDOW up AS (PARTITION BY wallet, token ORDER BY e, kind, key), rest AS (PARTITION BY wallet, token ORDER BY e, kind, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)"""

QUERIES = {
    "b2_dedupe_trades": (
        b2,
        A.with_views(A.TRADES)
        + """SELECT key, slot, signature, wallet, token, side, qty, value_usd FROM (SELECT * REPLACE (short_key AS key), row_number() OVER
        (PARTITION BY short_key ORDER BY slot, t, signature, wallet, token, side, qty, value_usd) AS n FROM trades) WHERE n = 1""",
    ),
    "b11_trade_usd_value": (
        b11,
        """SELECT l_orderkey, l_linenumber, l_partkey, floor((CASE WHEN l_linenumber % 3 = 2 AND l_extendedprice > 0 THEN l_extendedprice
        WHEN l_linenumber <> 4 THEN l_extendedprice / l_quantity * l_quantity END) * 1e4 + 0.5001) / 1e4 AS value_usd FROM lineitem""",
    ),
    "e1_fifo_match": (e1, BASE + "SELECT wallet, token, lot_key, sell_key, units, floor((invested) * 1e4 + 0.5001) / 1e4 AS invested, floor((proceeds) * 1e4 + 0.5001) / 1e4 AS proceeds, high_quality FROM matches"),
    "e1_fifo_hot_market": (
        e1_hot,
        A.with_views(A.TRADES, POOLED, LEDGER.replace("FROM trades", "FROM pooled"), PIECES) + """SELECT wallet, token, b.k AS lot_key, s.k AS sell_key, units, floor((b.v * 1.015 * units / b.q) * 1e4 + 0.5001) / 1e4 AS invested,
        floor((s.v * 0.985 * units / s.q) * 1e4 + 0.5001) / 1e4 AS proceeds, b.good AND s.good AS high_quality FROM pieces WHERE units > 0 AND b IS NOT NULL AND s IS NOT NULL""",
    ),
    "e2_realizations": (
        e2,
        BASE[:-1] + ", " + REAL + """ SELECT wallet, token, sell_key, opened_t, closed_t, units, floor((invested) * 1e4 + 0.5001) / 1e4 AS invested, floor((proceeds) * 1e4 + 0.5001) / 1e4 AS proceeds,
        floor(((proceeds - invested) / invested * 100) * 1e4 + 0.5001) / 1e4 AS return_pct, high_quality FROM real""",
    ),
    "e3_episodes": (
        e3,
        BASE[:-1] + ", " + EPISODES + """ SELECT wallet, token, episode, opened_t, closed_t, lots, sells, status, floor((invested) * 1e4 + 0.5001) / 1e4 AS invested,
        floor((proceeds) * 1e4 + 0.5001) / 1e4 AS proceeds, floor((return_pct) * 1e4 + 0.5001) / 1e4 AS return_pct, high_quality FROM episodes""",
    ),
    "e4_lots": (
        e4,
        BASE[:-1] + f""", used AS (SELECT {MARKET}, lot_key, sum(units) AS closed_units, max(sell_t) AS last_t, count(*) AS n_sells FROM matches GROUP BY {MARKET}, lot_key)
        SELECT b.wallet, b.token, b.key AS lot_key, b.qty, b.qty - coalesce(u.closed_units, 0) AS remaining,
        CASE WHEN b.qty - coalesce(u.closed_units, 0) = 0 THEN 'realized' WHEN u.closed_units > 0 THEN 'partially-realized' ELSE 'open' END AS status,
        floor((b.value_usd * 1.015) * 1e4 + 0.5001) / 1e4 AS cost, floor((b.value_usd * 1.015 * (b.qty - coalesce(u.closed_units, 0)) / b.qty) * 1e4 + 0.5001) / 1e4 AS remaining_cost,
        CASE WHEN b.qty - coalesce(u.closed_units, 0) = 0 THEN u.last_t END AS closed_t, coalesce(u.n_sells, 0)::INTEGER AS n_sells
        FROM led b LEFT JOIN used u ON b.wallet = u.wallet AND b.token = u.token AND b.key = u.lot_key WHERE b.side = 'buy'""",
    ),
    "e5_open_inventory": (
        e5,
        BASE[:-1] + f""", used AS (SELECT {MARKET}, lot_key, sum(units) AS closed_units FROM matches GROUP BY {MARKET}, lot_key)
        SELECT b.wallet, b.token, sum(b.qty - coalesce(u.closed_units, 0)) AS units, floor(sum(b.value_usd * 1.015 * (b.qty - coalesce(u.closed_units, 0)) / b.qty) * 1e4 + 0.5001) / 1e4 AS cost, count(*) AS lots
        FROM led b LEFT JOIN used u ON b.wallet = u.wallet AND b.token = u.token AND b.key = u.lot_key WHERE b.side = 'buy' AND b.qty > coalesce(u.closed_units, 0) GROUP BY b.wallet, b.token""",
    ),
    "e6_ledger_advance": (
        e6,
        BASE[:-1] + ", " + REAL + ", " + ADVANCE + """ SELECT wallet, token, sell_key, mode, episode, opened_t, units, floor((invested) * 1e4 + 0.5001) / 1e4 AS invested,
        floor((proceeds) * 1e4 + 0.5001) / 1e4 AS proceeds, high_quality FROM real JOIN wallet_modes USING (wallet)
        WHERE mode <> 'continued' OR sell_key IN (SELECT key FROM arrived WHERE in_delta)""",
    ),
    "e6_carried_lots": (
        e6_lots,
        BASE[:-1] + f""", used AS (SELECT {MARKET}, lot_key, sum(units) AS closed_units FROM matches GROUP BY {MARKET}, lot_key)
        SELECT b.wallet, b.token, b.key AS lot_key, b.qty - coalesce(u.closed_units, 0) AS remaining, floor((b.value_usd * (b.qty - coalesce(u.closed_units, 0)) / b.qty) * 1e4 + 0.5001) / 1e4 AS remaining_value, b.episode
        FROM led b LEFT JOIN used u ON b.wallet = u.wallet AND b.token = u.token AND b.key = u.lot_key WHERE b.side = 'buy' AND b.qty > coalesce(u.closed_units, 0)""",
    ),
}
