"""Registered queries over market data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.common import steady
from tidemark.operators import market as M
from tidemark.plans.ingest import DAY, T0, pairs
from tidemark.operators import ingest as I
from tidemark.sources import adapters as A

PRICES, ENTRIES = A.with_views(A.PRICES), A.with_views(A.PRICES, A.ENTRIES)
HOUR = 3600


def st(x: str, name: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5001) / 1e4 AS {name}"


def market_legs(spark, d):
    p = A.price_observations(spark, d)
    side = F.when(F.col("obs_key") % 3 == 0, "sell").otherwise("buy")
    return p.select("token", "t", F.col("obs_key").alias("leg_key"), side.alias("side"), F.col("price_usd").alias("price"), (F.col("price_usd") * 2).alias("volume"), F.col("wallet").alias("trader"), F.floor(F.col("t") / 60).alias("slot"))


def c1(spark, d):
    return M.ohlc_buckets(market_legs(spark, d), ["token"], DAY).withColumn("volume", steady(F.col("volume")))


def c2(spark, d):
    return M.sample_buckets(A.price_observations(spark, d), 6 * HOUR).select("market", "bucket", "obs_key", "price_usd")


def c3(spark, d):
    e = A.entries(spark, d).withColumn("pool", F.when(F.col("entry_key") % 4 == 0, "  ").when(F.col("entry_key") % 4 == 1, F.lit(None)).otherwise(F.col("pool")))
    return M.group_markets(e)


def c4(spark, d):
    p = I.compact_pair(pairs(spark, d)).select("token", "pool", "liquidity_usd")
    n = F.col("p_partkey")
    want = A.table(spark, d, "part").select(n.alias("want"), F.col("p_brand").alias("token"), F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, F.concat(F.lit("p"), n)).otherwise(F.lit("gone")).alias("want_pool"))
    return M.select_pair(want, p).select("want", "token", "chosen")


def c5(spark, d):
    p = A.price_observations(spark, d).select("token", "t", F.col("obs_key").alias("tie"), F.col("event_type").isin("error", "click").alias("missing"), F.col("price_usd").alias("price"))
    return M.missing_streaks(p, "token", 3).select("tie", "streak", "last_price", "rugged")


def flow(spark, d):
    legs = M.ohlc_buckets(market_legs(spark, d), ["token"], DAY).select("token", "bucket", "buys", "sells", F.col("volume").alias("volume_usd"), (F.col("close") * 10).alias("liquidity_usd"))
    return M.flow_evidence(legs)


def c6(spark, d):
    return flow(spark, d).select("token", "bucket", "swaps", steady(F.col("buy_share")).alias("buy_share"), steady(F.col("vlr")).alias("vlr"))


def c7(spark, d):
    return flow(spark, d).select("token", "bucket", M.controlled_flow(100, 50, 3.0).alias("controlled"))


def c8(spark, d):
    legs = market_legs(spark, d).select("token", F.col("t").alias("trade_t"), "side", "trader", "volume", "price")
    out = M.pre_entry_flow(A.entries(spark, d).select("entry_key", "token", "t"), legs, 2 * DAY)
    return out.select("entry_key", "buys", "sells", "buyers", "sellers", steady(F.col("volume")).alias("volume"), steady(F.col("range_pct")).alias("range_pct"), "balanced")


def quotes(spark, d):
    p = A.price_observations(spark, d).where("event_type IN ('view', 'signup')")
    return p.select("token", F.col("t").alias("quote_t"), F.col("price_usd").alias("quote_price"), F.col("obs_key").alias("quote_seq"), (F.col("obs_key") % 5 * 0.1).alias("quote_conf"))


def c14(spark, d):
    rows = A.entries(spark, d).select(F.col("entry_key").alias("row_key"), "token", "t")
    return M.nearest_quote(rows, quotes(spark, d), "token", 8 * HOUR).select("row_key", "quote_t", "quote_price")


def c15(spark, d):
    rows = A.entries(spark, d).select(F.col("entry_key").alias("row_key"), "token", "t", F.col("entry_price").alias("price_quote"))
    rows = rows.withColumn("quote_token", F.when(F.col("row_key") % 3 == 0, "USD").when(F.col("row_key") % 3 == 1, "SOL").otherwise("OTHER"))
    return M.price_execution(M.nearest_quote(rows, quotes(spark, d), "token", 8 * HOUR)).select("row_key", steady(F.col("price_usd")).alias("price_usd"), "price_quality", "unpriced_reason")


def c16(spark, d):
    rows = A.entries(spark, d).select(F.col("entry_key").alias("key"), "token", "t", F.when(F.col("entry_key") % 2 == 0, F.col("entry_price")).alias("price_usd"))
    return M.enrich_prices(rows, A.price_observations(spark, d).where("event_type = 'view'"), 12 * HOUR).select("key", "price_usd", "proxied")


def c17(spark, d):
    n = F.col("p_partkey")
    pools = A.table(spark, d, "part").select(F.col("p_brand").alias("token"), F.concat(F.lit("p"), n).alias("pool"), (n * 50_000).alias("created_t"))
    rows = A.trades(spark, d).withColumn("pool", F.when(F.col("qty") % 2 == 0, F.concat(F.lit("p"), F.element_at(F.split("key", ":"), 3))))
    return M.best_pool(rows, pools).select("key", "p_pool", steady(F.col("age_minutes")).alias("age_minutes"))


def c18(spark, d):
    t = A.trades(spark, d).groupBy("token", F.col("wallet").alias("holder")).agg(F.sum("qty").alias("amount"))
    n = F.substring("p_brand", 7, 5).cast("int")
    tokens = A.table(spark, d, "part").select("p_brand").distinct().select(F.col("p_brand").alias("token"), (n % 3 > 0).alias("mint_revoked"), (n % 4 > 0).alias("freeze_revoked"))
    out = M.token_risk(t, tokens, 5.0, 30.0)
    return out.select("token", steady(F.col("top1_pct")).alias("top1_pct"), steady(F.col("top10_pct")).alias("top10_pct"), "known", "passed", steady(F.col("risk")).alias("risk"))


def c19(spark, d):
    p = I.compact_pair(pairs(spark, d))
    seq = F.col("seq")
    age = F.when(seq % 11 > 0, (seq % 2000).cast("double"))
    s = M.traction_score(F.col("liquidity_usd") * 20, F.col("volume5m_usd"), F.col("volume1h_usd"), (F.col("buys5m"), F.col("sells5m")), (seq % 23, seq % 17), ((seq % 401 - 200) * 1.0, (seq % 601 - 300) * 1.0), age)
    return p.select("seq", steady(s).alias("score"))


def c22(spark, d):
    p = A.price_observations(spark, d).select("token", "t", F.col("obs_key").alias("tie"), (F.col("price_usd") > 100).alias("eligible"), "rugged")
    return M.persist_on_change(p, "token", 12 * HOUR).select("token", "tie", "t")


def c23(spark, d):
    return M.unresolved_windows(A.entries(spark, d), A.price_observations(spark, d).where("event_type = 'view'"), DAY, 2 * DAY, 40)


def c25(spark, d):
    return M.busiest_pools(A.entries(spark, d), 30)


def c26(spark, d):
    p = I.compact_pair(pairs(spark, d)).withColumn("score", F.col("liquidity_usd") + F.col("volume5m_usd"))
    sources = A.table(spark, d, "part").select(F.col("p_brand").alias("token"), F.concat(F.lit("s"), F.col("p_partkey") % 3).alias("source"))
    return M.candidate_pairs(sources, p.withColumn("volume_usd", F.col("volume1h_usd")), 5000, 100).select("token", "pool", "score", "sources")


LEGS = """, legs AS (SELECT token, t, obs_key AS leg_key, CASE WHEN obs_key % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, price_usd AS price, price_usd * 2 AS volume, wallet AS trader, t // 60 AS slot FROM prices)"""
OHLC = LEGS + f""", ohlc AS (SELECT token, t // {DAY} * {DAY} AS bucket, arg_min(price, (t, leg_key)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t, leg_key)) AS close, sum(volume) AS volume,
  count(*) FILTER (WHERE side = 'buy') AS buys, count(*) FILTER (WHERE side = 'sell') AS sells, count(DISTINCT trader) AS traders, count(DISTINCT CASE WHEN side = 'buy' THEN trader END) AS buyers,
  count(DISTINCT CASE WHEN side = 'sell' THEN trader END) AS sellers, min(slot) AS first_slot, max(slot) AS last_slot FROM legs GROUP BY 1, 2)"""
FLOW = OHLC + """, flow AS (SELECT token, bucket, buys + sells AS swaps, buys / (buys + sells) AS buy_share, volume AS volume_usd, close * 10 AS liquidity_usd, coalesce(volume / nullif(close * 10, 0), 0) AS vlr FROM ohlc)"""
NEAR = f""", q AS (SELECT token, t AS quote_t, price_usd AS quote_price, obs_key AS quote_seq, obs_key % 5 * 0.1::DOUBLE AS quote_conf FROM prices WHERE event_type IN ('view', 'signup')),
  near AS (SELECT * FROM (SELECT e.entry_key AS row_key, e.entry_price, q.*, row_number() OVER (PARTITION BY e.entry_key ORDER BY abs(e.t - q.quote_t), q.quote_t DESC, q.quote_seq DESC) AS n
    FROM entries e LEFT JOIN q ON e.token = q.token AND q.quote_t BETWEEN e.t - {8 * HOUR} AND e.t + {8 * HOUR}) WHERE n = 1)"""
PAIR_ROWS = """WITH pr AS (SELECT p_partkey AS seq, p_brand AS token, 'p' || p_partkey AS pool, CASE WHEN p_partkey % 7 > 0 THEN p_partkey * 10.5::DOUBLE ELSE 0 END AS liq, p_partkey * 1.5::DOUBLE AS v5,
  CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 9.5::DOUBLE ELSE 0 END AS v1, p_partkey % 9 AS buys FROM part)"""

QUERIES = {
    "c1_ohlc_buckets": (c1, PRICES[:-1] + OHLC + f" SELECT * REPLACE (floor(volume * 1e4 + 0.5001) / 1e4 AS volume) FROM ohlc"),
    "c2_sample_bucket": (c2, PRICES + f" SELECT pool AS market, bucket, obs_key, price_usd FROM (SELECT *, t // {6 * HOUR} * {6 * HOUR} AS bucket, row_number() OVER (PARTITION BY pool, t // {6 * HOUR} ORDER BY t, obs_key) AS n FROM prices) WHERE n = 1"),
    "c3_group_markets": (c3, ENTRIES + " SELECT token, CASE WHEN entry_key % 4 < 2 THEN 'unknown' ELSE pool END AS market_pool, count(*) AS entries, min(t) AS first_t, max(t) AS last_t FROM entries GROUP BY 1, 2"),
    "c4_select_pair": (c4, PAIR_ROWS + " SELECT p.seq AS want, p.token, CASE p.seq % 3 WHEN 0 THEN b.best WHEN 1 THEN p.pool END AS chosen FROM pr p JOIN (SELECT token, arg_max(pool, (liq, pool)) AS best FROM pr GROUP BY token) b ON p.token = b.token"),
    "c5_missing_streak": (c5, PRICES[:-1] + """, m AS (SELECT *, event_type IN ('error', 'click') AS missing FROM prices), i AS (SELECT *, sum((NOT missing)::INT) OVER (PARTITION BY token ORDER BY t, obs_key ROWS UNBOUNDED PRECEDING) AS island FROM m),
        s AS (SELECT *, sum(missing::INT) OVER (PARTITION BY token, island ORDER BY t, obs_key ROWS UNBOUNDED PRECEDING) AS streak, max(CASE WHEN NOT missing THEN price_usd END) OVER (PARTITION BY token, island) AS lp FROM i)
        SELECT obs_key AS tie, streak::BIGINT AS streak, lp AS last_price, island > 0 AND streak >= 3 AS rugged FROM s"""),
    "c6_flow_evidence": (c6, PRICES[:-1] + FLOW + f" SELECT token, bucket, swaps, {st('buy_share', 'buy_share')}, {st('vlr', 'vlr')} FROM flow"),
    "c7_controlled_flow": (c7, PRICES[:-1] + FLOW + " SELECT token, bucket, liquidity_usd >= 100 AND volume_usd >= 50 AND swaps BETWEEN 5 AND 100 AND buy_share BETWEEN 0.5 AND 0.85 AND vlr <= 3 AS controlled FROM flow"),
    "c8_pre_entry_flow": (c8, ENTRIES[:-1] + LEGS + f""", x AS (SELECT e.entry_key, count(*) FILTER (WHERE side = 'buy') AS buys, count(*) FILTER (WHERE side = 'sell') AS sells, count(DISTINCT CASE WHEN side = 'buy' THEN trader END) AS buyers,
        count(DISTINCT CASE WHEN side = 'sell' THEN trader END) AS sellers, coalesce(sum(volume), 0) AS volume, coalesce((max(price) - min(price)) * 100 / nullif(min(price), 0), 0) AS range_pct
        FROM entries e LEFT JOIN legs l ON e.token = l.token AND l.t BETWEEN e.t - {2 * DAY} AND e.t GROUP BY e.entry_key)
        SELECT entry_key, buys, sells, buyers, sellers, {st('volume', 'volume')}, {st('range_pct', 'range_pct')}, buys + sells BETWEEN 5 AND 100 AND coalesce(buys / nullif(buys + sells, 0) BETWEEN 0.5 AND 0.85, false) AND buyers >= 3 AS balanced FROM x"""),
    "c14_nearest_quote_price": (c14, ENTRIES[:-1] + NEAR + " SELECT row_key, quote_t, quote_price FROM near"),
    "c15_price_execution": (c15, ENTRIES[:-1] + NEAR + f""" SELECT row_key, {st('CASE WHEN row_key % 3 = 0 THEN entry_price WHEN row_key % 3 = 1 AND quote_conf / nullif(quote_price, 0) <= 0.02 THEN entry_price * quote_price END', 'price_usd')},
        CASE WHEN row_key % 3 = 0 THEN 'observed-execution' WHEN row_key % 3 = 1 AND quote_conf / nullif(quote_price, 0) <= 0.02 THEN 'oracle-converted' ELSE 'unpriced' END AS price_quality,
        CASE WHEN row_key % 3 = 0 OR (row_key % 3 = 1 AND quote_conf / nullif(quote_price, 0) <= 0.02) THEN NULL WHEN row_key % 3 = 2 THEN 'unknown-quote' WHEN quote_price IS NULL THEN 'no-oracle' ELSE 'oracle-unsure' END AS unpriced_reason FROM near"""),
    "c16_enrich_trade_prices": (c16, ENTRIES[:-1] + f""", n AS (SELECT e.entry_key AS key, arg_min(p.price_usd, (p.t, p.obs_key)) AS proxy FROM entries e JOIN prices p ON e.token = p.token AND p.event_type = 'view' AND p.t BETWEEN e.t AND e.t + {12 * HOUR} WHERE e.entry_key % 2 = 1 GROUP BY 1)
        SELECT e.entry_key AS key, CASE WHEN e.entry_key % 2 = 0 THEN e.entry_price ELSE n.proxy END AS price_usd, n.proxy IS NOT NULL AS proxied FROM entries e LEFT JOIN n ON e.entry_key = n.key"""),
    "c17_historical_wallet_trades": (c17, A.with_views(A.TRADES)[:-1] + f""", pl AS (SELECT p_brand AS token, 'p' || p_partkey AS pool, p_partkey * 50000 AS created_t, p_partkey FROM part),
        old AS (SELECT token, arg_min(pool, (created_t, pool)) AS pool FROM pl GROUP BY token), ch AS (SELECT t.key, t.t, CASE WHEN t.qty % 2 = 0 THEN 'p' || split_part(t.key, ':', 3) ELSE o.pool END AS p_pool FROM trades t JOIN old o ON t.token = o.token)
        SELECT ch.key, ch.p_pool, {st('greatest(0, (ch.t - pl.created_t) / 60)', 'age_minutes')} FROM ch JOIN pl ON ch.p_pool = pl.pool"""),
    "c18_token_risk": (c18, A.with_views(A.TRADES)[:-1] + f""", h AS (SELECT token, wallet, sum(qty) AS amount FROM trades GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY amount DESC, wallet) AS n FROM h),
        s AS (SELECT token, max(amount) / sum(amount) * 100 AS t1, sum(CASE WHEN n <= 10 THEN amount END) / sum(amount) * 100 AS t10, CAST(substr(token, 7) AS INT) AS k FROM r GROUP BY token)
        SELECT token, {st('t1', 'top1_pct')}, {st('t10', 'top10_pct')}, true AS known, k % 3 > 0 AND k % 4 > 0 AND t1 <= 5 AND t10 <= 30 AS passed, {st('least(100, (k % 3 = 0)::INT * 40 + (k % 4 = 0)::INT * 30 + greatest(0, t10 - 30))', 'risk')} FROM s"""),
    "c19_traction_score": (c19, PAIR_ROWS + f""" SELECT seq, {st('least(45, log10(greatest(v5, 1)) * 13) + least(35, log10(greatest(v1, 1)) * 9) + least(25, log10(greatest(liq * 20, 1)) * 7) + greatest(-10, least(16, (buys / greatest(buys, 1) - 0.45) * 45)) + greatest(-8, least(12, ((seq % 23) / greatest(seq % 23 + seq % 17, 1) - 0.45) * 24))'
        ' + greatest(-12, least(12, (seq % 401 - 200) * 0.08)) + greatest(-12, least(12, (seq % 601 - 300) * 0.05)) + CASE WHEN seq % 11 > 0 THEN greatest(0, least(18, 18 - (seq % 2000) / 90)) ELSE 0 END - CASE WHEN liq * 20 > 2000000 THEN 8 ELSE 0 END', 'score')} FROM pr"""),
    "c22_persist_on_change": (c22, "WITH RECURSIVE " + A.PRICES + f""", o AS (SELECT *, row_number() OVER w AS place, lag(t) OVER w IS NULL OR rugged OR lag(price_usd > 100) OVER w IS DISTINCT FROM (price_usd > 100) AS forced FROM prices WINDOW w AS (PARTITION BY token ORDER BY t, obs_key)),
        walk AS (SELECT token, place, t AS last_t, true AS kept FROM o WHERE place = 1 UNION ALL SELECT o.token, o.place, CASE WHEN o.forced OR o.t - walk.last_t >= {12 * HOUR} THEN o.t ELSE walk.last_t END, o.forced OR o.t - walk.last_t >= {12 * HOUR} FROM walk JOIN o ON o.token = walk.token AND o.place = walk.place + 1)
        SELECT o.token, o.obs_key AS tie, o.t FROM walk JOIN o ON walk.token = o.token AND walk.place = o.place WHERE kept"""),
    "c23_unresolved_horizon_windows": (c23, ENTRIES + f""" SELECT token, count(*) AS entries, min(t) + {DAY} AS from_t, max(t) + {2 * DAY} AS to_t FROM entries e WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.event_type = 'view' AND p.token = e.token
        AND p.t BETWEEN e.t + {DAY} AND e.t + {2 * DAY}) GROUP BY token ORDER BY entries DESC, token LIMIT 40"""),
    "c25_busiest_entry_pools": (c25, ENTRIES + " SELECT pool, count(*) AS entries, min(t) AS first_t FROM entries GROUP BY pool ORDER BY entries DESC, first_t, pool LIMIT 30"),
    "c26_candidate_pairs": (c26, PAIR_ROWS + """, s AS (SELECT token, string_agg(DISTINCT 's' || seq % 3, ',' ORDER BY 's' || seq % 3) AS sources FROM pr GROUP BY token)
        SELECT token, pool, score, sources FROM (SELECT pr.token, pool, liq + v5 AS score, sources, row_number() OVER (PARTITION BY pr.token ORDER BY liq + v5 DESC, pool) AS n FROM pr JOIN s ON pr.token = s.token WHERE liq >= 5000 AND v1 >= 100) WHERE n = 1"""),
}
