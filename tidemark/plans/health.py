"""Registered queries over queues, coverage, decisions and incremental tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.common import deterministic_id, first_by, steady
from tidemark.operators import health as P
from tidemark.operators import ledger as L
from tidemark.operators import star
from tidemark.plans.ingest import DAY, T0, gaps
from tidemark.plans.ledger import BASE, EPISODES
from tidemark.plans.market import st
from tidemark.sources import adapters as A

PRICES, ENTRIES, TRADES = A.with_views(A.PRICES), A.with_views(A.PRICES, A.ENTRIES), A.with_views(A.TRADES)
HOUR = 3600


def event_rows(spark, d):
    p = A.price_observations(spark, d)
    k = F.col("obs_key")
    return p.select(k.alias("key"), "token", (k * 7 % 1000).alias("slot"), F.when(k % 3 == 0, "processed").when(k % 3 == 1, "pending").otherwise("retry").alias("status"), F.col("t").alias("next_t"), (k % 2 == 0).alias("finality_required"), F.when(k % 5 == 0, "finalized").otherwise("confirmed").alias("commitment"))


def h1(spark, d):
    return P.partition_heads(event_rows(spark, d), ["token"], T0 + 15 * DAY).select("token", "key", "slot", "ready")


def h2(spark, d):
    e = A.price_observations(spark, d).select("wallet", "t", (F.col("obs_key") % 3).cast("int").alias("priority"))
    n = F.substring("wallet", 2, 20).cast("int")
    s = e.select("wallet").distinct().where(n % 4 > 0).select("wallet", (F.lit(T0) + n % 30 * DAY).alias("scored_t"), F.when(n % 2 == 0, "watch").otherwise("observed").alias("status"))
    return P.changed_wallets(e, s)


def h3(spark, d):
    t, e = A.trades(spark, d), A.entries(spark, d)
    t = t.withColumn("wallet", F.concat(F.lit("u"), F.substring("wallet", 2, 20)))
    return P.admission_ready(t, e, e.where("entry_key % 2 = 0"), 10_500 * DAY, 400, 8)


def h4(spark, d):
    p = A.price_observations(spark, d)
    return P.evidence_bounds({"views": (p.where("event_type = 'view'"), 14), "purchases": (p.where("event_type = 'purchase'"), 15)})


def h5(spark, d):
    r = event_rows(spark, d)
    return r.groupBy("status", "finality_required").agg(F.count(F.lit(1)).alias("n"), F.min("next_t").alias("oldest"))


def h6(spark, d):
    r = event_rows(spark, d)
    return r.agg(F.count_if(F.col("status") != "processed").alias("backlog"), F.count_if(F.col("commitment") == "finalized").alias("finalized"), steady(F.avg((F.col("status") == "processed").cast("double"))).alias("success_rate"), F.max("slot").alias("last_slot"), F.max("next_t").alias("latest"))


def f25(spark, d):
    return P.gap_anti_join(A.price_observations(spark, d).select("obs_key", "token", "t"), gaps(spark, d), "token", "t", 6 * HOUR)


def incidents(spark, d):
    p = A.price_observations(spark, d).where("event_type = 'error'")
    return p.select(F.col("token").alias("program"), F.col("t").alias("low"), F.when(F.col("obs_key") % 3 > 0, F.col("t") + HOUR).alias("high"), (F.col("obs_key") % 10).alias("target"))


def h8(spark, d):
    i = incidents(spark, d)
    sent = i.where("target = 1").select("program", F.col("low").alias("t"), F.lit("opened").alias("kind"))
    return P.incident_transitions(i, sent)


H7_NOW = 10_400 * DAY


def h7(spark, d):
    """Orders as inbox, signals (dear ones) and deliveries (urgent ones); lines as the work queue of a strategy."""
    o = A.table(spark, d, "orders").select("o_totalprice", F.expr("CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending' ELSE 'dead_letter' END").alias("status"), "o_orderpriority", A.seconds("o_orderdate").alias("t")).where(F.col("t") <= H7_NOW)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    inbox = o.select("status", "t", F.when(urgent, "pool_created").otherwise("swap").alias("type"))
    deliveries = o.select("status", "t", F.when(urgent, "qualified-pool").otherwise("other").alias("type"), F.lit("v1").alias("version"))
    ship = A.seconds("l_shipdate")
    queue = A.table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("strategy"), F.col("l_linenumber").alias("revision"), F.lit(2).alias("completed"), F.when(F.col("l_tax") > 0.06, "deferred").when(F.col("l_tax") < 0.02, "unchecked").otherwise("admitted").alias("admission"),
        F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("priority"), (ship + F.col("l_quantity").cast("long") * DAY).alias("not_before"), F.when(F.col("l_discount") > 0.05, ship + 90 * DAY).alias("locked_until"),
        ship.alias("pending_since"), (F.col("l_discount") > 0.08).alias("failed"), (F.col("l_tax") > 0.07).alias("quarantined"),
    )
    trades = A.trades(spark, d).where(F.col("t") <= H7_NOW)
    return P.pipeline_status(inbox, queue, o.where("o_totalprice > 100000"), deliveries, trades, incidents(spark, d), "O", "v1", H7_NOW)


def h9(spark, d):
    i = incidents(spark, d)
    r = i.where("target < 7").withColumn("status", F.when(F.col("target") % 2 == 0, "completed").otherwise("failed")).select("program", "low", "target", "status")
    return P.gap_repair_proof(i, r).select("program", "low", "target")


def decisions(spark, d):
    p = A.price_observations(spark, d).where("event_type = 'view'")
    return first_by(p, ["token"], ["t", "obs_key"]).select(F.col("obs_key").alias("decision"), "token", "t", (F.col("obs_key") % 4 > 0).alias("eligible"))


def h11(spark, d):
    x = decisions(spark, d)
    return P.decision_checkpoints(x, x.where("decision % 3 = 0")).select("decision", "horizon", "due", "usable")


def h12(spark, d):
    t = A.price_observations(spark, d).select("token", F.col("t").alias("trade_t"), F.when(F.col("obs_key") % 3 == 0, "sell").otherwise("buy").alias("side"), F.col("wallet").alias("trader"))
    return P.flow_since_decision(decisions(spark, d), t, 2 * DAY)


def h13(spark, d):
    p = A.price_observations(spark, d)
    k = F.col("obs_key")
    liq = F.when(k % 9 == 0, None).when(k % 9 == 1, 0.0).otherwise(F.col("liquidity_usd"))
    return p.select("obs_key", P.checkpoint_status(liq, F.lit(60_000.0), k % 50, 30).alias("state"))


def h14(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("checkpoint"), F.col("l_returnflag").alias("direction"), (F.col("l_linenumber") % 3).alias("notional"))
    return P.surface_violations(li)


def h15(spark, d):
    x = decisions(spark, d)
    return x.groupBy("eligible").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_if(F.col("decision") % 3 == 0).alias("terminal"))


def h16(spark, d):
    s = A.price_observations(spark, d).where("event_type = 'click'").groupBy("token", F.floor(F.col("t") / DAY).alias("day")).agg(F.sum("price_usd").alias("size")).select("token", (F.col("day") * DAY).alias("t"), "size")
    out = P.growth_slopes(s, "token", T0 + 25 * DAY, (7, 20))
    return out.select("token", steady(F.col("slope_7d")).alias("slope_7d"), steady(F.col("slope_20d")).alias("slope_20d"))


def h17(spark, d):
    p = A.price_observations(spark, d).select("event_type", (F.col("obs_key") % 7 > 1).alias("decoded"))
    return P.decoder_coverage(p, "event_type").withColumn("ratio", steady(F.col("ratio")))


def h19(spark, d):
    t = A.trades(spark, d)
    return t.groupBy("slot").agg(F.count(F.lit(1)).alias("trades"), steady(F.avg((F.col("data_quality") == "observed-execution").cast("double"))).alias("high_rate"))


def h20(spark, d):
    p = A.price_observations(spark, d)
    k = F.col("obs_key")
    return p.select("obs_key", P.classify_finality(k % 11 == 0, k % 3 == 0, k % 2 == 0, k % 100, 60).alias("finality"))


def h21(spark, d):
    p = A.price_observations(spark, d)
    now = T0 + 20 * DAY
    return p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t").between(now - 600, now)).alias("fresh"), F.max("t").alias("latest"), F.count_if(F.col("obs_key") % 3 > 0).alias("pending"))


def h22(spark, d):
    p, e = A.price_observations(spark, d), A.entries(spark, d)
    a = p.agg(F.count(F.lit(1)).alias("prices"), F.max("t").alias("latest_price"), F.count_if("rugged").alias("rugged"), F.countDistinct("token").alias("tokens"))
    b = e.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("wallet").alias("wallets"))
    one = lambda df: df.withColumn("_one", F.monotonically_increasing_id())  # noqa: E731  both are single rows
    return one(a).join(one(b), "_one").drop("_one")


def e7(spark, d):
    t = A.trades(spark, d)
    return P.affected_episodes(L.episodes(t), t, L.MARKET, 10_000).select("wallet", "token", "episode", "opened_t", "closed_t", "status")


def e8(spark, d):
    t, p = A.trades(spark, d), A.price_observations(spark, d)
    return star.dimension(t, p, A.entries(spark, d), columns=["wallet"], name="id")


def day_facts(rows):
    """Facts of a wallet, token and day: trades, quantity and value."""
    rows = rows.select(deterministic_id(F.col("wallet")).alias("wallet_id"), deterministic_id(F.col("token")).alias("token_id"), F.col("slot").alias("day"), "qty", "value_usd")
    return rows.groupBy("wallet_id", "token_id", "day").agg(F.count(F.lit(1)).alias("trades"), F.sum("qty").alias("qty"), F.round(F.sum("value_usd"), 2).alias("value_usd"))


def e8_changes(spark, d):
    """What a merge does per day: stored are facts of all but the last order day's trades, wanted those of all but pending orders'."""
    orders = A.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("signature"), "o_orderdate", "o_orderstatus")
    last = orders.agg(F.max("o_orderdate").alias("last_day"))
    t = A.trades(spark, d).join(orders, "signature").join(F.broadcast(last), F.lit(True))
    out = star.changes(day_facts(t.where("o_orderdate < last_day")), day_facts(t.where("o_orderstatus <> 'P'")), ["wallet_id", "token_id", "day"], ["trades", "qty", "value_usd"])
    return out.groupBy(F.coalesce("day", "was_day").alias("day"), "op").agg(F.count(F.lit(1)).alias("n"))


def e9(spark, d):
    return P.parity_digest(A.trades(spark, d), ["key", "wallet", "token", "side"])


def e10(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("portfolio"), F.lit(1_000_000.0).alias("start"))
    o = A.table(spark, d, "orders")
    ev = o.select(F.col("o_custkey").alias("portfolio"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("cash_delta"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 10).otherwise(0.0).alias("realized"), (F.col("o_orderstatus") == "O").alias("open"))
    out = P.portfolio_snapshot(c, ev)
    return out.select("portfolio", "positions", *[steady(F.col(x)).alias(x) for x in ("cash", "realized", "exposure")])


def f22(spark, d):
    t, e = A.trades(spark, d), A.entries(spark, d)
    by = t.groupBy("wallet").agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("side") == "sell").alias("sells"), F.count_if(F.col("data_quality") == "observed-execution").alias("high"))
    return by.join(e.groupBy("wallet").agg(F.count(F.lit(1)).alias("entries")), "wallet", "full").fillna(0)


def f23(spark, d):
    return P.top_per_key(A.trades(spark, d), "wallet", [F.desc("slot"), F.desc("key")], 20).select("wallet", "key", "place")


def f35(spark, d):
    s = A.price_observations(spark, d).where("event_type = 'signup'").select(F.concat_ws(":", "token", "wallet").alias("signal_key")).distinct()
    known = A.entries(spark, d).select(F.concat_ws(":", "token", "wallet").alias("signal_key"))
    return P.signal_fanout(s, known, ("paper", "alert"))


EV = PRICES[:-1] + """, ev AS (SELECT obs_key AS key, token, obs_key * 7 % 1000 AS slot, CASE obs_key % 3 WHEN 0 THEN 'processed' WHEN 1 THEN 'pending' ELSE 'retry' END AS status, t AS next_t, obs_key % 2 = 0 AS finality_required,
  CASE WHEN obs_key % 5 = 0 THEN 'finalized' ELSE 'confirmed' END AS commitment FROM prices)"""
INC = PRICES[:-1] + ", inc AS (SELECT token AS program, t AS low, CASE WHEN obs_key % 3 > 0 THEN t + 3600 END AS high, obs_key % 10 AS target FROM prices WHERE event_type = 'error')"
DEC = PRICES[:-1] + ", dec AS (SELECT obs_key AS decision, token, t, obs_key % 4 > 0 AS eligible FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY t, obs_key) AS n FROM prices WHERE event_type = 'view') WHERE n = 1)"
SLOPE = f"""(SELECT token, regr_slope(size, (t - {{s}}) / 86400) AS slope FROM sn WHERE t >= {{s}} OR nx >= {{s}} GROUP BY token)"""
S7, S20 = T0 + 18 * DAY, T0 + 5 * DAY

QUERIES = {
    "h1_partition_heads": (h1, EV + f" SELECT token, key, slot, next_t <= {T0 + 15 * DAY} AND (NOT finality_required OR commitment = 'finalized') AS ready FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY slot, key) AS n FROM ev WHERE status <> 'processed') WHERE n = 1"),
    "h2_changed_wallets": (h2, PRICES[:-1] + f""", w AS (SELECT *, CAST(substr(wallet, 2) AS INT) AS n FROM prices) SELECT wallet, max(CASE WHEN obs_key % 3 = 2 AND NOT (n % 4 > 0 AND n % 2 = 0) THEN 1 ELSE obs_key % 3 END)::INTEGER AS priority FROM w
        WHERE n % 4 = 0 OR t > {T0} + n % 30 * {DAY} GROUP BY wallet"""),
    "h3_admission_ready": (h3, A.with_views(A.TRADES, A.PRICES, A.ENTRIES)[:-1] + f""", s AS (SELECT 'u' || substr(wallet, 2) AS wallet, count(*) AS sells FROM trades WHERE side = 'sell' AND t > {10_100 * DAY} AND t <= {10_500 * DAY} GROUP BY 1),
        e AS (SELECT wallet, count(DISTINCT token) AS tokens, count(DISTINCT CASE WHEN entry_key % 2 = 0 THEN token END) AS mt FROM entries GROUP BY 1)
        SELECT coalesce(s.wallet, e.wallet) AS wallet, coalesce(sells, 0) AS sells, coalesce(tokens, 0) AS tokens, coalesce(mt, 0) AS mature_tokens, coalesce(sells, 0) >= 8 AND coalesce(tokens, 0) >= 8 AND coalesce(mt, 0) >= 8 AS ready FROM s FULL JOIN e ON s.wallet = e.wallet"""),
    "h4_evidence_bounds": (h4, PRICES + "SELECT wallet, views, purchases, views > 14 OR purchases > 15 AS over FROM (SELECT wallet, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM prices GROUP BY 1) WHERE views + purchases > 0"),
    "h5_queue_summary": (h5, EV + " SELECT status, finality_required, count(*) AS n, min(next_t) AS oldest FROM ev GROUP BY 1, 2"),
    "h6_pipeline_health": (h6, EV + f" SELECT count(*) FILTER (WHERE status <> 'processed') AS backlog, count(*) FILTER (WHERE commitment = 'finalized') AS finalized, {st("avg((status = 'processed')::INT)", 'success_rate')}, max(slot) AS last_slot, max(next_t) AS latest FROM ev"),
    "f25_gap_anti_join": (f25, PRICES + "SELECT obs_key, token, t FROM prices p WHERE NOT EXISTS (SELECT 1 FROM prices e WHERE e.event_type = 'error' AND e.token = p.token AND p.t BETWEEN e.t AND e.t + 10800)"),
    "h7_pipeline_status": (h7, A.with_views(A.TRADES, A.PRICES)[:-1] + f""", inc AS (SELECT obs_key % 3 = 0 AS is_open FROM prices WHERE event_type = 'error'),
        o AS (SELECT *, date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) AS t FROM orders), ib AS (SELECT * FROM o WHERE t <= {H7_NOW}),
        li AS (SELECT *, date_diff('second', TIMESTAMP '1970-01-01', l_shipdate) AS t FROM lineitem WHERE l_linestatus = 'O'),
        q AS (SELECT *, l_linenumber > 2 AS p, t + CAST(l_quantity AS BIGINT) * {DAY} AS nb FROM li), r AS (SELECT *, p AND nb <= {H7_NOW} AND (NOT l_discount > 0.05 OR t + {90 * DAY} <= {H7_NOW}) AS rd FROM q),
        w AS (SELECT count(*) FILTER (WHERE p) AS pending, count(*) FILTER (WHERE l_tax > 0.06) AS deferred, count(*) FILTER (WHERE p AND l_tax < 0.02) AS unchecked, count(*) FILTER (WHERE rd) AS ready, count(*) FILTER (WHERE p AND l_discount > 0.08 AND NOT l_tax > 0.07) AS failed,
          count(*) FILTER (WHERE p AND l_tax > 0.07 AND nb > {H7_NOW}) AS quarantined, count(*) FILTER (WHERE p AND l_returnflag = 'R') AS background_pending, count(*) FILTER (WHERE p AND l_returnflag = 'N') AS elevated_pending, count(*) FILTER (WHERE p AND l_returnflag = 'A') AS signal_pending,
          {H7_NOW} - min(t) FILTER (WHERE rd AND NOT l_tax > 0.07) AS oldest_ready_s, {H7_NOW} - min(t) FILTER (WHERE rd AND NOT l_tax > 0.07 AND l_returnflag = 'A') AS oldest_signal_s FROM r),
        b AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS backlog, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS dead_letters, {H7_NOW} - max(t) FILTER (WHERE o_orderpriority = '1-URGENT') AS pool_age_s,
          count(*) FILTER (WHERE o_totalprice > 100000 AND t >= {H7_NOW - DAY}) AS signals_24h, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND t >= {H7_NOW - DAY}) AS pools_24h FROM ib),
        z AS (SELECT *, (SELECT {H7_NOW} - max(t) FROM trades WHERE t <= {H7_NOW}) AS trade_age_s, (SELECT count(*) FROM inc WHERE is_open) AS open_incidents FROM w, b)
        SELECT *, CASE WHEN backlog <= 100 AND dead_letters = 0 AND open_incidents = 0 AND failed = 0 AND coalesce(oldest_ready_s, 0) <= 3600 AND coalesce(oldest_signal_s, 0) <= 300 AND coalesce(pool_age_s <= 300, false) THEN 'ok' ELSE 'degraded' END AS status FROM z"""),
    "h8_incident_transitions": (h8, INC + """, tr AS (SELECT program, low AS t, 'opened' AS kind FROM inc UNION ALL SELECT program, high, 'closed' FROM inc WHERE high IS NOT NULL), la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY t DESC, kind DESC) AS n FROM tr) WHERE n = 1)
        SELECT program, t, kind FROM la WHERE NOT (kind = 'opened' AND EXISTS (SELECT 1 FROM inc WHERE inc.program = la.program AND inc.low = la.t AND inc.target = 1))"""),
    "h9_gap_repair_proof": (h9, INC + " SELECT program, low, target FROM inc WHERE target < 7 AND target % 2 = 0"),
    "h11_decision_checkpoints": (h11, DEC + " SELECT decision, h::INTEGER AS horizon, t + h AS due, h = 0 OR decision % 3 = 0 AS usable FROM dec, (SELECT unnest([0, 15, 30, 60, 120, 300]) AS h) WHERE eligible"),
    "h12_flow_since_decision": (h12, DEC + f""" SELECT d.decision, count(DISTINCT CASE WHEN p.obs_key % 3 > 0 THEN p.wallet END) AS buyers, count(DISTINCT CASE WHEN p.obs_key % 3 = 0 THEN p.wallet END) AS sellers
        FROM dec d LEFT JOIN prices p ON d.token = p.token AND p.t BETWEEN d.t AND d.t + {2 * DAY} GROUP BY 1"""),
    "h13_checkpoint_status": (h13, PRICES + """SELECT obs_key, CASE WHEN obs_key % 9 = 0 THEN 'missing' WHEN obs_key % 9 = 1 OR liquidity_usd <= 0 THEN 'liquidity-zero' WHEN liquidity_usd < 12000 THEN 'liquidity-removed' ELSE 'live' END || '/' || CASE WHEN obs_key % 50 <= 30 THEN 'on-time' ELSE 'late' END AS state FROM prices"""),
    "h14_quote_surface_check": (h14, "SELECT * FROM (SELECT l_orderkey AS checkpoint, count(*) AS n, count(DISTINCT l_returnflag || l_linenumber % 3) AS different FROM lineitem GROUP BY 1) WHERE n NOT IN (3, 6) OR n <> different"),
    "h15_tape_summary": (h15, DEC + " SELECT eligible, count(*) AS n, min(t) AS first_t, max(t) AS last_t, count(*) FILTER (WHERE decision % 3 = 0) AS terminal FROM dec GROUP BY 1"),
    "h16_growth_runway": (h16, PRICES[:-1] + f""", sm AS (SELECT token, t // {DAY} * {DAY} AS t, sum(price_usd) AS size FROM prices WHERE event_type = 'click' GROUP BY 1, 2), sn AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY token ORDER BY t), 0) AS nx FROM sm WHERE t <= {T0 + 25 * DAY})
        SELECT coalesce(a.token, b.token) AS token, {st('a.slope', 'slope_7d')}, {st('b.slope', 'slope_20d')} FROM {SLOPE.format(s=S7)} a FULL JOIN {SLOPE.format(s=S20)} b ON a.token = b.token"""),
    "h17_decoder_coverage": (h17, PRICES + f"SELECT event_type, count(*) FILTER (WHERE obs_key % 7 > 1) AS decoded, count(*) FILTER (WHERE obs_key % 7 <= 1) AS unmatched, {st('avg((obs_key % 7 > 1)::INT)', 'ratio')} FROM prices GROUP BY 1"),
    "h19_score_reprice_audit": (h19, TRADES + "SELECT slot, count(*) AS trades, " + st("avg((data_quality = 'observed-execution')::INT)", "high_rate") + " FROM trades GROUP BY 1"),
    "h20_classify_finality": (h20, PRICES + "SELECT obs_key, CASE WHEN obs_key % 11 = 0 THEN 'failed' WHEN obs_key % 3 = 0 THEN 'finalized' WHEN obs_key % 2 > 0 AND obs_key % 100 > 60 THEN 'unresolved' ELSE 'pending' END AS finality FROM prices"),
    "h21_live_counts": (h21, PRICES + f"SELECT event_type, count(*) AS n, count(*) FILTER (WHERE t BETWEEN {T0 + 20 * DAY - 600} AND {T0 + 20 * DAY}) AS fresh, max(t) AS latest, count(*) FILTER (WHERE obs_key % 3 > 0) AS pending FROM prices GROUP BY 1"),
    "h22_operational_scalars": (h22, ENTRIES + "SELECT * FROM (SELECT count(*) AS prices, max(t) AS latest_price, count(*) FILTER (WHERE rugged) AS rugged, count(DISTINCT token) AS tokens FROM prices), (SELECT count(*) AS entries, count(DISTINCT wallet) AS wallets FROM entries)"),
    "e7_affected_episodes": (e7, BASE[:-1] + ", " + EPISODES + f""" SELECT wallet, token, episode, opened_t, closed_t, status FROM episodes e WHERE opened_t <= {10_000 * DAY + 86_399} AND coalesce(closed_t, {10_000 * DAY + 86_399}) >= {10_000 * DAY}
        AND EXISTS (SELECT 1 FROM trades t WHERE t.slot = 10000 AND t.wallet = e.wallet AND t.token = e.token)"""),
    "e8_fact_changes": (e8_changes, A.with_views(A.TRADES)[:-1] + """, x AS (SELECT trades.*, o_orderdate < (SELECT max(o_orderdate) FROM orders) AS a, o_orderstatus <> 'P' AS b FROM trades JOIN orders ON signature = CAST(o_orderkey AS VARCHAR)),
        f AS (SELECT wallet, token, slot AS day, count(*) FILTER (WHERE a) AS an, sum(qty) FILTER (WHERE a) AS aq, round(sum(value_usd) FILTER (WHERE a), 2) AS av, count(*) FILTER (WHERE b) AS bn, sum(qty) FILTER (WHERE b) AS bq, round(sum(value_usd) FILTER (WHERE b), 2) AS bv FROM x GROUP BY ALL),
        g AS (SELECT day, CASE WHEN an = 0 AND bn > 0 THEN 'insert' WHEN bn = 0 AND an > 0 THEN 'remove' WHEN (an, aq, av) <> (bn, bq, bv) THEN 'change' END AS op FROM f WHERE an + bn > 0) SELECT day, op, count(*) AS n FROM g WHERE op IS NOT NULL GROUP BY 1, 2"""),
    "e8_compact_star": (e8, A.with_views(A.TRADES, A.PRICES) + "SELECT wallet, sha256(wallet) AS id FROM (SELECT wallet FROM trades UNION SELECT wallet FROM prices)"),
    "e9_parity_digest": (e9, TRADES + """SELECT count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', key, wallet, token, side)), 1, 12))::BIGINT)::VARCHAR AS digest0, sum(('0x' || substr(md5(concat_ws('|', key, wallet, token, side)), 13, 12))::BIGINT)::VARCHAR AS digest1 FROM trades"""),
    "e10_portfolio_snapshot": (e10, f"""SELECT c_custkey AS portfolio, coalesce(sum((o_orderstatus = 'O')::INT), 0)::BIGINT AS positions, {st("1000000 + coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END), 0)", 'cash')},
        {st("coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 10 ELSE 0 END), 0)", 'realized')}, {st("coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0)", 'exposure')} FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""),
    "f22_coverage_summary": (f22, A.with_views(A.TRADES, A.PRICES, A.ENTRIES) + """SELECT coalesce(t.wallet, e.wallet) AS wallet, coalesce(trades, 0) AS trades, coalesce(sells, 0) AS sells, coalesce(high, 0) AS high, coalesce(entries, 0) AS entries FROM
        (SELECT wallet, count(*) AS trades, count(*) FILTER (WHERE side = 'sell') AS sells, count(*) FILTER (WHERE data_quality = 'observed-execution') AS high FROM trades GROUP BY 1) t FULL JOIN (SELECT wallet, count(*) AS entries FROM entries GROUP BY 1) e ON t.wallet = e.wallet"""),
    "f23_wallet_detail": (f23, TRADES + "SELECT wallet, key, place::INTEGER AS place FROM (SELECT wallet, key, row_number() OVER (PARTITION BY wallet ORDER BY slot DESC, key DESC) AS place FROM trades) WHERE place <= 20"),
    "f35_signal_fanout": (f35, ENTRIES + """SELECT signal_key, destination FROM (SELECT DISTINCT token || ':' || wallet AS signal_key FROM prices WHERE event_type = 'signup') s, (SELECT unnest(['paper', 'alert']) AS destination)
        WHERE signal_key NOT IN (SELECT token || ':' || wallet FROM entries)"""),
}
