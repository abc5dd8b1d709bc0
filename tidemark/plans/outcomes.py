"""Registered queries over entries, outcomes and exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.common import first_by, steady
from tidemark.operators import outcomes as O
from tidemark.operators import scoring as S
from tidemark.plans.ingest import DAY, T0
from tidemark.plans.market import st
from tidemark.sources import adapters as A

PRICES, ENTRIES = A.with_views(A.PRICES), A.with_views(A.PRICES, A.ENTRIES)
NOW = T0 + 25 * DAY
H, DELAY = 2 * DAY, 2 * DAY


def d1(spark, d):
    p = A.price_observations(spark, d).where("event_type IN ('purchase', 'view')").select("wallet", "token", "t", F.col("obs_key").alias("swap_key"))
    return O.pending_buys(p, A.entries(spark, d))


def d2(spark, d):
    return O.prior_token_count(A.entries(spark, d)).select("entry_key", F.col("prior_tokens").cast("long").alias("prior_tokens"))


def d3(spark, d):
    k = F.col("entry_key")
    return A.entries(spark, d).select("entry_key", O.entry_decision(k % 3 > 0, k % 5 > 0, k % 7 > 1).alias("decision"))


def d4(spark, d):
    pend = O.prior_token_count(A.entries(spark, d)).select(F.col("entry_key").alias("swap_key"), "wallet", "token", "pool", "t", "prior_tokens")
    obs = A.price_observations(spark, d).where("event_type = 'view'")
    return O.materialize_entries(pend, obs, 2 * DAY, F.col("liquidity_usd") >= 20_000).select("swap_key", "obs_key", "price_usd", "cohort")


def outcome_rows(spark, d, strategy="fixed-horizon"):
    return O.outcomes(A.entries(spark, d), A.price_observations(spark, d), NOW, H, DELAY, strategy)


def _out(df):
    return df.select("entry_key", "status", "outcome_price", steady(F.col("gross_pct")).alias("gross_pct"), steady(F.col("net_pct")).alias("net_pct"), "frozen_t", "rugged", "outcome_t")


def d5(spark, d):
    return _out(outcome_rows(spark, d))


def d5t(spark, d):
    return _out(outcome_rows(spark, d, "tp15-sl20-20m"))


def d6(spark, d):
    e = A.entries(spark, d).select("entry_key", "t", (F.col("entry_key") % 4 > 0).alias("linked"))
    return O.assess_fixed_horizon(outcome_rows(spark, d).join(e, "entry_key"), H, DELAY).select("entry_key", "canonical", "reason")


def d7(spark, d):
    e = first_by(O.prior_token_count(A.entries(spark, d)), ["token"], ["t", "entry_key"])
    return e.select("token", "entry_key", F.when(F.col("prior_tokens") >= 2, "primary").otherwise("control").alias("cohort"))


def signals(spark, d):
    p = A.price_observations(spark, d).where("event_type = 'signup'")
    return first_by(p, ["token"], ["t", "obs_key"]).select(F.col("obs_key").alias("signal_key"), "token", "t", F.col("price_usd").alias("signal_price"))


def _horizon(spark, d):
    return O.horizon_outcomes(signals(spark, d).where("signal_price > 0"), A.price_observations(spark, d), H, DELAY, NOW)


def d8(spark, d):
    return _horizon(spark, d).select("token", "reached", "outcome_t", steady(F.col("return_pct")).alias("return_pct"))


def d9(spark, d):
    return _horizon(spark, d).select("token", steady(F.col("max_pct")).alias("max_pct"), steady(F.col("min_pct")).alias("min_pct"))


def path(spark, d):
    s = signals(spark, d).where("signal_price > 0").select("token", F.col("t").alias("t0"), "signal_key", "signal_price")
    p = A.price_observations(spark, d).select("token", "t", F.col("obs_key").alias("tie"), "price_usd")
    return p.join(s, "token").where("t > t0").select("token", "t0", "t", "tie", ((F.col("price_usd") / F.col("signal_price") - 1) * 100).alias("ret"))


def d10(spark, d):
    return O.barrier_exit(path(spark, d), "token", 200.0, -90.0, 10 * DAY).withColumn("return_pct", steady(F.col("return_pct")))


def d11(spark, d):
    return O.two_stage_exit(path(spark, d), "token", 150.0, -95.0, 0.5, 100.0).withColumn("return_pct", steady(F.col("return_pct")))


def d12(spark, d):
    e = A.entries(spark, d).select("entry_key", "wallet", "token", "t")
    b = A.price_observations(spark, d).where("event_type = 'view'").groupBy("wallet", "token").agg(F.min("t").alias("buy_t"))
    delay = F.col("t") - F.col("buy_t")
    return e.join(b, ["wallet", "token"]).select("entry_key", delay.alias("delay_s"), delay.between(0, 5 * DAY).alias("timely"))


def d13(spark, d):
    return A.entries(spark, d).select("entry_key", (F.trim(F.when(F.col("entry_key") % 3 == 0, F.lit("  ")).otherwise(F.col("pool"))) != "").alias("linked"))


def plans(spark, d):
    return O.entry_trade_plan(signals(spark, d), A.price_observations(spark, d), 3600, 5_000.0, 3 * DAY, 100.0, -60.0, 50.0)


def d14(spark, d):
    return plans(spark, d).withColumn("entry_price", steady(F.col("entry_price")))


def d15(spark, d):
    return O.trade_pnl(plans(spark, d), 100.0, 30.0, 50.0).select("signal_key", *[steady(F.col(c)).alias(c) for c in ("pnl", "return_pct", "hold_minutes")])


def d16(spark, d):
    return A.entries(spark, d).where(O.hash_share(F.col("entry_key").cast("string")) >= 0.4).select("entry_key")


def d18(spark, d):
    size = O.position_size(5_000.0, 0.1, F.col("entry_key") % 7 * 1000.0, F.col("entry_key") % 11 * 700.0, F.col("liquidity_usd"))
    return A.entries(spark, d).select("entry_key", steady(size).alias("size_usd"))


def f7(spark, d):
    e = A.entries(spark, d).withColumns({"source_key": F.when(F.col("entry_key") % 6 > 0, F.col("pool")).otherwise(""), "cohort": F.when(F.col("entry_key") % 5 > 0, "control").otherwise("excluded-uncontrolled-flow"), "risk_passed": F.col("entry_key") % 7 > 0, "pool_age_minutes": (F.col("entry_key") % 40).cast("double")})
    o = outcome_rows(spark, d).withColumnRenamed("net_pct", "net_return_pct")
    return S.followability_returns(e, o).select("wallet", "token", "t", steady(F.col("value")).alias("value"), "rugged")


def f14(spark, d):
    e = A.entries(spark, d).withColumns({"risk_passed": F.col("entry_key") % 7 > 0, "pool_age_minutes": (F.col("entry_key") % 40).cast("double")})
    n = F.substring("wallet", 2, 20).cast("int")
    sc = e.select("wallet").distinct().select("wallet", F.when(n % 3 == 0, "watch").when(n % 3 == 1, "candidate").otherwise("observed").alias("status"), (n % 100).cast("double").alias("overall_score"))
    return S.wallet_signals(sc, e, NOW, 10 * DAY)


OUT = f"""obs AS (SELECT token, pool, t AS obs_t, obs_key, price_usd, rugged FROM prices WHERE t <= {NOW}
), path AS (SELECT e.entry_key, e.t AS entry_t, e.entry_price, o.obs_t, o.obs_key, o.price_usd, o.rugged, (o.price_usd / e.entry_price - 1) * 100 AS g FROM entries e JOIN obs o ON e.pool = o.pool AND o.obs_t >= e.t
), cand AS (SELECT *, row_number() OVER (PARTITION BY entry_key ORDER BY obs_t, obs_key) AS n FROM path WHERE entry_t + {H} <= {NOW} AND (rugged OR obs_t BETWEEN entry_t + {H} AND entry_t + {H + DELAY} THRESHOLD)
), latest AS (SELECT *, row_number() OVER (PARTITION BY entry_key ORDER BY obs_t DESC, obs_key DESC) AS n FROM path
), outc AS (SELECT e.entry_key, e.wallet, e.token, e.t AS entry_t, CASE WHEN c.entry_key IS NOT NULL THEN 'mature' WHEN {NOW} < e.t + {H} THEN 'provisional' ELSE 'unresolved' END AS status,
  CASE WHEN coalesce(c.rugged, l.rugged) THEN 0 ELSE coalesce(c.price_usd, l.price_usd) END AS outcome_price, e.entry_price, c.obs_t AS frozen_t, coalesce(c.rugged, false) AS rugged, coalesce(c.obs_t, l.obs_t, {NOW}) AS outcome_t
  FROM entries e LEFT JOIN cand c ON e.entry_key = c.entry_key AND c.n = 1 LEFT JOIN latest l ON e.entry_key = l.entry_key AND l.n = 1)"""
FIXED, BARRIER = OUT.replace("THRESHOLD", ""), OUT.replace("THRESHOLD", f"OR (obs_t <= entry_t + {H} AND (g >= 15 OR g <= -20))")
GROSS = "CASE WHEN entry_price > 0 THEN (outcome_price - entry_price) / entry_price * 100 END"
SHOW = f" SELECT entry_key, status, outcome_price, {st(GROSS, 'gross_pct')}, {st(GROSS + ' - 3', 'net_pct')}, frozen_t, rugged, outcome_t FROM outc"
SIGS = ", sigs AS (SELECT obs_key AS signal_key, token, t, price_usd AS signal_price FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY t, obs_key) AS n FROM prices WHERE event_type = 'signup') WHERE n = 1)"
HOR = SIGS + f""", pa AS (SELECT s.token, s.t AS st, s.signal_price, p.t AS ot, p.obs_key, p.price_usd, (p.price_usd / s.signal_price - 1) * 100 AS r FROM sigs s JOIN prices p ON s.token = p.token AND p.price_usd > 0 AND p.t BETWEEN s.t AND {NOW} WHERE s.signal_price > 0),
  hit AS (SELECT token, min((ot, obs_key)) AS h FROM pa WHERE ot BETWEEN st + {H} AND st + {H + DELAY} GROUP BY token), un AS (SELECT pa.*, h.h IS NOT NULL AS reached FROM pa LEFT JOIN hit h ON pa.token = h.token WHERE h.h IS NULL OR (pa.ot, pa.obs_key) <= h.h)"""
PATH = SIGS + ", pt AS (SELECT s.token, s.t AS t0, p.t, p.obs_key AS tie, (p.price_usd / s.signal_price - 1) * 100 AS ret FROM sigs s JOIN prices p ON s.token = p.token AND p.t > s.t WHERE s.signal_price > 0)"
PLAN = SIGS + f""", en AS (SELECT signal_key, token, entry_t, entry_obs, pr * (1 + 50.0::DOUBLE / 10000) AS entry_price FROM (SELECT s.signal_key, s.token, p.t AS entry_t, p.obs_key AS entry_obs, p.price_usd AS pr,
  row_number() OVER (PARTITION BY s.signal_key ORDER BY p.t, p.obs_key) AS n FROM sigs s JOIN prices p ON s.token = p.token AND p.t BETWEEN s.t + 3600 AND s.t + 3600 + {3 * DAY} AND p.liquidity_usd >= 5000 AND p.price_usd > 0) WHERE n = 1),
  la AS (SELECT en.*, p.t AS ot, p.obs_key, p.price_usd, CASE WHEN p.rugged THEN 'rug' WHEN p.liquidity_usd < 5000 THEN 'liquidity_failure' WHEN (p.price_usd / en.entry_price - 1) * 100 <= -60 THEN 'stop'
    WHEN (p.price_usd / en.entry_price - 1) * 100 >= 100 THEN 'take_profit' WHEN p.t - en.entry_t >= {3 * DAY} THEN 'time' END AS reason FROM en JOIN prices p ON en.token = p.token AND p.t BETWEEN en.entry_t AND en.entry_t + {6 * DAY} AND (p.t > en.entry_t OR p.obs_key > en.entry_obs)),
  ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_key ORDER BY (reason IS NULL)::INT, CASE WHEN reason IS NULL THEN -ot ELSE ot END, CASE WHEN reason IS NULL THEN -obs_key ELSE obs_key END) AS n FROM la) WHERE n = 1),
  plan AS (SELECT en.signal_key, en.token, en.entry_t, en.entry_price, ex.ot AS exit_t, ex.price_usd AS exit_price, coalesce(ex.reason, 'end_of_data') AS reason FROM en LEFT JOIN ex ON en.signal_key = ex.signal_key)"""

QUERIES = {
    "d1_pending_buys": (d1, ENTRIES + "SELECT wallet, token, t, obs_key AS swap_key FROM (SELECT *, row_number() OVER (PARTITION BY wallet, token ORDER BY t, obs_key) AS n FROM prices WHERE event_type IN ('purchase', 'view')) x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.wallet = x.wallet AND e.token = x.token)"),
    "d2_prior_token_count": (d2, ENTRIES + "SELECT e.entry_key, count(DISTINCT f.token) AS prior_tokens FROM entries e LEFT JOIN entries f ON e.wallet = f.wallet AND f.t < e.t GROUP BY 1"),
    "d3_entry_decision": (d3, ENTRIES + "SELECT entry_key, CASE WHEN entry_key % 3 = 0 THEN 'skip-uncontrolled' WHEN entry_key % 5 = 0 THEN 'defer-unknown' WHEN entry_key % 7 <= 1 THEN 'skip-failed' ELSE 'materialize' END AS decision FROM entries"),
    "d4_materialize_entries": (d4, ENTRIES[:-1] + f""", pc AS (SELECT e.entry_key, e.pool, e.t, count(DISTINCT f.token) AS prior FROM entries e LEFT JOIN entries f ON e.wallet = f.wallet AND f.t < e.t GROUP BY 1, 2, 3),
        x AS (SELECT pc.*, p.obs_key, p.price_usd, p.liquidity_usd, row_number() OVER (PARTITION BY pc.entry_key ORDER BY p.t, p.obs_key) AS n FROM pc JOIN prices p ON pc.pool = p.pool AND p.event_type = 'view' AND p.t BETWEEN pc.t AND pc.t + {2 * DAY})
        SELECT entry_key AS swap_key, obs_key, price_usd, CASE WHEN liquidity_usd < 20000 THEN 'excluded-uncontrolled-flow' WHEN prior >= 2 THEN 'repeat-wallet+controlled-flow' ELSE 'controlled-flow-control' END AS cohort FROM x WHERE n = 1"""),
    "d5_outcome_fixed": (d5, ENTRIES[:-1] + ", " + FIXED + SHOW),
    "d5_outcome_threshold": (d5t, ENTRIES[:-1] + ", " + BARRIER + SHOW),
    "d6_assess_fixed_horizon": (d6, ENTRIES[:-1] + ", " + FIXED + f""", r AS (SELECT entry_key, CASE WHEN entry_key % 4 = 0 THEN 'unlinked-entry' WHEN status <> 'mature' THEN 'not-mature' WHEN {GROSS} IS NULL THEN 'missing-return'
        WHEN rugged AND frozen_t - entry_t BETWEEN 0 AND {H + DELAY} AND frozen_t - entry_t < {H} THEN 'terminal-rug-before-horizon' WHEN (rugged AND frozen_t - entry_t BETWEEN 0 AND {H + DELAY}) OR frozen_t - entry_t BETWEEN {H} AND {H + DELAY} THEN 'valid-window'
        ELSE 'outside-window' END AS reason FROM outc) SELECT entry_key, reason IN ('valid-window', 'terminal-rug-before-horizon') AS canonical, reason FROM r"""),
    "d7_experiment_cohorts": (d7, ENTRIES + """SELECT token, entry_key, CASE WHEN (SELECT count(DISTINCT f.token) FROM entries f WHERE f.wallet = e.wallet AND f.t < e.t) >= 2 THEN 'primary' ELSE 'control' END AS cohort
        FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY t, entry_key) AS n FROM entries) e WHERE n = 1"""),
    "d8_horizon_outcomes": (d8, PRICES[:-1] + HOR + f" SELECT token, bool_or(reached) AS reached, max(ot) AS outcome_t, {st('arg_max(r, (ot, obs_key))', 'return_pct')} FROM un GROUP BY token"),
    "d9_path_extremes": (d9, PRICES[:-1] + HOR + f" SELECT token, {st('max(r)', 'max_pct')}, {st('min(r)', 'min_pct')} FROM un GROUP BY token"),
    "d10_barrier_exit": (d10, PRICES[:-1] + PATH + f""", x AS (SELECT *, CASE WHEN t - t0 >= {10 * DAY} THEN 'timeout' WHEN ret >= 200 THEN 'take-profit' WHEN ret <= -90 THEN 'stop-loss' END AS reason FROM pt),
        y AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY (reason IS NULL)::INT, CASE WHEN reason IS NULL THEN -t ELSE t END, CASE WHEN reason IS NULL THEN -tie ELSE tie END) AS n FROM x)
        SELECT token, t AS exit_t, {st("CASE reason WHEN 'take-profit' THEN 200 WHEN 'stop-loss' THEN -90 ELSE ret END", 'return_pct')}, coalesce(reason, 'provisional') AS reason FROM y WHERE n = 1"""),
    "d11_two_stage_exit": (d11, PRICES[:-1] + PATH + f""", a AS (SELECT *, max((ret >= 150)::INT) OVER w AS took, coalesce(max((ret >= 150)::INT) OVER (PARTITION BY token ORDER BY t, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had
          FROM pt WINDOW w AS (PARTITION BY token ORDER BY t, tie ROWS UNBOUNDED PRECEDING)), b AS (SELECT *, max(CASE WHEN took = 1 THEN ret END) OVER (PARTITION BY token ORDER BY t, tie ROWS UNBOUNDED PRECEDING) AS peak FROM a),
        x AS (SELECT *, CASE WHEN took = 0 AND ret <= -95 THEN 'stop-loss' WHEN had = 1 AND ret <= peak - 100 THEN 'trailing-stop' END AS reason FROM b),
        y AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY (reason IS NULL)::INT, CASE WHEN reason IS NULL THEN -t ELSE t END, CASE WHEN reason IS NULL THEN -tie ELSE tie END) AS n FROM x)
        SELECT token, t AS exit_t, {st("CASE WHEN reason = 'stop-loss' THEN -95 WHEN took = 1 THEN 75 + 0.5 * ret ELSE ret END", 'return_pct')}, coalesce(reason, 'provisional') AS reason FROM y WHERE n = 1"""),
    "d12_entry_delay": (d12, ENTRIES + f"SELECT e.entry_key, e.t - b.bt AS delay_s, e.t - b.bt BETWEEN 0 AND {5 * DAY} AS timely FROM entries e JOIN (SELECT wallet, token, min(t) AS bt FROM prices WHERE event_type = 'view' GROUP BY 1, 2) b ON e.wallet = b.wallet AND e.token = b.token"),
    "d13_source_linked": (d13, ENTRIES + "SELECT entry_key, entry_key % 3 <> 0 AS linked FROM entries"),
    "d14_entry_trade_plan": (d14, PRICES[:-1] + PLAN + f" SELECT signal_key, token, entry_t, {st('entry_price', 'entry_price')}, exit_t, exit_price, reason FROM plan"),
    "d15_trade_pnl": (d15, PRICES[:-1] + PLAN + f""", g AS (SELECT *, 100 / entry_price * CASE WHEN reason IN ('rug', 'liquidity_failure') THEN 0 ELSE coalesce(exit_price, entry_price) * (1 - 50.0::DOUBLE / 10000) END AS got FROM plan)
        SELECT signal_key, {st('got - 100 - (got + 100) * 30 / 10000', 'pnl')}, {st('(got - 100 - (got + 100) * 30 / 10000)', 'return_pct')}, {st('(coalesce(exit_t, entry_t) - entry_t) / 60', 'hold_minutes')} FROM g"""),
    "d16_hash_sample": (d16, ENTRIES + "SELECT entry_key FROM entries WHERE ('0x' || substr(sha256(CAST(entry_key AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0::DOUBLE >= 0.4"),
    "d18_position_size": (d18, ENTRIES + f"SELECT entry_key, {st('greatest(0, least(5000, entry_key % 7 * 1000, entry_key % 11 * 700, liquidity_usd * 0.1))', 'size_usd')} FROM entries"),
    "f7_followability_returns": (f7, ENTRIES[:-1] + ", " + FIXED + f""", ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wallet, token ORDER BY t, entry_key) AS n FROM entries WHERE entry_key % 6 > 0 AND entry_key % 5 > 0 AND entry_key % 7 > 0 AND entry_key % 40 <= 30) WHERE n = 1)
        SELECT ok.wallet, ok.token, o.outcome_t AS t, {st('(o.outcome_price - o.entry_price) / o.entry_price * 100 - 3', 'value')}, o.rugged FROM ok JOIN outc o ON ok.entry_key = o.entry_key WHERE o.status = 'mature' AND o.entry_price > 0"""),
    "f14_wallet_signals": (f14, ENTRIES[:-1] + f""", g AS (SELECT *, CAST(substr(wallet, 2) AS INT) AS w FROM entries WHERE {NOW} - t BETWEEN 0 AND {10 * DAY} AND liquidity_usd >= 10000 AND entry_key % 7 > 0 AND entry_key % 40 <= 30),
        e AS (SELECT token, wallet, w, arg_min(pool, (t, entry_key)) AS pool, min((t, entry_key)) AS f, arg_min(entry_price, (t, entry_key)) AS price FROM g WHERE w % 3 < 2 GROUP BY 1, 2, 3)
        SELECT sha256('s:' || token || ':wallet-alpha-paper-signal') AS signal_id, token, arg_min(pool, f) AS pool, min(f)[1] AS t, arg_min(price, f) AS price_usd, count(*) AS wallets,
        floor(least(100, avg(w % 100) + least(15, (count(*) - 1) * 5)) * 100 + 0.5) / 100 AS confidence, CASE WHEN max((w % 3 = 1)::INT) = 1 THEN 'paper-candidate' ELSE 'paper-watch' END AS status FROM e GROUP BY token"""),
}
