"""Registered queries over reports and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.common import first_by, steady
from tidemark.operators import audit as U
from tidemark.operators import outcomes as O
from tidemark.plans import outcomes as PO
from tidemark.plans import research as PR
from tidemark.plans.ingest import DAY, T0
from tidemark.plans.market import st
from tidemark.plans.scoring import ROWS, returns
from tidemark.sources import adapters as A

COHORTS = {"all": "true", "deep": "liquidity_usd >= 30000", "even": "entry_key % 2 = 0"}


def f15(spark, d):
    out = U.evidence_score(returns(spark, d).select("wallet", "value"))
    return out.select("wallet", "n", *[steady(F.col(c)).alias(c) for c in ("average", "median", "ex_best", "best_share", "hit_rate", "worst", "score")], "confidence")


def g24(spark, d):
    """Steps of the evidence of all entries at the fixed horizon."""
    e = O.prior_token_count(A.entries(spark, d)).select("entry_key", "wallet", "token", "t", (F.col("entry_key") % 4 > 0).alias("linked"), (F.col("liquidity_usd") >= 30_000).alias("controlled"), F.col("prior_tokens").alias("repeat_wallets"), F.floor(F.col("t") / DAY).alias("slot"))
    return U.evidence_funnel(A.price_observations(spark, d), e, PO.outcome_rows(spark, d), PO.H, PO.DELAY)


def f31(spark, d):
    p = A.price_observations(spark, d).select("token", "t", "obs_key", F.concat(F.lit("m"), F.col("obs_key") % 3).alias("method"))
    o = PO._horizon(spark, d).select("token", steady(F.col("return_pct")).alias("return_pct"))
    return U.method_signals(p, o)


def f34(spark, d):
    return U.track_history(A.price_observations(spark, d), 100).select("token", "obs_key", F.col("back").cast("long").alias("back"))


def g9(spark, d):
    r = PR.records(spark, d)
    return r.select("entry_key", U.strict_predicate({"liquidity_usd": (5_000, 80_000), "value": (-30, None)}, []).alias("passed"))


def market_records(spark, d):
    """Market records: the first line of each part, its supplier as creator; returns from the part's size, thresholds from the line."""
    lines, parts = A.table(spark, d, "lineitem"), A.table(spark, d, "part")
    rows = first_by(lines.withColumn("t", A.seconds("l_shipdate")), ["l_partkey"], ["t", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax", "l_discount"])
    rows = rows.join(parts, rows.l_partkey == parts.p_partkey)
    yes = [F.lit(True).alias(c) for c in U.STRICT_FLAGS]
    return rows.select(
        F.col("l_partkey").alias("market"), F.col("l_suppkey").alias("creator"), "t", (F.col("t") + 30 * DAY).alias("frozen_t"), (F.col("p_size") - 8.0).alias("net_return_pct"), (F.col("l_tax") * 100).alias("cost_pct"),
        ((F.col("l_returnflag") == "R") & (F.col("p_size") >= 49)).alias("rugged"), (F.col("l_linenumber") - 2).alias("safe3"), (F.col("l_linenumber") - 3).alias("safe6"), F.col("l_extendedprice").alias("liquidity_usd"),
        (F.col("l_extendedprice") / 2).alias("volume_5m_usd"), F.col("l_quantity").alias("pool_age_minutes"), (F.col("l_linenumber") + 20).alias("transactions_5m"), (F.col("l_discount") + 0.5).alias("buy_share_5m"),
        (F.col("l_tax") * 6).alias("volume_liquidity_ratio"), (F.col("p_retailprice") / 100).alias("top10_percent"), *yes,
    )


def g13(spark, d):
    """Every candidate's figures on the windows it is chosen by."""
    out = U.v4_grid_audit(market_records(spark, d), PR.EMBARGO).candidates
    return out.select("candidate", "window", "n", *[steady(F.col(c)).alias(c) for c in V4], "reasons", "passed")


def g13_locked(spark, d):
    """The locked candidate on every window, with the verdict; no row if none passes."""
    out = U.v4_grid_audit(market_records(spark, d), PR.EMBARGO).locked
    return out.select("candidate", "window", "n", *[steady(F.col(c)).alias(c) for c in (*V4, "median", "score")], "reasons", "passed", "selected", "verdict")


V4 = ("average", "ex_best", "best_share", "hit_rate", "profit_factor", "rug_rate", "catastrophic_rate", "worst")
_SAFE = " UNION ALL ".join(f"SELECT {i} AS i0, '{k}' AS kind, {n} AS least_safe" for i, (k, n) in enumerate(U.SAFE_WALLETS))
_LIST = lambda n, v, c: " UNION ALL ".join(f"SELECT {i} AS i{n}, {x}::DOUBLE AS {c}" for i, x in enumerate(v))
_PAIR = lambda n, v, a, b: " UNION ALL ".join(f"SELECT {i} AS i{n}, {x}::DOUBLE AS {a}, {y}::DOUBLE AS {b}" for i, (x, y) in enumerate(v))
#: The oracle meets every record with every candidate.
V4_SQL = f"""WITH rec AS (SELECT * FROM (SELECT *, date_diff('second', TIMESTAMP '1970-01-01', l_shipdate) AS t, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_tax, l_discount) AS pn
    FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE pn = 1), r0 AS (SELECT l_partkey AS market, l_suppkey AS creator, t, l_returnflag = 'R' AND p_size >= 49 AS rugged,
    CASE WHEN l_returnflag = 'R' AND p_size >= 49 THEN -100 ELSE p_size - 8.0::DOUBLE - greatest(0, 7.1::DOUBLE - l_tax * 100) END AS value, l_linenumber - 2 AS safe3, l_linenumber - 3 AS safe6, l_extendedprice AS liq, l_quantity AS age,
    l_discount + 0.5::DOUBLE AS share, l_tax * 6 AS ratio, p_retailprice / 100 AS top10 FROM rec),
  hist AS (SELECT a.market, count(b.market) AS prior_n, count(*) FILTER (WHERE b.rugged) AS prior_bad FROM r0 a LEFT JOIN r0 b ON a.creator = b.creator AND b.t + {30 * DAY} < a.t GROUP BY 1),
  r1 AS (SELECT * FROM r0 JOIN hist USING (market)), pl AS (SELECT *, row_number() OVER (ORDER BY t, market) - 1 AS place, count(*) OVER () AS total_n FROM r1),
  cut AS (SELECT max(t) FILTER (WHERE place = floor(total_n * 0.4)) AS a, max(t) FILTER (WHERE place = floor(total_n * 0.6)) AS b, max(t) FILTER (WHERE place = floor(total_n * 0.8)) AS c FROM pl),
  win AS (SELECT pl.*, CASE WHEN t >= c THEN 'holdout2' WHEN t >= b THEN 'holdout1' WHEN t >= a THEN 'validation' ELSE 'train' END AS "window" FROM pl, cut WHERE abs(t - a) >= {PR.EMBARGO} AND abs(t - b) >= {PR.EMBARGO} AND abs(t - c) >= {PR.EMBARGO}),
  strict AS (SELECT * FROM win WHERE liq >= 10000 AND liq / 2 >= 5000 AND age >= 5 AND share >= 0.5 AND share < 0.6::DOUBLE AND ratio < 0.5 AND top10 < 20),
  grid AS (SELECT concat_ws('-', i0, i1, i2, i3, i4, i5, i6) AS candidate, * FROM ({_SAFE}), ({_LIST(1, U.LEAST_LIQUIDITY, 'least_liq')}), ({_PAIR(2, U.BUY_SHARE, 'low_share', 'high_share')}), ({_LIST(3, U.VOLUME_RATIO_BELOW, 'ratio_below')}),
    ({_PAIR(4, U.POOL_AGE, 'low_age', 'high_age')}), ({_LIST(5, U.TOP10_BELOW, 'top_below')}), ({_LIST(6, U.PRIOR_CLEAN_MARKETS, 'clean')})),
  met AS (SELECT candidate, "window", value, rugged FROM strict JOIN grid ON CASE kind WHEN 'safe3' THEN safe3 ELSE safe6 END >= least_safe AND liq >= least_liq AND share >= low_share AND share < high_share AND ratio < ratio_below
    AND age >= low_age AND age <= high_age AND top10 < top_below AND (clean = 0 OR (prior_n >= clean AND prior_bad = 0))),
  fig AS (SELECT candidate, "window", count(*) AS n, avg(value) AS average, median(value) AS median, CASE WHEN count(*) > 1 THEN (sum(value) - max(value)) / (count(*) - 1) ELSE 0 END AS ex_best,
    CASE WHEN max(value) > 0 THEN max(value) / sum(greatest(value, 0)) ELSE 0 END AS best_share, avg((value > 0)::INT) AS hit_rate, CASE WHEN min(value) < 0 THEN sum(greatest(value, 0)) / -sum(least(value, 0)) WHEN max(value) > 0 THEN 999 ELSE 0 END AS profit_factor,
    avg(rugged::INT) AS rug_rate, avg((value <= -50)::INT) AS catastrophic_rate, min(value) AS worst FROM met GROUP BY 1, 2),
  jud AS (SELECT *, concat_ws(',', CASE WHEN n < CASE WHEN "window" = 'train' THEN 12 ELSE 6 END THEN 'count' END, CASE WHEN median <= 0 THEN 'median<=0' END, CASE WHEN ex_best <= 0 THEN 'average-ex-best<=0' END, CASE WHEN hit_rate < 0.6 THEN 'hit-rate<60%' END,
    CASE WHEN profit_factor < 1.2 THEN 'profit-factor<1.2' END, CASE WHEN rug_rate > 0.05 THEN 'rug-rate>5%' END, CASE WHEN catastrophic_rate > 0.05 THEN 'catastrophic-rate>5%' END, CASE WHEN worst < -35 THEN 'worst<-35%' END, CASE WHEN best_share > 0.4 THEN 'best-winner-share>40%' END) AS reasons,
    median + ex_best + hit_rate * 20 + log10(n + 1) * 2 - rug_rate * 300 - catastrophic_rate * 200 - greatest(0, best_share - 0.4) * 100 AS score FROM fig)"""


def g18(spark, d):
    out = U.replay_cohorts(PR.records(spark, d), {k: F.expr(v) for k, v in COHORTS.items()}, 10)
    return out.select("cohort", "n", steady(F.col("median_")).alias("median_"), "reason")


def g22(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("wallet"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("verdict"), (F.col("o_orderkey") % 100).alias("size"))
    return U.wallet_persistence(o, "wallet", "run", F.col("verdict") != "P", "size").select("wallet", "streak", "growth", "verdict")


def h10(spark, d):
    p = A.price_observations(spark, d)
    pools = p.groupBy("pool").agg(F.min("t").alias("created_t"), F.max("liquidity_usd").alias("liquidity_usd"))
    flow = p.where("event_type = 'purchase'").groupBy("pool").agg(F.countDistinct("wallet").alias("buyers"))
    decided = p.where(F.col("rugged") & (F.col("t") <= T0 + 2 * DAY))
    return U.decision_seed(pools, flow, decided, T0 + 2 * DAY, (0, 2 * DAY), 40).select("pool", "created_t", "missing", "eligible")


QUERIES = {
    "f15_evidence_score": (f15, ROWS + f""", a AS (SELECT wallet, count(*) AS n, avg(value) AS av, median(value) AS md, CASE WHEN count(*) > 1 THEN (sum(value) - max(value)) / (count(*) - 1) ELSE 0 END AS xb, avg((value > 0)::INT) AS hr, min(value) AS wo,
        coalesce(max(value) FILTER (WHERE value > 0) / sum(value) FILTER (WHERE value > 0), 0) AS bs FROM rets GROUP BY 1), w AS (SELECT *, n >= 3 AND av >= 0 AND md >= 0 AND hr >= 0.5 AND wo >= -35 AS watch FROM a),
        s AS (SELECT *, CASE WHEN watch THEN greatest(0, least(100, 30 + least(n, 10) * 3 + greatest(-20, least(20, av)) + hr * 20 + 10)) ELSE 0 END AS sc FROM w)
        SELECT wallet, n, {st('av', 'average')}, {st('md', 'median')}, {st('xb', 'ex_best')}, {st('bs', 'best_share')}, {st('hr', 'hit_rate')}, {st('wo', 'worst')}, {st('sc', 'score')}, CASE WHEN watch AND n >= 4 AND av >= 2 AND xb > 0 AND bs <= 0.35 AND sc >= 60 THEN 'candidate' WHEN watch THEN 'watch' ELSE 'insufficient' END AS confidence FROM s"""),
    "f31_method_signals": (f31, A.with_views(A.PRICES)[:-1] + PO.HOR + f""", o AS (SELECT token, {st('arg_max(r, (ot, obs_key))', 'return_pct')} FROM un GROUP BY token), f AS (SELECT token, t, obs_key, 'm' || obs_key % 3 AS method, row_number() OVER (PARTITION BY token, obs_key % 3 ORDER BY t, obs_key) AS n FROM prices)
        SELECT f.token, f.t, f.obs_key, f.method, o.return_pct FROM f LEFT JOIN o ON f.token = o.token WHERE f.n = 1"""),
    "f34_track_history": (f34, A.with_views(A.PRICES) + "SELECT token, obs_key, back FROM (SELECT token, obs_key, row_number() OVER (PARTITION BY token ORDER BY t DESC, obs_key DESC) AS back FROM prices) WHERE back <= 100"),
    "g9_strict_predicate": (g9, PR.REC + " SELECT entry_key, liquidity_usd >= 5000 AND liquidity_usd <= 80000 AND value >= -30 AS passed FROM rec"),
    "g13_grid_audit": (g13, V4_SQL + f""" SELECT candidate, "window", n, {', '.join(st(c, c) for c in V4)}, reasons, reasons = '' AS passed FROM jud WHERE "window" IN ('train', 'validation')"""),
    "g13_locked_candidate": (g13_locked, V4_SQL + f""", lk AS (SELECT a.candidate FROM jud a JOIN jud b ON a.candidate = b.candidate AND a."window" = 'train' AND b."window" = 'validation' WHERE a.reasons = '' AND b.reasons = ''
        ORDER BY round(b.score, 6) DESC, round(a.score, 6) DESC, a.n + b.n DESC, a.candidate LIMIT 1), l AS (SELECT jud.* FROM jud JOIN lk ON jud.candidate = lk.candidate), v AS (SELECT count(*) FILTER (WHERE reasons = '') AS p, sum(n)::BIGINT AS selected FROM l)
        SELECT candidate, "window", n, {', '.join(st(c, c) for c in (*V4, 'median', 'score'))}, reasons, reasons = '' AS passed, selected, CASE WHEN p = 4 AND selected >= 30 THEN 'future-shadow-only' ELSE 'no-promotable-v4' END AS verdict FROM l, v"""),
    "g18_replay_cohorts": (g18, PR.REC + ", hit AS (" + " UNION ALL ".join(f"SELECT '{k}' AS cohort, * FROM rec WHERE {v}" for k, v in COHORTS.items()) + f"), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort, token ORDER BY t, tie) AS pn FROM hit) WHERE pn = 1), a AS (SELECT cohort, {PR.AGG} FROM f GROUP BY 1) SELECT cohort, n, {st('median_', 'median_')}, CASE WHEN n < 10 THEN 'too-few' WHEN median_ <= 0 THEN 'median' WHEN ex_best <= 0 THEN 'one-winner' WHEN profit_factor < 1.2 THEN 'profit-factor' END AS reason FROM a"),
    "g22_wallet_persistence": (g22, """WITH b AS (SELECT *, sum((o_orderstatus = 'P')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS bad FROM orders),
        s AS (SELECT o_custkey AS wallet, count(*) FILTER (WHERE bad = 0) AS streak, arg_max(o_orderkey % 100, o_orderkey) - arg_min(o_orderkey % 100, o_orderkey) AS growth FROM b GROUP BY 1)
        SELECT wallet, streak, growth, CASE WHEN streak >= 3 AND growth > 0 THEN 'validated' WHEN streak >= 1 THEN 'watch' ELSE 'rejected' END AS verdict FROM s"""),
    "h10_decision_seed": (h10, A.with_views(A.PRICES)[:-1] + f""", po AS (SELECT pool, min(t) AS created_t, max(liquidity_usd) AS liq FROM prices GROUP BY 1), fl AS (SELECT pool, count(DISTINCT wallet) AS buyers FROM prices WHERE event_type = 'purchase' GROUP BY 1),
        x AS (SELECT po.*, buyers, row_number() OVER (PARTITION BY created_t // {DAY} ORDER BY created_t, po.pool) AS n FROM po LEFT JOIN fl ON po.pool = fl.pool WHERE {T0 + 2 * DAY} - created_t BETWEEN 0 AND {2 * DAY} AND po.pool NOT IN (SELECT pool FROM prices WHERE rugged AND t <= {T0 + 2 * DAY}))
        SELECT pool, created_t, concat_ws(',', CASE WHEN liq IS NULL THEN 'liquidity' END, CASE WHEN buyers IS NULL THEN 'flow' END) AS missing, liq IS NOT NULL AND buyers IS NOT NULL AS eligible FROM x WHERE n <= 40"""),
    "g24_evidence_funnel": (g24, PO.QUERIES["d6_assess_fixed_horizon"][1].rsplit(") SELECT", 1)[0] + """), x AS (SELECT o.status, r.reason, r.entry_key, r.reason IN ('valid-window', 'terminal-rug-before-horizon') AS ok FROM r JOIN outc o ON o.entry_key = r.entry_key WHERE r.entry_key % 4 > 0),
        e AS (SELECT *, entry_key % 4 > 0 AS linked, (SELECT count(DISTINCT f.token) FROM entries f WHERE f.wallet = entries.wallet AND f.t < entries.t) AS prior FROM entries)
        SELECT (SELECT count(DISTINCT pool) FROM prices) AS pools, (SELECT count(DISTINCT token) FROM e WHERE linked AND liquidity_usd >= 30000) AS eligible, (SELECT count(*) FROM e WHERE linked) AS entries, (SELECT count(*) FROM e WHERE NOT linked) AS exploratory,
        (SELECT count(DISTINCT wallet) FROM e WHERE linked AND prior >= 2) AS repeating_wallets, (SELECT count(*) FROM e WHERE linked AND t < 86400) AS missing_slots, count(DISTINCT CASE WHEN ok THEN entry_key END) AS mature, count(*) FILTER (WHERE status = 'mature' AND NOT ok) AS invalid,
        count(*) FILTER (WHERE reason = 'terminal-rug-before-horizon') AS early_rugs, count(*) FILTER (WHERE status = 'provisional') AS provisional, count(*) FILTER (WHERE status = 'unresolved') AS unresolved FROM x"""),
}
