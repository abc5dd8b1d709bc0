"""Registered queries over selection rules and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.common import steady
from tidemark.operators import candidate_grid as C
from tidemark.operators import outcomes as O
from tidemark.operators import research as R
from tidemark.operators import survival as S
from tidemark.plans import outcomes as PO
from tidemark.plans.ingest import DAY, T0
from tidemark.plans.market import st
from tidemark.plans.scoring import ROWS, returns
from tidemark.sources import adapters as A

PRICES, ENTRIES = A.with_views(A.PRICES), A.with_views(A.PRICES, A.ENTRIES)
EMBARGO = 40 * 60
STATS = ("mean_", "median_", "hit_rate", "profit_factor", "worst", "ex_best")
MINUTES = {"train": 12, "validation": 6, "holdout1": 6, "holdout2": 6}


def records(spark, d):
    """Entries with a liquidity and a return value, for rules to choose from."""
    e = A.entries(spark, d)
    return e.select("entry_key", "wallet", "token", "pool", "t", F.col("entry_key").alias("tie"), "liquidity_usd", ((F.col("entry_key") * 37 % 101) - 45).cast("double").alias("value"), (F.col("entry_key") % 9 == 0).alias("rugged"))


def _stats(df, *keys):
    return df.select(*keys, "n", *[steady(F.col(c)).alias(c) for c in STATS])


def g4(spark, d):
    return R.walk_forward_split(records(spark, d), "t", "tie", EMBARGO).select("entry_key", "window")


def grid(spark):
    """60 candidates: a least liquidity and a group of entries."""
    rows = [(f"{lo}:{g}", float(lo), g) for lo in range(0, 60_000, 3_000) for g in (2, 3, 5)]
    return spark.createDataFrame(rows, "candidate string, least double, grp int")


def evaluated(spark, d):
    rows = R.walk_forward_split(records(spark, d), "t", "tie", EMBARGO)
    return R.evaluate_candidates(rows, grid(spark), (F.col("liquidity_usd") >= F.col("least")) & (F.col("entry_key") % F.col("grp") == 0), MINUTES)


def g7(spark, d):
    return _stats(evaluated(spark, d), "candidate", "window", "passed")


def g5(spark, d):
    return R.lock_best(evaluated(spark, d)).select("candidate", "train_passed", "validation_passed", "train_n", "validation_n")


def g8(spark, d):
    return R.search_decision(evaluated(spark, d)).select("candidate", "verdict", "holdouts_passed", "holdout_n")


def g6(spark, d):
    return C.thresholds(records(spark, d), [C.Axis("liquidity_usd", (0.1, 0.25, 0.5, 0.75, 0.9), (10_000, 50_000))]).select("threshold")


#: Seconds of the market before an entry whose trade counts.
FLOW = 21_600


def train_features(spark, d):
    """Entries of the training window with liquidity, and volume and swaps of their market in their stretch of FLOW seconds."""
    rows = R.walk_forward_split(records(spark, d), "t", "tie", EMBARGO).where("window = 'train'").withColumn("stretch", F.floor(F.col("t") / FLOW))
    seen = A.price_observations(spark, d).groupBy("token", F.floor(F.col("t") / FLOW).alias("stretch"))
    flow = seen.agg(F.sum(F.floor(F.col("price_usd") * 100)).cast("double").alias("volume_usd"), F.count(F.lit(1)).alias("swaps"))
    return rows.join(flow, ["token", "stretch"]).withColumn("volume_per_liquidity", F.col("volume_usd") / F.greatest("liquidity_usd", F.lit(1.0)))


def g6_levels(spark, d):
    levels = C.thresholds(train_features(spark, d))
    return levels.select("column", F.when(F.col("threshold") != C.FREE, F.col("threshold")).alias("threshold"))


def g6_grid(spark, d):
    grid = C.bounded(C.candidate_grid(C.thresholds(train_features(spark, d))))
    return grid.select("id", "label", "cohort", "min_repeat", "min_liquidity_usd", "min_volume_usd", "min_share", "max_share", "baseline")


def g11(spark, d):
    return records(spark, d).select("entry_key", R.modeled_return(F.col("value"), F.col("rugged"), F.col("entry_key") % 9 * 1.0).alias("modeled"))


def completions(spark, d, key):
    r = records(spark, d)
    return r.select(key, (F.col("t") + DAY).alias("frozen_t"), (F.col("value") < -20).alias("bad"), "value")


def g12(spark, d):
    dec = records(spark, d).select("wallet", F.col("entry_key").alias("decision"), "t")
    return R.prior_history(dec, completions(spark, d, "wallet"), "wallet").select("decision", "prior_n", F.col("prior_bad").cast("long").alias("prior_bad"), steady(F.col("prior_mean")).alias("prior_mean"))


def markets(spark, d):
    s = PO.signals(spark, d)
    return s.select(F.col("signal_key").alias("market"), F.concat(F.lit("p"), "token").alias("pool"), (F.col("t") + 8 * DAY).alias("t"))


def g10(spark, d):
    return R.causal_supporters(markets(spark, d), A.entries(spark, d), completions(spark, d, "wallet"), 8 * DAY)


def g14(spark, d):
    out = R.delay_sensitivity(PO.signals(spark, d), A.price_observations(spark, d), (0, 7200, 18_000, 36_000), 6 * 3600, 3 * DAY)
    return _stats(out.withColumn("coverage", steady(F.col("coverage"))), "delay", "coverage")


def g15(spark, d):
    return R.market_supporters(markets(spark, d), A.entries(spark, d), 8 * DAY)


def g16(spark, d):
    dec = records(spark, d).select("token", F.col("entry_key").alias("decision"), "t")
    out = R.context_risk(dec, completions(spark, d, "token"), "token")
    return out.select("decision", "prior_n", steady(F.col("risk")).alias("risk"), steady(F.col("risk_upper")).alias("risk_upper"))


def g16t(spark, d):
    r = A.price_observations(spark, d).select("event_type", "t", "obs_key", "price_usd")
    return S.rolling_quantile(r, ["event_type"], "price_usd", "t", "obs_key", "threshold").select("obs_key", "threshold")


def survival_records(spark, d):
    """Orders as markets: their lines' suppliers support them; figures are whole numbers of the lines, so sums are exact."""
    lines = A.table(spark, d, "lineitem")
    # a supplier of several lines counts once, with its largest number, in decision_records
    who = F.collect_list(F.struct(F.concat(F.lit("w"), "l_suppkey").alias("wallet"), F.col("l_linenumber").cast("long").alias("prior_tokens"))).alias("supporters")
    cents = lambda x: F.round(x * 100)
    shape = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), (cents(F.min("l_discount")) * 4 + cents(F.max("l_discount")) * 4 - 25).alias("net_return_pct"), ((F.min("l_returnflag") == "R") & (F.count(F.lit(1)) > 1)).alias("rugged"),
        (F.max("l_linenumber") + 5).cast("double").alias("pool_age_minutes"), F.min("l_quantity").alias("top10_percent"), (cents(F.max("l_tax")) / 10).alias("volume_liquidity_ratio"), ((cents(F.max("l_tax")) * 2 + 44) / 100).alias("buy_share_5m"), who,
    )
    rows = A.table(spark, d, "orders").join(shape, F.col("o_orderkey") == F.col("l_orderkey"))
    t = A.seconds("o_orderdate")
    yes = [F.lit(True).alias(c) for c in S.FLAGS]
    return rows.select(
        F.col("o_orderkey").alias("market"), F.col("o_orderpriority").alias("dex"), t.alias("t"), (t + F.col("lines") * DAY).alias("frozen_t"), "net_return_pct", F.lit(8.0).alias("cost_pct"), "rugged",
        F.col("o_totalprice").alias("liquidity_usd"), "pool_age_minutes", "top10_percent", "volume_liquidity_ratio", "buy_share_5m", F.col("lines").alias("transactions_5m"), "supporters", *yes,
    )


def g16_decisions(spark, d):
    out = S.decide(S.decision_records(survival_records(spark, d)))
    return out.select("market", "context", "history", *[steady(F.col(c)).alias(c) for c in G16], "evidence", "experienced", "mature", "gate", "by_market", "by_wallet")


def g16_policies(spark, d):
    out = S.contextual_survival(survival_records(spark, d), EMBARGO).policies
    return out.select("policy", "window", "n", "days", *[steady(F.col(c)).alias(c) for c in G16_STATS], "reasons", "verdict")


def g17(spark, d):
    trades = O.trade_pnl(PO.plans(spark, d), 100.0, 30.0, 50.0).withColumn("bucket", F.when(F.col("entry_price") < 40, "low").otherwise("high"))
    out = R.trade_metrics(trades, ["bucket"])
    return out.select("bucket", "n", *[steady(F.col(c)).alias(c) for c in ("win_rate", "profit_factor", "mean_", "median_", "tail", "hold", "rug_rate")])


def g17_replay(spark, d):
    """Metrics of all signals; a signal's confidence is the share of its token's rows up to it that are liquid, in per cent."""
    signals = PO.signals(spark, d)
    seen = A.price_observations(spark, d).select("token", F.col("t").alias("seen_t"), (F.col("liquidity_usd") >= 20_000).alias("liquid"))
    of = signals.join(seen, "token").where("seen_t <= t").groupBy("signal_key").agg(F.floor(100 * F.count_if("liquid") / F.count(F.lit(1))).alias("confidence"))
    out = R.replay_metrics(of, O.trade_pnl(PO.plans(spark, d), 100.0, 30.0, 50.0))
    return out.select("trades", "signals", *[steady(F.col(c)).alias(c) for c in out.columns if c not in ("trades", "signals")])


RULES = {"deep": "liquidity_usd >= 30000", "shallow": "liquidity_usd < 10000", "even": "entry_key % 2 = 0", "third": "entry_key % 3 = 0", "whale": "liquidity_usd >= 100000", "safe": "NOT rugged"}


def g1(spark, d):
    return _stats(R.rule_candidates(records(spark, d), {k: F.expr(v) for k, v in RULES.items()}), "rule")


EXITS = (("tight", 50.0, -30.0, 3 * DAY), ("wide", 200.0, -90.0, 10 * DAY), ("patient", 400.0, -99.0, 20 * DAY))


def g2(spark, d):
    out = R.exit_grid(PO.path(spark, d), "token", EXITS, 3.0)
    shares = [c for c in out.columns if c.startswith("share_")]
    return _stats(out.withColumns({c: steady(F.col(c)) for c in shares}), "exit", *shares)


def g3(spark, d):
    return _stats(R.window_stats(records(spark, d).withColumn("method", F.concat(F.lit("m"), F.col("entry_key") % 7)), ["method"]), "method")


def g20(spark, d):
    return R.goal_audit(returns(spark, d), ["wallet"])


def g21(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("hypothesis"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("verdict"))
    return R.trailing_runs(o, "hypothesis", "run", F.col("verdict") != "P")


def g25(spark, d):
    return R.data_quality(A.price_observations(spark, d), ["event_type"])


def g26(spark, d):
    o = A.table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "P").alias("partial"), F.count(F.lit(1)).alias("n"))


def g28(spark, d):
    p = A.price_observations(spark, d)
    from tidemark.operators.health import top_per_key

    return top_per_key(p, "token", [F.desc("t"), F.desc("obs_key")], 20).select("token", "obs_key", "place")


def g29(spark, d):
    return R.decision_digest(records(spark, d), ["token"], ["entry_key", "wallet", "pool"])


REC = ENTRIES[:-1] + ", rec AS (SELECT entry_key, wallet, token, pool, t, entry_key AS tie, liquidity_usd, (entry_key * 37 % 101 - 45)::DOUBLE AS value, entry_key % 9 = 0 AS rugged FROM entries)"
SPLIT = REC + f""", pl AS (SELECT *, row_number() OVER (ORDER BY t, tie) - 1 AS place FROM rec), nn AS (SELECT count(*) AS n FROM rec),
  cut AS (SELECT (SELECT t FROM pl, nn WHERE place = floor(n * 0.4)) AS a, (SELECT t FROM pl, nn WHERE place = floor(n * 0.6)) AS b, (SELECT t FROM pl, nn WHERE place = floor(n * 0.8)) AS c),
  win AS (SELECT rec.*, CASE WHEN t >= c THEN 'holdout2' WHEN t >= b THEN 'holdout1' WHEN t >= a THEN 'validation' ELSE 'train' END AS "window" FROM rec, cut WHERE abs(t - a) >= {EMBARGO} AND abs(t - b) >= {EMBARGO} AND abs(t - c) >= {EMBARGO})"""
AGG = """count(*) AS n, avg({v}) AS mean_, median({v}) AS median_, avg(({v} > 0)::INT) AS hit_rate, CASE WHEN min({v}) < 0 THEN sum(greatest({v}, 0)) / -sum(least({v}, 0)) WHEN max({v}) > 0 THEN 999 ELSE 0 END AS profit_factor,
  min({v}) AS worst, CASE WHEN count(*) > 1 THEN (sum({v}) - max({v})) / (count(*) - 1) ELSE 0 END AS ex_best""".format(v="value")
EVAL = SPLIT + f""", gr AS (SELECT l * 3000 || ':' || g AS candidate, l * 3000 AS least_, g FROM (SELECT unnest(range(0, 20)) AS l), (SELECT unnest([2, 3, 5]) AS g)),
  ev0 AS (SELECT candidate, "window", {AGG} FROM win JOIN gr ON liquidity_usd >= least_ AND entry_key % g = 0 GROUP BY 1, 2),
  ev AS (SELECT *, n >= CASE WHEN "window" = 'train' THEN 12 ELSE 6 END AND median_ > 0 AND ex_best > 0 AND profit_factor >= 1.2 AS passed, median_ + ex_best + least(profit_factor, 5) * 10 AS score FROM ev0)"""
LOCK = EVAL + """, lk AS (SELECT a.candidate, a.passed AS train_passed, b.passed AS validation_passed, a.n AS train_n, b.n AS validation_n FROM ev a JOIN ev b ON a.candidate = b.candidate AND a."window" = 'train' AND b."window" = 'validation'
  ORDER BY b.passed DESC, b.score DESC, a.passed DESC, a.score DESC, b.n DESC, a.candidate LIMIT 1)"""
SHOW = "n, " + ", ".join(st(c, c) for c in STATS)
SIG = PRICES[:-1] + PO.SIGS
MK = ENTRIES[:-1] + PO.SIGS + f", mk AS (SELECT signal_key AS market, 'p' || token AS pool, t + {8 * DAY} AS t FROM sigs)"

G16 = ("value", "risk", "risk_upper", "market_score", "wallet_score", "market_threshold", "wallet_threshold")
G16_STATS = ("average", "median", "ex_best", "hit_rate", "profit_factor", "rug_rate", "catastrophic_rate", "worst", "best_share")
_CUT = lambda c, cuts: "CASE " + " ".join(f"WHEN {c} < {x} THEN '{i}'" for i, x in enumerate(cuts)) + f" ELSE '{len(cuts)}+' END"
_UP = lambda p, n: f"least(1, ({p} + 1.645::DOUBLE * 1.645 / (2 * {n}) + 1.645::DOUBLE * sqrt(({p} * (1 - {p}) + 1.645::DOUBLE * 1.645 / (4 * {n})) / {n})) / (1 + 1.645::DOUBLE * 1.645 / {n}))"
G16_RECORDS = f"""WITH sh AS (SELECT l_orderkey, count(*) AS lines, round(min(l_discount) * 100) * 4 + round(max(l_discount) * 100) * 4 - 25 AS value, min(l_returnflag) = 'R' AND count(*) > 1 AS rugged, max(l_linenumber) + 5.0::DOUBLE AS age, min(l_quantity) AS top10,
    round(max(l_tax) * 100) / 10 AS ratio, (round(max(l_tax) * 100) * 2 + 44) / 100 AS share FROM lineitem GROUP BY 1),
  rec AS (SELECT o_orderkey AS market, date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) AS t, date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) + lines * {DAY} AS ft, rugged, CASE WHEN rugged THEN -100 ELSE value END AS value,
    concat_ws('|', o_orderpriority, {_CUT('o_totalprice', (15000, 30000, 60000))}, {_CUT('age', (7, 12, 20))}, {_CUT('top10', (15, 25, 40))}, {_CUT('ratio', ('0.35::DOUBLE', '0.75::DOUBLE', 1.5))}, {_CUT('share', ('0.48::DOUBLE', '0.58::DOUBLE', '0.68::DOUBLE'))}) AS context
    FROM orders JOIN sh ON o_orderkey = l_orderkey WHERE o_totalprice > 0),
  num AS (SELECT *, row_number() OVER (ORDER BY t, market) - 1 AS place, count(*) OVER () AS total_n FROM rec), sup AS (SELECT l_orderkey AS market, 'w' || l_suppkey AS wallet, max(l_linenumber) AS prior FROM lineitem GROUP BY 1, 2)"""


def g16_sql(p, supporters):
    """Decisions as CTEs with prefix p, of a relation of supporters (market, wallet, prior)."""
    learn = "1.0::DOUBLE AS n, hz::INT::DOUBLE AS h, (NOT hz)::INT::DOUBLE AS cn, CASE WHEN hz THEN 0 ELSE x END AS cs, CASE WHEN hz THEN 0 ELSE x * x END AS cq, x"
    zero = "0.0::DOUBLE AS n, 0.0::DOUBLE AS h, 0.0::DOUBLE AS cn, 0.0::DOUBLE AS cs, 0.0::DOUBLE AS cq, 0.0::DOUBLE AS x"
    sums = lambda w, a: ", ".join(f"sum({c}) OVER {w} AS {a}{c}" for c in ("n", "h", "cn", "cs", "cq", "x"))
    return f"""{p}lab AS (SELECT *, rugged OR value <= -80 AS hz, greatest(-100, least(100, value))::DOUBLE AS x FROM rec), {p}sup AS ({supporters}),
  {p}ev AS (SELECT market, t * 2 AS k, true AS dec, context, {zero} FROM {p}lab UNION ALL SELECT market, ft * 2 + 1, false, context, {learn} FROM {p}lab),
  {p}sm AS (SELECT market, dec, {sums('g', 'g')}, {sums('c', 'c')} FROM {p}ev WINDOW g AS (ORDER BY k RANGE UNBOUNDED PRECEDING), c AS (PARTITION BY context ORDER BY k RANGE UNBOUNDED PRECEDING)),
  {p}rk AS (SELECT l.*, gn, cn, ccn, ccs, ccq, (ch + (gh + 1.0::DOUBLE) / greatest(1, gn + 10) * 24) / greatest(1, cn + 24) AS risk, (ccs + gcs / greatest(1, gcn + 10) * 24) / greatest(1, ccn + 24) AS mean_,
    CASE WHEN ccn < 2 THEN 900 ELSE (greatest(0, (ccq - ccn * (ccs / ccn) * (ccs / ccn)) / greatest(1, ccn - 1)) * ccn + 900 * 24) / (ccn + 24) END AS var_ FROM {p}sm JOIN {p}lab l USING (market) WHERE dec),
  {p}up AS (SELECT *, {_UP('risk', '(cn + 24)')} AS risk_upper, (1 - risk) * mean_ + risk * -100 AS expected FROM {p}rk),
  {p}ms AS (SELECT *, expected - (greatest(0, risk_upper - risk) * 100 + 1.28::DOUBLE * sqrt(var_ / greatest(1, ccn + 24))) AS market_score FROM {p}up),
  {p}we AS (SELECT s.wallet, s.prior, m.market, m.t * 2 AS k, true AS dec, m.context, m.expected, 0.0::DOUBLE AS n, 0.0::DOUBLE AS x FROM {p}ms m JOIN {p}sup s USING (market) UNION ALL SELECT s.wallet, s.prior, m.market, m.ft * 2 + 1, false, m.context, 0, 1, m.x FROM {p}ms m JOIN {p}sup s USING (market)),
  {p}ws AS (SELECT *, sum(n) OVER w AS wn, sum(x) OVER w AS wx, sum(n) OVER c AS xn, sum(x) OVER c AS xx FROM {p}we WINDOW w AS (PARTITION BY wallet ORDER BY k RANGE UNBOUNDED PRECEDING), c AS (PARTITION BY wallet, context ORDER BY k RANGE UNBOUNDED PRECEDING)),
  {p}mv AS (SELECT market, wallet, prior, wn, CASE WHEN wn > 0 THEN ((xx + (wx + expected * 8) / greatest(1, wn + 8) * 8) / greatest(1, xn + 8) - expected) * wn / (wn + 8) END AS moved FROM {p}ws WHERE dec),
  {p}tp AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY moved DESC NULLS LAST, wn DESC, wallet) AS pn FROM {p}mv),
  {p}ag AS (SELECT market, count(moved) AS evidence, count(*) FILTER (WHERE prior >= 6) AS experienced, avg(moved) FILTER (WHERE pn <= 2) AS adj FROM {p}tp GROUP BY 1),
  {p}sc AS (SELECT m.*, gn::BIGINT AS history, evidence, experienced, market_score + coalesce(adj, 0) AS wallet_score FROM {p}ms m JOIN {p}ag USING (market)),
  {p}ls AS (SELECT *, list(market_score) OVER w AS a, list(wallet_score) OVER w AS b FROM {p}sc WINDOW w AS (ORDER BY t, market ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)),
  {p}th AS (SELECT * EXCLUDE (a, b), CASE WHEN len(a) >= 100 THEN list_sort(a)[ceil((len(a) - 1) * 0.9)::INT + 1] END AS market_threshold, CASE WHEN len(b) >= 100 THEN list_sort(b)[ceil((len(b) - 1) * 0.9)::INT + 1] END AS wallet_threshold FROM {p}ls),
  {p}dc AS (SELECT *, history >= 100 AS mature, risk_upper <= 0.12::DOUBLE AS gate, history >= 100 AND risk_upper <= 0.12::DOUBLE AND coalesce(market_score > 0 AND market_score >= market_threshold, false) AS by_market,
    history >= 100 AND risk_upper <= 0.12::DOUBLE AND evidence > 0 AND coalesce(wallet_score > 0 AND wallet_score >= wallet_threshold, false) AS by_wallet FROM {p}th)"""


G16_SHUFFLED = "SELECT a.market, s.wallet, s.prior FROM num a JOIN num b ON b.place = (a.place + greatest(1, floor(a.total_n * 0.382)::BIGINT)) % a.total_n JOIN sup s ON s.market = b.market"
_REASON = {"count": "n < few", "active-days": "days < short", "median<=0": "median <= 0", "average-ex-best<=2": "ex_best <= 2", "hit-rate<60%": "hit_rate < 0.6::DOUBLE", "profit-factor<1.3": "profit_factor < 1.3::DOUBLE", "rug-rate>3%": "rug_rate > 0.03::DOUBLE", "catastrophic-rate>3%": "catastrophic_rate > 0.03::DOUBLE", "best-winner-share>30%": "best_share > 0.3::DOUBLE"}
G16_POLICIES = (
    G16_RECORDS + ", " + g16_sql("d_", "SELECT * FROM sup") + ", " + g16_sql("x_", G16_SHUFFLED)
    + f""", cut AS (SELECT max(t) FILTER (WHERE place = floor(total_n * 0.4)) AS a, max(t) FILTER (WHERE place = floor(total_n * 0.6)) AS b, max(t) FILTER (WHERE place = floor(total_n * 0.8)) AS c FROM num),
  win AS (SELECT market, CASE WHEN t >= c THEN 'holdout2' WHEN t >= b THEN 'holdout1' WHEN t >= a THEN 'validation' ELSE 'train' END AS "window" FROM num, cut WHERE abs(t - a) >= {EMBARGO} AND abs(t - b) >= {EMBARGO} AND abs(t - c) >= {EMBARGO}),
  pk AS (SELECT 'broad' AS policy, market, t, value, rugged FROM d_dc WHERE mature UNION ALL SELECT 'market', market, t, value, rugged FROM d_dc WHERE by_market UNION ALL SELECT 'wallet', market, t, value, rugged FROM d_dc WHERE by_wallet UNION ALL SELECT 'shuffled', market, t, value, rugged FROM x_dc WHERE by_wallet),
  pw AS (SELECT *, 'all' AS "window" FROM pk UNION ALL SELECT pk.*, "window" FROM pk JOIN win USING (market)),
  st AS (SELECT policy, "window", count(*) AS n, count(DISTINCT t // {DAY}) AS days, avg(value) AS average, median(value) AS median, CASE WHEN count(*) > 1 THEN (sum(value) - max(value)) / (count(*) - 1) ELSE 0 END AS ex_best, avg((value > 0)::INT) AS hit_rate,
    CASE WHEN min(value) < 0 THEN sum(greatest(value, 0)) / -sum(least(value, 0)) WHEN max(value) > 0 THEN 999 ELSE 0 END AS profit_factor, avg(rugged::INT) AS rug_rate, avg((value <= -50)::INT) AS catastrophic_rate, min(value) AS worst, CASE WHEN max(value) > 0 THEN max(value) / sum(greatest(value, 0)) ELSE 0 END AS best_share FROM pw GROUP BY 1, 2),
  kd AS (SELECT p AS policy, w AS "window", few, short FROM (SELECT unnest(['broad', 'market', 'shuffled', 'wallet']) AS p), ({" UNION ALL ".join(f"SELECT '{w}' AS w, {a} AS few, {b} AS short" for w, (a, b) in S.LEAST.items())})),
  fl AS (SELECT policy, "window", few, short, coalesce(n, 0) AS n, coalesce(days, 0) AS days, {", ".join(f"coalesce({c}, 0) AS {c}" for c in G16_STATS)} FROM kd LEFT JOIN st USING (policy, "window")),
  rs AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _REASON.items())}) AS reasons FROM fl),
  vd AS (SELECT CASE WHEN (SELECT bool_and(reasons = '') FROM rs WHERE policy = 'wallet') AND (SELECT bool_and(a.ex_best > b.ex_best) FROM rs a JOIN rs b USING ("window") WHERE a.policy = 'wallet' AND b.policy IN ('market', 'shuffled') AND "window" NOT IN ('all', 'train')) THEN 'future-shadow-only' ELSE 'reject' END AS verdict)
  SELECT policy, "window", n, days, {", ".join(st(c, c) for c in G16_STATS)}, reasons, verdict FROM rs, vd"""
)

TRADED = SIG + PO.PLAN.removeprefix(PO.SIGS) + """, got AS (SELECT *, 100 / entry_price * CASE WHEN reason IN ('rug', 'liquidity_failure') THEN 0 ELSE coalesce(exit_price, entry_price) * (1 - 50.0::DOUBLE / 10000) END AS got FROM plan),
  traded AS (SELECT *, got - 100 - (got + 100) * 30 / 10000 AS pnl, got - 100 - (got + 100) * 30 / 10000 AS r, (coalesce(exit_t, entry_t) - entry_t) / 60 AS held FROM got)"""


def _levels_sql():
    """The thresholds of each axis, from a sort of all its values; FREE is null until the axes are listed."""
    parts = []
    for a in C.AXES:
        qs = ", ".join(f"{q!r}::DOUBLE" for q in a.quantiles)
        fixed = ", ".join("'inf'::DOUBLE" if x == C.FREE else f"{float(x)}::DOUBLE" for x in a.fixed)
        most = C.MOST_THRESHOLDS - (C.FREE in a.fixed)
        parts.append(f"""SELECT '{a.column}' AS "column", threshold FROM (SELECT threshold, row_number() OVER (ORDER BY threshold) AS p FROM (
          SELECT DISTINCT floor(list_sort(v)[floor((len(v) - 1) * q)::BIGINT + 1] * 100 + 0.5) / 100 AS threshold FROM (SELECT list({a.column})::DOUBLE[] AS v FROM feat), (SELECT unnest([{qs}]) AS q)
          UNION SELECT unnest([{fixed}])) WHERE threshold < 'inf'::DOUBLE) WHERE p <= {most}""")
        if C.FREE in a.fixed:
            parts.append(f"SELECT '{a.column}', 'inf'::DOUBLE")
    return " UNION ALL ".join(parts)


def _shown_sql(x):
    return f"CASE WHEN {x} = 'inf'::DOUBLE THEN 'inf' ELSE regexp_replace({x}::DECIMAL(38,2)::VARCHAR, '\\.?0+$', '') END"


LEVELS = SPLIT + f""", flow AS (SELECT token, t // {FLOW} AS stretch, sum(floor(price_usd * 100)) AS volume_usd, count(*) AS swaps FROM prices GROUP BY 1, 2),
  feat AS (SELECT liquidity_usd, volume_usd, swaps, volume_usd / greatest(liquidity_usd, 1) AS volume_per_liquidity FROM win JOIN flow ON win.token = flow.token AND win.t // {FLOW} = flow.stretch WHERE "window" = 'train'),
  levels AS ({_levels_sql()})"""
GRID = LEVELS + f""", cohorts AS (SELECT unnest(c) AS c FROM (SELECT [{", ".join(f"{{'cohort': '{n}', 'balanced': {b}, 'repeats': {list(r)}}}" for n, b, r in C.COHORTS)}] AS c)),
  who AS (SELECT c.cohort AS cohort, c.balanced AS balanced, unnest(c.repeats) AS min_repeat FROM cohorts),
  shares AS (SELECT s.low AS min_share, s.high AS max_share FROM (SELECT unnest([{", ".join(f"{{'low': {a}::DOUBLE, 'high': {b}::DOUBLE}}" for a, b in C.SHARES)}]) AS s)),
  ages AS (SELECT unnest([{", ".join("'inf'::DOUBLE" if a == C.FREE else f"{a}::DOUBLE" for a in C.AGES)}]) AS max_age),
  free AS (
    SELECT who.*, l.threshold AS min_liquidity_usd, r.threshold AS max_ratio, max_age FROM who, levels l, levels r, ages WHERE NOT balanced AND l."column" = 'liquidity_usd' AND r."column" = 'volume_per_liquidity'
    UNION ALL SELECT who.*, 0, 'inf'::DOUBLE, 'inf'::DOUBLE FROM who WHERE balanced),
  cands AS (SELECT *, v.threshold AS min_volume_usd, s.threshold AS max_swaps FROM free, shares, levels v, levels s WHERE v."column" = 'volume_usd' AND s."column" = 'swaps'),
  labels_ AS (SELECT *, cohort || ' / repeat>=' || min_repeat || ' / liq>=' || {_shown_sql("min_liquidity_usd")} || ' / vol5m>=' || {_shown_sql("min_volume_usd")} || ' / buyShare=' || {_shown_sql("min_share")} || '-' || {_shown_sql("max_share")}
    || ' / swaps<=' || {_shown_sql("max_swaps")} || ' / vlr<=' || {_shown_sql("max_ratio")} || ' / age<=' || {_shown_sql("max_age")} AS label FROM cands)"""

QUERIES = {
    "g1_rule_candidates": (g1, REC + ", hit AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, * FROM rec WHERE {v}" for k, v in RULES.items()) + f"), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule, token ORDER BY t, tie) AS pn FROM hit) WHERE pn = 1), a AS (SELECT rule, {AGG} FROM f GROUP BY 1) SELECT rule, {SHOW} FROM a"),
    "g2_exit_grid": (g2, PRICES[:-1] + PO.PATH + ", cfg AS (" + " UNION ALL ".join(f"SELECT '{n}' AS exit, {a}::DOUBLE AS take, {b}::DOUBLE AS stop, {c} AS tmo" for n, a, b, c in EXITS) + f"""),
        x AS (SELECT *, CASE WHEN t - t0 >= tmo THEN 'timeout' WHEN ret >= take THEN 'take-profit' WHEN ret <= stop THEN 'stop-loss' END AS reason FROM pt, cfg),
        y AS (SELECT *, row_number() OVER (PARTITION BY exit, token ORDER BY (reason IS NULL)::INT, CASE WHEN reason IS NULL THEN -t ELSE t END, CASE WHEN reason IS NULL THEN -tie ELSE tie END) AS pn FROM x),
        z AS (SELECT exit, coalesce(reason, 'provisional') AS reason, CASE reason WHEN 'take-profit' THEN take WHEN 'stop-loss' THEN stop ELSE ret END - 3 AS value FROM y WHERE pn = 1),
        a AS (SELECT exit, {AGG}, {', '.join(f"avg((reason = '{r}')::INT) AS share_{r.replace('-', '_')}" for r in ('take-profit', 'stop-loss', 'timeout', 'provisional'))} FROM z GROUP BY 1)
        SELECT exit, {', '.join(st(f'share_{r}', f'share_{r}') for r in ('take_profit', 'stop_loss', 'timeout', 'provisional'))}, {SHOW} FROM a"""),
    "g3_method_summary": (g3, REC + f", a AS (SELECT 'm' || entry_key % 7 AS method, {AGG} FROM rec GROUP BY 1) SELECT method, {SHOW} FROM a"),
    "g4_walk_forward_split": (g4, SPLIT + ' SELECT entry_key, "window" FROM win'),
    "g5_lock_best": (g5, LOCK + " SELECT * FROM lk"),
    "g6_threshold_grid": (g6, REC + f""", s AS (SELECT liquidity_usd, row_number() OVER (ORDER BY liquidity_usd) - 1 AS p FROM rec), n AS (SELECT count(*) AS n FROM rec)
        SELECT DISTINCT threshold FROM (SELECT round(liquidity_usd, 2) AS threshold FROM s, n WHERE p IN (floor((n - 1) * 0.1), floor((n - 1) * 0.25), floor((n - 1) * 0.5), floor((n - 1) * 0.75), floor((n - 1) * 0.9)) UNION ALL SELECT 10000.0::DOUBLE UNION ALL SELECT 50000.0::DOUBLE) ORDER BY threshold LIMIT 6"""),
    "g6_axis_levels": (g6_levels, LEVELS + """ SELECT "column", CASE WHEN threshold < 'inf'::DOUBLE THEN threshold END AS threshold FROM levels"""),
    "g6_candidate_grid": (g6_grid, GRID + f""" SELECT substr(sha256(label), 1, 16) AS id, label, cohort, min_repeat, min_liquidity_usd, min_volume_usd, min_share, max_share,
        min_repeat = 0 AND min_liquidity_usd = 0 AND min_volume_usd = 0 AND min_share = 0 AND max_share = 1 AND max_swaps = 'inf'::DOUBLE AND max_ratio = 'inf'::DOUBLE AND max_age = 'inf'::DOUBLE AS baseline
        FROM labels_ ORDER BY baseline DESC, id LIMIT {C.MOST_CANDIDATES}"""),
    "g7_evaluate_candidates": (g7, EVAL + f' SELECT candidate, "window", passed, {SHOW} FROM ev'),
    "g8_search_decision": (g8, LOCK + """, h AS (SELECT candidate, count(*) FILTER (WHERE passed) AS hp, sum(n)::BIGINT AS hn FROM ev WHERE "window" IN ('holdout1', 'holdout2') GROUP BY 1)
        SELECT lk.candidate, CASE WHEN validation_passed AND hp = 2 THEN 'accepted' WHEN validation_passed THEN 'failed-holdout' ELSE 'rejected' END AS verdict, coalesce(hp, 0) AS holdouts_passed, coalesce(hn, 0) AS holdout_n FROM lk LEFT JOIN h ON lk.candidate = h.candidate"""),
    "g10_causal_supporters": (g10, MK + f""", comp AS (SELECT e.wallet, e.t + {DAY} AS ft, (e.entry_key * 37 % 101 - 45) < -20 AS bad FROM entries e), who AS (SELECT DISTINCT mk.market, mk.t, e.wallet FROM mk JOIN entries e ON mk.pool = e.pool AND e.t BETWEEN mk.t - {8 * DAY} AND mk.t),
        h AS (SELECT w.market, w.wallet, count(c.ft) AS n, count(*) FILTER (WHERE c.bad) AS b FROM who w LEFT JOIN comp c ON w.wallet = c.wallet AND c.ft < w.t GROUP BY 1, 2)
        SELECT mk.market, count(h.wallet) AS supporters, count(*) FILTER (WHERE h.n >= 3 AND h.b = 0) AS safe3, coalesce(sum(h.n), 0)::BIGINT AS history FROM mk LEFT JOIN h ON mk.market = h.market GROUP BY 1"""),
    "g11_modeled_return": (g11, REC + " SELECT entry_key, CASE WHEN rugged THEN -100 ELSE value - greatest(0, 7.1::DOUBLE - entry_key % 9) END AS modeled FROM rec"),
    "g12_creator_history": (g12, REC + f" SELECT a.entry_key AS decision, count(b.entry_key) AS prior_n, count(*) FILTER (WHERE b.value < -20) AS prior_bad, {st('avg(b.value)', 'prior_mean')} FROM rec a LEFT JOIN rec b ON a.wallet = b.wallet AND b.t + {DAY} < a.t GROUP BY 1"),
    "g14_delay_sensitivity": (g14, SIG + f""", dl AS (SELECT unnest([0, 7200, 18000, 36000])::INTEGER AS delay), b AS (SELECT signal_key, delay, arg_min(p.price_usd, (p.t, p.obs_key)) AS buy FROM sigs, dl, prices p WHERE sigs.token = p.token AND p.t BETWEEN sigs.t + delay AND sigs.t + delay + 21600 GROUP BY 1, 2),
        s AS (SELECT signal_key, arg_min(p.price_usd, (p.t, p.obs_key)) AS sell FROM sigs JOIN prices p ON sigs.token = p.token AND p.t BETWEEN sigs.t + {3 * DAY} AND sigs.t + {3 * DAY + 21600} GROUP BY 1),
        r AS (SELECT dl.delay, CASE WHEN buy > 0 THEN (sell / buy - 1) * 100 END AS value FROM sigs CROSS JOIN dl LEFT JOIN b ON b.signal_key = sigs.signal_key AND b.delay = dl.delay LEFT JOIN s ON s.signal_key = sigs.signal_key),
        a AS (SELECT delay, {AGG} FROM r WHERE value IS NOT NULL GROUP BY 1), c AS (SELECT delay, {st('avg((value IS NOT NULL)::INT)', 'coverage')} FROM r GROUP BY 1) SELECT c.delay, c.coverage, {SHOW} FROM c LEFT JOIN a ON a.delay = c.delay"""),
    "g15_market_supporters": (g15, MK + f" SELECT market, string_agg(DISTINCT wallet, ',' ORDER BY wallet) AS wallets, count(DISTINCT wallet) AS n FROM mk JOIN entries e ON mk.pool = e.pool AND e.t BETWEEN mk.t - {8 * DAY} AND mk.t GROUP BY 1"),
    "g16_contextual_risk": (g16, REC + f""", h AS (SELECT a.entry_key AS decision, count(b.entry_key) AS n, count(*) FILTER (WHERE b.value < -20) AS bad FROM rec a LEFT JOIN rec b ON a.token = b.token AND b.t + {DAY} < a.t GROUP BY 1), p AS (SELECT *, (bad + 5) / (n + 10) AS risk, n + 10 AS m FROM h)
        SELECT decision, n AS prior_n, {st('risk', 'risk')}, {st('least(1, (risk + 2.706025 / (2 * m) + 1.645 * sqrt((risk * (1 - risk) + 2.706025 / (4 * m)) / m)) / (1 + 2.706025 / m))', 'risk_upper')} FROM p"""),
    "g16_online_threshold": (g16t, PRICES + """SELECT obs_key, CASE WHEN len(l) >= 100 THEN list_sort(l)[ceil((len(l) - 1) * 0.9)::INT + 1] END AS threshold FROM (SELECT obs_key, list(price_usd) OVER (PARTITION BY event_type ORDER BY t, obs_key ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS l FROM prices)"""),
    "g16_decisions": (g16_decisions, G16_RECORDS + ", " + g16_sql("d_", "SELECT * FROM sup") + f" SELECT market, context, history, {', '.join(st(c, c) for c in G16)}, evidence, experienced, mature, gate, by_market, by_wallet FROM d_dc"),
    "g16_contextual_survival": (g16_policies, G16_POLICIES),
    "g17_trade_metrics": (g17, TRADED + f""" SELECT CASE WHEN entry_price < 40 THEN 'low' ELSE 'high' END AS bucket, count(*) AS n, {st('avg((r > 0)::INT)', 'win_rate')},
        {st("CASE WHEN min(r) < 0 THEN sum(greatest(r, 0)) / -sum(least(r, 0)) WHEN max(r) > 0 THEN 999 ELSE 0 END", 'profit_factor')}, {st('avg(r)', 'mean_')}, {st('median(r)', 'median_')},
        {st('quantile_cont(r, 0.05)', 'tail')}, {st('avg(held)', 'hold')}, {st("avg((reason = 'rug')::INT)", 'rug_rate')} FROM traded GROUP BY 1"""),
    "g17_replay_metrics": (g17_replay, TRADED + f""", conf AS (SELECT signal_key, floor(100 * count(*) FILTER (WHERE p.liquidity_usd >= 20000) / count(*)) AS c FROM sigs s JOIN prices p ON s.token = p.token AND p.t <= s.t GROUP BY 1),
        j AS (SELECT c, pnl, r, held, reason FROM conf LEFT JOIN traded ON conf.signal_key = traded.signal_key)
        SELECT count(pnl) AS trades, count(*) AS signals, {st('count(*) FILTER (WHERE pnl > 0) / count(pnl)', 'win_rate')}, {st('sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl <= 0)', 'profit_factor')},
        {st('avg(r)', 'mean_')}, {st('median(r)', 'median_')}, {st('avg(held)', 'hold')}, {st("count(*) FILTER (WHERE reason = 'rug') / count(pnl)", 'rug_rate')},
        {st("count(*) FILTER (WHERE pnl IS NULL OR reason = 'liquidity_failure') / count(*)", 'liquidity_failure_rate')},
        {", ".join(st(f"count(*) FILTER (WHERE pnl > 0 AND c >= {lo} AND c < {hi}) / greatest(count(*) FILTER (WHERE c >= {lo} AND c < {hi}), 1)", f'precision_{b}') for b, lo, hi in (('0_49', 0, 50), ('50_69', 50, 70), ('70_84', 70, 85), ('85_100', 85, 101)))},
        {st('list_sort(list(r) FILTER (WHERE r IS NOT NULL))[floor(count(pnl) * 0.05::DOUBLE)::BIGINT + 1]', 'tail')} FROM j"""),
    "g20_goal_audit": (g20, ROWS + f", pl AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY t, tie) - 1 AS place FROM rets), x AS (SELECT *, CASE WHEN place >= 20 THEN 'late' ELSE 'middle' END AS part FROM pl WHERE place >= 10), a AS (SELECT wallet, part, {AGG} FROM x GROUP BY 1, 2) SELECT wallet, count(*) AS parts, bool_and(mean_ > 0 AND median_ >= 0) AS ok, sum(n)::BIGINT AS n FROM a GROUP BY 1"),
    "g21_hypothesis_persistence": (g21, """WITH b AS (SELECT *, sum((o_orderstatus = 'P')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS bad FROM orders)
        SELECT o_custkey AS hypothesis, count(*) FILTER (WHERE bad = 0) AS streak, coalesce(max(CASE WHEN bad = 0 THEN o_orderkey END) - min(CASE WHEN bad = 0 THEN o_orderkey END), 0) AS span FROM b GROUP BY 1"""),
    "g25_data_quality": (g25, PRICES + "SELECT event_type, count(*) AS rows, count(DISTINCT token) AS tokens, count(*) FILTER (WHERE price_usd <= 0) AS unpriced, min(t) AS first_t, max(t) AS last_t FROM prices GROUP BY 1"),
    "g26_backfill_status": (g26, "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial, count(*) AS n FROM orders GROUP BY 1"),
    "g28_decision_history": (g28, PRICES + "SELECT token, obs_key, place::INTEGER AS place FROM (SELECT token, obs_key, row_number() OVER (PARTITION BY token ORDER BY t DESC, obs_key DESC) AS place FROM prices) WHERE place <= 20"),
    "g29_decision_digest": (g29, REC + ", h AS (SELECT token, sha256(concat_ws('|', entry_key, wallet, pool)) AS h FROM rec) SELECT token, sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*) AS n FROM h GROUP BY 1"),
}
