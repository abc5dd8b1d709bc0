"""Rules by cases worked out by hand."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.common import deterministic_id
from tidemark.operators import audit, health, ingest, market, wallets
from tidemark.operators import market as M


def scored(spark, values):
    rows = spark.createDataFrame([("w", float(v)) for v in values], "wallet string, value double")
    r = audit.evidence_score(rows).first()
    return round(r.score, 6), r.confidence


@pytest.mark.parametrize(
    ("values", "score", "confidence"),
    [
        ([5, 5], 0, "insufficient"),  # too few
        ([5, 5, 5], 30 + 9 + 5 + 20 + 10, "watch"),  # three are not enough for a candidate
        ([5, 5, 5, 5], 30 + 12 + 5 + 20 + 10, "candidate"),
        ([5, 5, 5, 20], 30 + 12 + 8.75 + 20 + 10, "watch"),  # one win has 57 % of all gains
        ([1, 1, 1, 1], 30 + 12 + 1 + 20 + 10, "watch"),  # a mean below 2
        ([30, 30, 30, -36], 0, "insufficient"),  # a loss below -35
        ([30, 30, 30, 30, -35], 30 + 15 + 17 + 16 + 10, "candidate"),
        ([40] * 12, 100, "candidate"),  # mean and count are bounded: 30 + 30 + 20 + 20 + 10
        ([10, -1, -1], 0, "insufficient"),  # fewer than half win
    ],
)
def test_evidence_score(spark, values, score, confidence):
    assert scored(spark, values) == (score, confidence)


@pytest.mark.parametrize(
    ("qualities", "want"),
    [
        (["observed-execution", "historical-observed"], "observed-execution"),
        (["observed-execution", "oracle-converted"], "oracle-converted"),
        (["oracle-converted", "historical-estimate", "price-proxy"], "historical-estimate"),
        (["observed-execution", "observed-balance"], "market-proxy"),
        (["price-proxy", "market-proxy"], "market-proxy"),
    ],
)
def test_price_qualities_combine_to_the_weakest(spark, qualities, want):
    rows = spark.createDataFrame([(q,) for q in qualities], "q string").select(ingest.price_quality(F.col("q")).alias("q"))
    assert rows.agg(ingest.combine_qualities(F.col("q")).alias("x")).first().x == want


def test_given_quality_comes_first_and_unknown_is_null(spark):
    rows = spark.createDataFrame([("price-proxy", "oracle-converted"), ("price-proxy", None), ("other", None)], "q string, given string")
    assert [r[0] for r in rows.select(ingest.price_quality(F.col("q"), F.col("given"))).collect()] == ["oracle-converted", "market-proxy", None]


def test_watch_mode(spark):
    flags = ("method", "rule", "exit", "replay", "wallet", "watched")
    cases = [
        ((1, 1, 1, 1, 1, 0), ("paper-validate candidate", "validated paper system candidate", True, False, False)),
        ((1, 1, 1, 0, 1, 0), ("paper-watch", "wallet candidate emerging", False, True, True)),
        ((1, 1, 1, 0, 0, 0), ("observe-only", "collecting evidence", False, False, False)),
        ((0, 0, 0, 0, 0, 1), ("paper-watch", "collecting evidence", False, False, True)),
    ]
    rows = spark.createDataFrame([(i, *map(bool, c)) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{f} boolean" for f in flags))
    got = rows.select("i", *[c.alias(n) for n, c in wallets.watch_mode({f: F.col(f) for f in flags[:5]}, [F.col("watched")]).items()]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [w for _, w in cases]


def test_traction_score(spark):
    rows = spark.createDataFrame(
        [(1e6, 1000.0, 10_000.0, 9, 1, 5, 5, 10.0, -20.0, 90.0), (3e6, 0.0, 0.0, 0, 0, 0, 0, 500.0, -500.0, None), (1.0, 1e9, 1e9, 1, 0, 1, 0, 0.0, 0.0, 1e6)],
        "l double, v5 double, v1 double, b5 int, s5 int, b1 int, s1 int, c5 double, c1 double, age double",
    )
    c = F.col
    score = market.traction_score(c("l"), c("v5"), c("v1"), (c("b5"), c("s5")), (c("b1"), c("s1")), (c("c5"), c("c1")), c("age"))
    got = [round(r[0], 6) for r in rows.select(score).collect()]
    assert got[0] == round(39 + 35 + 25 + 16 + 24 * 0.05 + 0.8 - 1 + 17, 6)
    assert got[1] == round(0 + 0 + 25 - 10 - 8 + 12 - 12 + 0 - 8, 6)
    assert got[2] == round(45 + 35 + 0 + 16 + 12, 6)


def test_token_durability(spark):
    rows = [("a", 0, 1, 1.0, 50_000.0, 9, 1, 2, 1, 1), ("a", 600, 2, 2.0, 50_000.0, 9, 1, 2, 1, 0), ("a", 1200, 3, 1.5, 20_000.0, 6, 4, 2, 0, 1), ("b", 0, 1, 4.0, 5000.0, 0, 3, 0, 0, 0), ("b", 60, 2, 3.0, 5000.0, 0, 3, 0, 0, 0)]
    obs = spark.createDataFrame(rows, "token string, t long, obs_key long, price_usd double, liquidity_usd double, buys5m int, sells5m int, wallet_events int, cross_wallets int, active_wallets int")
    got = {r.token: r for r in wallets.token_durability(obs).collect()}
    assert (got["a"].last_pct, got["a"].max_pct, got["a"].min_pct, got["a"].age_minutes) == (50, 100, 0, 20)
    assert round(got["a"].score, 6) == round(27.5 + 18 + 20 + 2.8 + 0 + 22 + 8, 6)
    assert round(got["b"].score, 6) == round(-25 * 0.55 + 0 + 5 - 8 - 15 - 10, 6)


def test_early_wallets_and_history(spark):
    events = [("w1", "t1", "buy", 2, 90.0), ("w1", "t2", "buy", 6, 80.0), ("w2", "t1", "buy", 18, 90.0), ("w2", "t1", "sell", 20, 90.0), ("w2", "t1", "sell", 21, 90.0), ("w3", "t1", "buy", 19, 90.0), ("w4", "t3", "buy", 12, None)]
    rows = spark.createDataFrame(events, "wallet string, token string, side string, rank int, candidate_score double")
    got = {r.wallet: (round(r.pressure, 4), r.labels) for r in wallets.early_wallets(rows).collect()}
    assert got == {
        "w1": (100.0, "cross-token active degen,very early buyer,high-traction participant"),
        "w2": (round(11 + 18 + 90 * 0.55 - 10 - 18 * 0.4, 4), "high-traction participant,fast seller / possible bot"),
        "w4": (round(11 + 18 - 12 * 0.4, 4), "single-token early buyer"),
    }
    seen = [("a", f"m{i}x", "buy") for i in range(4)] + [("a", "m0x", "buy"), ("b", "m1", "sell"), ("c", "m1", "buy"), ("c", "m1", "sell")]
    history = wallets.history_labels(wallets.wallet_history(spark.createDataFrame(seen, "wallet string, token string, side string"), "x"))
    assert {r.wallet: (r.score, r.labels) for r in history.collect()} == {"a": (100, "active pump degen wallet,multi-token recent buyer,net recent accumulator"), "b": (0, "fast churn seller"), "c": (17, "limited recent history")}


def test_retire_rows_with_nulls(spark):
    rows = spark.createDataFrame([("k", 5, None), ("k", 11, None), ("x", 5, "v"), (None, 5, "v")], "key string, t long, v string")
    gaps = spark.createDataFrame([("k", 0, 10), ("k", 10, 3), ("x", 500_000, 900_000)], "key string, low long, high long")
    assert sorted(ingest.archive_gated_retire(rows, gaps, "key", "t").collect(), key=repr) == sorted([("k", 11, None), ("x", 5, "v"), (None, 5, "v")], key=repr)


def test_quantities_are_exact(spark):
    rows = [("m", 18, Decimal(123456789012345678901), None), ("m", 9, Decimal(7), None), ("n", 0, None, Decimal("2.123456789012")), ("n", 0, None, Decimal("-0.0000000000005")), ("o", 30, Decimal(1), None), ("o", 0, Decimal(10**20), None)]
    trades = spark.createDataFrame(rows, "m string, base_decimals int, base_raw decimal(38,0), base_amount decimal(38,18)")
    got = {(r.m, r.base_raw, r.base_amount): r.base_units for r in ingest.normalize_quantity(trades, ["m"]).collect()}
    assert got["m", Decimal(123456789012345678901), None] == 123456789012345678901 and got["m", Decimal(7), None] == 7 * 10**9
    assert [v for (m, *_), v in got.items() if m == "n"] in ([2123456789012, -1], [-1, 2123456789012])
    assert got["o", Decimal(1), None] == 1 and got["o", Decimal(10**20), None] is None  # set aside, as 10^50 does not fit


def test_merge_does_not_multiply(spark):
    old = spark.createDataFrame([(1, None, "a")], "k long, x string, y string")
    new = spark.createDataFrame([(1, "p", "z"), (1, "q", "z"), (2, "r", None)], "k long, x string, y string")
    assert sorted(map(tuple, ingest.merge_fill_nulls(old, new, ["k"], ["x", "y"]).collect())) == [(1, "p", "a", True), (2, "r", None, False)]


def test_ids_of_nulls_differ(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (None, "a", "b")], "x string, y string, z string")
    assert len({r[0] for r in rows.select(deterministic_id(F.col("x"), F.col("y"), F.col("z"))).collect()}) == 3


def watched(spark, returns, labels="", **history):
    o = spark.createDataFrame([("w", "mature", float(r), 60.0) for r in returns] + [("w", "provisional", 7.0, 30.0)], "wallet string, status string, return_pct double, age_minutes double")
    h = {"mints": 0, "suffixed": 0, "history_score": 0.0} | history
    w = spark.createDataFrame([("w", labels, h["mints"], h["suffixed"], h["history_score"])], "wallet string, labels string, mints long, suffixed long, history_score double")
    r = wallets.watch_wallet_score(o, w).first()
    return round(r.score, 6), r.confidence, r.provisional


@pytest.mark.parametrize(
    ("returns", "labels", "score", "confidence"),
    [
        ([], "", 0, "early"),
        ([10], "", 16 + 8 + 1.5 + 25, "early"),
        ([10, 10, 10, 10], "", 64 + 34.5, "high"),
        ([10, 10, 10, 10], "fast churn seller", 60, "high"),  # capped
        ([10, 10, -40], "", 48 - 5.333333 + 1.5 - 12 + 16.666667, "early"),  # a negative mean, below its cap of 55
        ([30, 30, -40], "", 48 + 5.333333 + 4.5 - 12 + 16.666667, "medium"),
        ([90, 90, 90, -60], "cross-token active degen,net recent accumulator", 50, "early"),  # a loss below -50
    ],
)
def test_watch_wallet_score(spark, returns, labels, score, confidence):
    got = watched(spark, returns, labels)
    assert got == (pytest.approx(score, abs=1e-4), confidence, 1)


def test_watch_wallet_summary_and_near(spark):
    rows = spark.createDataFrame([("a", 4, 4, 0, 0, "candidate"), ("b", 2, 0, 0, 2, "watch"), ("c", 1, 0, 0, 1, "watch"), ("d", 1, 0, 1, 0, "watch")], "wallet string, signals long, matured long, provisional long, unresolved long, verdict string")
    assert wallets.watch_wallet_summary(rows).first() == (4, 4, 1, 3, 1, 1, 1, 4)
    assert sorted(r.wallet for r in wallets.near_wallets(rows).collect()) == ["b", "d"]
    assert wallets.watch_wallet_summary(rows.limit(0)).first() == (0, 0, 0, 0, 0, 0, 0, 0)


def test_historical_market_obs(spark):
    schema = "candidate_key string, signature string, mint string, side string, amount double, native double, confidence double, source string, payer string"
    rows = [("1", "s", "m", "buy", 4.0, 2.0, 0.55, "transfer-derived", "me"), ("2", "s", "n", "sell", 1.0, 3.0, 1.7, "swap-event", "me"), ("3", "s", "m", None, 1.0, 1.0, 0.5, "swap-event", "me"), ("4", "s", "m", "buy", 0.0, 1.0, 0.5, "swap-event", "me")]
    buys = spark.createDataFrame([("s", "m", "p2", "late", "b"), ("s", "m", "p1", "early", "a")], "signature string, mint string, pool string, trader string, place string")
    got = wallets.historical_market_obs(spark.createDataFrame(rows, schema), buys, 100.0, "v").orderBy("mint").collect()
    assert [(r.mint, r.pool, r.trader, r.price_quote, r.price_usd, r.volume_usd, r.confidence) for r in got] == [("m", "p1", "early", 0.5, 50.0, 200.0, 0.75), ("n", None, "me", 3.0, 300.0, 300.0, 1.0)]


NOW = 1_000_000
WORK = {"strategy": "s", "revision": 2, "completed": 1, "admission": "admitted", "priority": 2, "not_before": NOW - 5, "locked_until": None, "pending_since": NOW - 100, "failed": False, "quarantined": False}


def pipeline(spark, work=(), inbox=(("done", "pool_created", NOW - 10),), high=NOW):
    queue = spark.createDataFrame([tuple((WORK | w).values()) for w in work], "strategy string, revision long, completed long, admission string, priority int, not_before long, locked_until long, pending_since long, failed boolean, quarantined boolean")
    box = spark.createDataFrame(list(inbox), "status string, type string, t long")
    t = spark.createDataFrame([(NOW - 86_400,), (NOW - 86_401,)], "t long")
    sent = spark.createDataFrame([("qualified-pool", "delivered", "v", NOW - 1), ("qualified-pool", "delivered", "old", NOW - 1)], "type string, status string, version string, t long")
    return health.pipeline_status(box, queue, t, sent, t, spark.createDataFrame([("a", 5, high)], "program string, low long, high long"), "s", "v", NOW).first()


def test_pipeline_status(spark):
    r = pipeline(spark)
    assert (r.status, r.pending, r.oldest_ready_s, r.pool_age_s, r.signals_24h, r.pools_24h, r.trade_age_s) == ("ok", 0, None, 10, 1, 1, 86_400)
    r = pipeline(spark, [{}, {"completed": 2}, {"strategy": "other"}, {"locked_until": NOW + 1, "pending_since": 0}])
    assert (r.status, r.pending, r.ready, r.signal_pending, r.oldest_signal_s) == ("ok", 2, 1, 2, 100)
    assert pipeline(spark, [{"pending_since": NOW - 301}]).status == "degraded"
    assert pipeline(spark, [{"pending_since": NOW - 301, "priority": 1}]).status == "ok"
    r = pipeline(spark, [{"failed": True, "quarantined": True, "not_before": NOW + 1}])
    assert (r.status, r.failed, r.quarantined) == ("ok", 0, 1)
    assert pipeline(spark, [{"failed": True}]).status == "degraded"
    assert pipeline(spark, high=None).open_incidents == 1 and pipeline(spark, high=None).status == "degraded"
    r = pipeline(spark, inbox=())
    assert (r.status, r.backlog, r.pool_age_s) == ("degraded", 0, None)


def test_open_incidents(spark):
    rows = spark.createDataFrame([("b", 5, None), ("a", 5, None), ("c", 1, 9)], "program string, low long, high long")
    assert [(r.program, r.disposition) for r in health.open_incidents(rows).collect()] == [("a", "alpha_excluded_unreconciled"), ("b", "alpha_excluded_unreconciled")]


def decided(spark, keys=(), method=("cross-token", 3, 2.0, 5.0, 2.0, 0.65, 0.55, -15.0, -35.0), replay=True):
    runs = spark.createDataFrame([("r", 6, 1, replay)], "run string, n_runs long, quality_tokens long, replay_passed boolean")
    schema = "run string, place int, method string, tokens long, median_pct double, avg_pct double, ex_best_pct double, best_share double, hit_rate double, drawdown_pct double, worst_pct double"
    rows = [("r", 2, "other", 99, *[-99.0] * 7)] + [("r", 1, *method)] if method else []
    decisions = [("r", kind, *["k" if key in names else None for key in wallets.KEYS]) for kind, *names in keys]
    return wallets.decision_status(runs, spark.createDataFrame(rows, schema), spark.createDataFrame(decisions, "run string, kind string, " + ", ".join(f"{k} string" for k in wallets.KEYS))).first()


def test_decision_status(spark):
    whole = [(k, "validated") for k in ("method", "rule", "exit")]
    r = decided(spark)
    assert (r.verdict, r.mode, r.enough_runs, r.enough_tokens, r.positive_enough, r.risk_controlled, r.only_traction) == ("keep-watching", "observe-only", True, True, True, True, False)
    assert decided(spark, method=("cross-token", 3, 2.0, 5.0, 2.0, 0.66, 0.55, -15.0, -35.0)).verdict == "stand-down"
    assert decided(spark, method=("high-traction", 7, 2.0, 5.0, 2.0, 0.65, 0.55, -15.0, -35.0)).enough_tokens is False
    assert decided(spark, whole).verdict == "system-candidate" and decided(spark, whole, replay=False).verdict == "keep-watching"
    r = decided(spark, [("wallet", "validated")])
    assert (r.verdict, r.mode, r.wallet_validated) == ("wallet-only", "paper-watch", "k")
    r = decided(spark, method=None)
    assert (r.verdict, r.enough_tokens, r.positive_enough, r.risk_controlled, r.minimum_signals) == ("stand-down", False, False, False, 3)
    assert decided(spark, [("exit", "watch")], method=None).verdict == "keep-watching"


def test_evidence_funnel(spark):
    prices = spark.createDataFrame([("p",), ("q",), (None,), ("p",)], "pool string")
    entries = spark.createDataFrame([(1, "w", "a", 0, True, True, 2, 5), (2, "w", "b", 0, True, False, 3, 0), (3, "v", "a", 0, True, True, 1, 5), (4, "u", "c", 0, False, True, 9, 5), (5, "u", "d", 0, None, True, 9, 5)], "entry_key long, wallet string, token string, t long, linked boolean, controlled boolean, repeat_wallets int, slot long")
    kind = "fixed-horizon"
    rows = [(1, "mature", kind, 5.0, 100, False), (1, "mature", kind, 5.0, 105, False), (2, "mature", kind, -99.0, 50, True), (3, "mature", kind, 5.0, 50, False), (3, "unresolved", kind, None, None, False), (3, "provisional", "barrier", 1.0, None, False), (4, "mature", kind, 5.0, 100, False)]
    outcomes = spark.createDataFrame(rows, "entry_key long, status string, exit_strategy string, net_pct double, frozen_t long, rugged boolean")
    r = audit.evidence_funnel(prices, entries, outcomes, 100, 10).first()
    assert (r.pools, r.eligible, r.entries, r.exploratory, r.repeating_wallets, r.missing_slots) == (2, 1, 3, 2, 1, 1)
    assert (r.mature, r.invalid, r.early_rugs, r.provisional, r.unresolved) == (2, 1, 1, 0, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_persist_on_change_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(400), i, rng.random() < 0.8, rng.random() < 0.02) for i in range(300)]
    want = set()
    for key in ("a", "b", None):
        last = flag = None
        for _, t, tie, eligible, rugged in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            if last is None or rugged or eligible != flag or t - last >= 7:
                want.add(tie)
                last, flag = t, eligible
    df = spark.createDataFrame(rows, "token string, t long, tie long, eligible boolean, rugged boolean").repartition(3)
    assert {r.tie for r in M.persist_on_change(df, "token", 7).collect()} == want
    assert M.persist_on_change(df.where("false"), "token", 7).count() == 0


def test_amounts_that_do_not_fit_are_null(spark):
    rows = [("m", "9" * 40, 2, None), ("m", "12", 2, None), ("m", None, None, "1" + "0" * 30), ("m", None, None, "1.25"), ("m", "x", 2, None)]
    df = spark.createDataFrame(rows, "market string, base_raw string, base_decimals int, base_amount string")
    got = [None if r.base_units is None else int(r.base_units) for r in ingest.normalize_quantity(df, ["market"]).orderBy(F.monotonically_increasing_id()).collect()]
    assert sorted(x for x in got if x is not None) == [12 * 10**10, 125 * 10**10] and got.count(None) == 3


def test_fill_nulls_from_one_row(spark):
    old = spark.createDataFrame([("k", None, None)], "k string, price double, quality string")
    new = spark.createDataFrame([("k", 1.0, None), ("k", 5.0, "b"), ("k", 3.0, "c")], "k string, price double, quality string")
    r = ingest.merge_fill_nulls(old, new, ["k"], ["price", "quality"]).first()
    assert (r.price, r.quality, r.changed) == (3.0, "c", True)


def test_a_watched_wallet_is_no_watch_of_the_system(spark):
    runs = spark.createDataFrame([(1, 9, 1, False)], "run int, n_runs int, quality_tokens int, replay_passed boolean")
    methods = spark.createDataFrame([], "run int, place int, method string, tokens int, median_pct double, avg_pct double, ex_best_pct double, best_share double, hit_rate double, drawdown_pct double, worst_pct double")
    decided = lambda kind: spark.createDataFrame([(1, kind, None, None, None, "key", None)], "run int, kind string, raw_candidate string, raw_watch string, validated string, watch string, leading string")
    got = {k: wallets.decision_status(runs, methods, decided(k)).first() for k in ("wallet", "rule")}
    assert (got["wallet"].mode, got["wallet"].system_watch, got["wallet"].verdict) == ("observe-only", False, "stand-down")
    assert (got["rule"].mode, got["rule"].system_watch, got["rule"].verdict) == ("paper-watch", True, "keep-watching")
