"""Rows near in time by one pass in order: the same as by brute force, and no operator gives out pairs of rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.common import near_row


def most_rows(df):
    """Most rows that one operator of the plan gave out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            most = max(most, rows.get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Events of one market within a few days: each entry has most rows in its window."""
    d = str(tmp_path_factory.mktemp("crowded"))
    n = F.col("id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("purchase", "view", "signup", "error", "click")]), (n % 5 + 1).cast("int"))
    rows = spark.range(3000).select(
        n.alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + n * 37 % 260_000).cast("timestamp_ntz").alias("ts"), (n % 1500).alias("user_id"), kind.alias("event_type"), ((n * 7919 % 200_00) / 100.0).alias("value"), F.lit('{"k": 7}').alias("props")
    )
    rows.write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("back", [False, True])
def test_near_row_is_brute_force(spark, back):
    rng = random.Random(3)
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i, rng.random()) for i in range(80)]
    left = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-5, 70)])) for i in range(60)]
    out = near_row(spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, at long, tie int, v double"), ["k"], F.col("t"), "at", ["tie"], 7, "near", back)
    got = {r.id: (r.near.tie if r.near else None) for r in out.collect()}
    want = {}
    for i, k, t in left:
        met = [(a, tie) for key, a, tie, _ in right if None not in (k, t, a) and key == k and (a <= t if back else a >= t)]
        want[i] = (max(met) if back else min(met))[1] if met else None
    assert got == want


def test_watched_wallets_meet_no_pairs(spark, crowded):
    from tidemark.plans.wallets import QUERIES

    assert most_rows(QUERIES["f27_watch_wallet_score"][0](spark, crowded)) <= 4 * 3000


OUTCOMES = ["d5_outcome_fixed", "d5_outcome_threshold", "d6_assess_fixed_horizon", "f7_followability_returns", "g24_evidence_funnel"]


@pytest.mark.parametrize("name", [*OUTCOMES, "d4_materialize_entries", "c8_pre_entry_flow", "h12_flow_since_decision", "c14_nearest_quote_price", "c15_price_execution", "c16_enrich_trade_prices", "c23_unresolved_horizon_windows"])
def test_entries_meet_no_pairs(spark, crowded, name):
    from tidemark.plans import registry

    assert most_rows(registry.ALL[name][0](spark, crowded)) <= 5 * 3000


def test_first_crossing_is_brute_force(spark):
    """Also far away, over several levels of blocks, and from a price of 0."""
    from tidemark.operators.outcomes import first_crossing

    rng = random.Random(5)
    rows = [("a", i // 3, i, 100.0 + rng.random(), False) for i in range(900)] + [("a", 400, 900, 300.0, False), ("b", 5, 1, None, False), ("b", 9, 2, 40.0, False)]
    entries = [(i, "a", rng.randrange(-5, 420), rng.choice([100.0, 95.0, 86.5, 130.0, 0.0, 250.0])) for i in range(200)] + [(200, "b", 1, 100.0), (201, "b", 5, 0.0), (202, None, 1, 5.0)]
    out = first_crossing(spark.createDataFrame(entries, "entry_key long, k string, entry_t long, entry_price double"), spark.createDataFrame(rows, "k string, obs_t long, obs_key long, price_usd double, rugged boolean"), ["k"], 15.0, -20.0)
    want = {}
    for key, k, t, e in entries:
        met = [(o, x) for m, o, x, p, _ in rows if m == k and o >= t and p is not None and (e == 0 or (p / e - 1) * 100 >= 15 or (p / e - 1) * 100 <= -20)]
        if met:
            want[key] = min(met)[1]
    assert {r.entry_key: r.threshold.obs_key for r in out.collect()} == want


def test_window_flow_is_brute_force(spark):
    from tidemark.operators.market import window_flow

    rng = random.Random(7)
    trades = [(rng.choice("ab"), rng.randrange(100), rng.choice(["buy", "sell", None]), rng.choice(["u", "v", "w", None]), float(rng.randrange(9)), rng.choice([None, *map(float, range(5))])) for _ in range(150)]
    ends = [(i, rng.choice("abc"), rng.randrange(-5, 130)) for i in range(120)]
    out = window_flow(spark.createDataFrame(ends, "id int, token string, end long"), spark.createDataFrame(trades, "token string, trade_t long, side string, trader string, volume double, price double"), 10)
    for r in out.collect():
        _, token, end = ends[r.id]
        met = [x for x in trades if x[0] == token and end - 10 <= x[1] <= end]
        of = lambda side: [x for x in met if x[2] == side]
        prices = [x[5] for x in met if x[5] is not None]
        assert (r.buys, r.sells, r.volume) == (len(of("buy")), len(of("sell")), sum(x[4] for x in met))
        assert (r.buyers, r.sellers) == tuple(len({x[3] for x in of(s)} - {None}) for s in ("buy", "sell"))
        assert (r.low, r.high) == ((min(prices), max(prices)) if prices else (None, None))
    assert out.count() == len(ends)


def test_free_entries_and_quotes_are_no_error(spark, tmp_path, crowded):
    """Prices of 0: an entry at 0 leaves at its first row, a quote of 0 is not sure."""
    from tidemark.plans import registry

    rows = spark.read.parquet(f"{crowded}/events.parquet").withColumn("value", F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(F.col("value")))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    free = registry.ALL["d5_outcome_threshold"][0](spark, str(tmp_path)).where("outcome_price = 0").collect()
    assert free and all(r.status == "mature" and r.gross_pct is None for r in free if r.gross_pct is None)
    assert {r.unpriced_reason for r in registry.ALL["c15_price_execution"][0](spark, str(tmp_path)).collect()} >= {None, "oracle-unsure"}
