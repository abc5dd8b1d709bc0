"""FIFO by window algebra against hand numbers and a plain loop."""

import random

from tidemark.operators import ledger as L

SCHEMA = "key string, chain string, strategy string, signature string, slot long, t long, wallet string, token string, side string, qty double, value_usd double, pool_age_minutes double, data_quality string"


def rows(spark, trades, age=0.0):
    full = [(f"k{i:03d}", "c", "s", f"g{i:03d}", i, i * 60, w, "tok", side, float(q), float(v), age, "observed-execution") for i, (w, side, q, v) in enumerate(trades)]
    return spark.createDataFrame(full, SCHEMA)


def test_hand_numbers(spark):
    one = L.realizations(L.fifo_match(rows(spark, [("a", "buy", 100, 100), ("a", "sell", 100, 150)]))).first()
    assert round(one.invested, 6) == 101.5 and round(one.proceeds, 6) == 147.75 and round(one.return_pct, 2) == 45.57
    t = rows(spark, [("a", "buy", 100, 100), ("a", "sell", 40, 80), ("a", "sell", 30, 45)])
    r = sorted((round(x.invested, 4), round(x.proceeds, 4)) for x in L.realizations(L.fifo_match(t)).collect())
    assert r == [(30.45, 44.325), (40.6, 78.8)]
    assert round(L.open_inventory(L.lots(t)).first().cost, 4) == 30.45
    e = L.episodes(t).first()
    assert e.status == "open" and round(e.pnl, 4) == 52.075


def loop(trades):
    lots, out = {}, []
    for i, (w, side, q, v) in enumerate(trades):
        own = lots.setdefault(w, [])
        if side == "buy":
            own.append([f"k{i:03d}", q, q, v])
            continue
        left = q
        while left > 0 and own:
            take = min(left, own[0][1])
            out.append((own[0][0], f"k{i:03d}", float(take), round(own[0][3] * 1.015 * take / own[0][2], 6)))
            own[0][1] -= take
            left -= take
            if own[0][1] == 0:
                own.pop(0)
    return sorted(out)


def test_equals_a_loop_in_any_order(spark):
    rng = random.Random(2)
    trades = [(rng.choice("abc"), rng.choice(["buy", "buy", "sell"]), rng.randint(1, 20), rng.randint(1, 500)) for _ in range(400)]
    df = rows(spark, trades)
    got = sorted((r.lot_key, r.sell_key, r.units, round(r.invested, 6)) for r in L.fifo_match(df.orderBy("value_usd")).collect())
    assert got == loop(trades)


def test_later_trades_change_nothing_before(spark):
    trades = [("a", "buy", 10, 10), ("a", "sell", 4, 8), ("a", "buy", 5, 9), ("a", "sell", 20, 50)]
    first = {(r.lot_key, r.sell_key, r.units) for r in L.fifo_match(rows(spark, trades)).collect()}
    more = {(r.lot_key, r.sell_key, r.units) for r in L.fifo_match(rows(spark, [*trades, ("a", "buy", 7, 7), ("a", "sell", 7, 9)])).collect()}
    assert first < more


def test_old_pools_and_sells_without_lots(spark):
    assert L.fifo_match(rows(spark, [("a", "buy", 1, 1), ("a", "sell", 1, 1)], age=31.0)).count() == 0
    assert L.fifo_match(rows(spark, [("a", "sell", 1, 1), ("a", "buy", 1, 1)])).count() == 0
    assert L.episodes(rows(spark, [])).count() == 0


def test_one_pass_over_the_trades(spark):
    t = rows(spark, [("w", "buy", 100, 100), ("w", "sell", 40, 60), ("w", "buy", 10, 20), ("w", "sell", 70, 90), ("w", "buy", 5, 5)])
    for made in (L.episodes(t), L.lots(t)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    assert [(e.episode, e.lots, e.sells, e.status, e.open_units) for e in L.episodes(t).orderBy("episode").collect()] == [(1, 2, 2, "realized", 0.0), (2, 1, 0, "open", 5.0)]
    assert [(x.lot_key, x.remaining, x.status, x.sell_keys) for x in L.lots(t).orderBy("lot_key").collect()] == [("k000", 0.0, "realized", ["k001", "k003"]), ("k002", 0.0, "realized", ["k003"]), ("k004", 5.0, "open", None)]
