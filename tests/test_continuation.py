"""Continued ledgers equal the full one, and rows that must not be continued are found."""

import random

from tidemark.operators import continuation as K
from tidemark.operators import ledger as L

SCHEMA = "key string, chain string, strategy string, signature string, slot long, t long, wallet string, token string, side string, qty double, value_usd double, pool_age_minutes double, data_quality string, decimals int"


def trade(i, side, qty, value, token="Token", quality="oracle-converted", wallet="Wallet", age=5.0, decimals=6):
    return (f"trade-{i}", "c", "s", f"sig-{i}", 100 + i, 60 * i, wallet, token, side, float(qty), None if value is None else float(value), age, quality, decimals)


#: Unmatched sell first, partial sells, a round trip that closes and one that opens again.
CASE = [
    trade(1, "sell", 1, 10), trade(2, "buy", 100, 100), trade(3, "buy", 50, 80, "Other"), trade(4, "sell", 40, 75), trade(5, "buy", 50, 45), trade(6, "sell", 60, 110, quality="price-proxy"),
    trade(7, "sell", 50, 110, "Other"), trade(8, "sell", 50, 65), trade(9, "buy", 20, 20), trade(10, "sell", 5, 8), trade(11, "buy", 8, 5, "Third"), trade(12, "sell", 3, 4, "Third"),
]


def frame(spark, trades):
    return spark.createDataFrame(trades, SCHEMA).coalesce(1)


def saved(spark, tmp_path, carried, name):
    """The state as it is stored between two advances."""
    out = []
    for part in ("wallets", "markets", "lots"):
        at = str(tmp_path / f"{name}-{part}")
        getattr(carried, part).coalesce(1).write.parquet(at)
        out.append(spark.read.parquet(at))
    return K.Carried(*out)


def sells(rows):
    return sorted((r.wallet, r.token, r.sell_key, r.episode, r.opened_t, r.closed_t, r.units, round(r.invested, 8), round(r.proceeds, 8), r.high_quality) for r in rows.collect())


def lots(rows):
    return sorted((r.wallet, r.token, r.key, r.episode, r.remaining, round(r.remaining_value, 8)) for r in rows.collect())


def markets(rows):
    return sorted((r.wallet, r.token, r.has_buy, r.first_age, r.episode, r.decimals) for r in rows.collect())


def full(spark, trades):
    return sells(L.realizations(L.fifo_match(frame(spark, trades))))


def test_every_cut_equals_the_full_ledger(spark):
    """One wallet for each cut."""
    history = [(*t[:6], f"w{cut:02d}", *t[7:]) for cut in range(1, len(CASE)) for t in CASE[:cut]]
    delta = [(*t[:6], f"w{cut:02d}", *t[7:]) for cut in range(1, len(CASE)) for t in CASE[cut:]]
    history, delta = ([(f"{t[6]}-{t[0]}", *t[1:]) for t in rows] for rows in (history, delta))
    out = K.advance(K.carry(frame(spark, history)), frame(spark, delta), frame(spark, history))
    assert {r.mode for r in out.modes.collect()} == {"continued"}
    assert sorted(full(spark, history) + sells(out.realized)) == full(spark, history + delta)
    whole = K.carry(frame(spark, history + delta))
    assert lots(out.carried.lots) == lots(whole.lots) and markets(out.carried.markets) == markets(whole.markets)
    last = lambda rows: sorted((r.wallet, r.last) for r in rows.collect())
    assert last(out.carried.wallets) == last(whole.wallets)


def test_restarts_from_the_stored_state(spark, tmp_path):
    state, got = saved(spark, tmp_path, K.carry(frame(spark, CASE[:3])), "0"), []
    for i in (3, 4, 6, 9):
        out = K.advance(state, frame(spark, CASE[i : {3: 4, 4: 6, 6: 9, 9: 12}[i]]), frame(spark, CASE[:i]))
        got += sells(out.realized)
        state = saved(spark, tmp_path, out.carried, i)
    assert sorted(got) == full(spark, CASE) and lots(state.lots) == lots(K.carry(frame(spark, CASE)).lots)


def test_random_wallets_with_late_rows(spark):
    rng = random.Random(4)
    trades = [trade(i, rng.choice(["buy", "buy", "sell"]), rng.randint(1, 20), rng.choice([None, *range(1, 90)]), rng.choice("xyz"), wallet=rng.choice("abcdef"), age=rng.choice([1.0, 1.0, 1.0, 40.0])) for i in range(500)]
    delta = trades[300:] + [t for t in trades[:300] if t[6] == "b"][-3:]
    history = [t for t in trades[:300] if t not in delta]
    out = K.advance(K.carry(frame(spark, history)), frame(spark, delta), frame(spark, history))
    modes = {r.wallet: r.mode for r in out.modes.collect()}
    assert modes["a"] == "continued" and lots(out.carried.lots) == lots(K.carry(frame(spark, trades)).lots)
    before = [r for r in full(spark, history) if modes[r[0]] == "continued"]
    assert sorted(before + sells(out.realized)) == full(spark, trades)


def test_classes_of_rows(spark):
    history, late = CASE[:5], trade(2, "buy", 7, 7)
    corrected = (*CASE[3][:10], 999.0, *CASE[3][11:])
    delta = [("late", *late[1:]), CASE[4], corrected, trade(6, "sell", 1, 1, decimals=7), CASE[6]]
    got = {r.key: r.kind for r in K.classify(K.carry(frame(spark, history)), frame(spark, delta), frame(spark, history)).collect()}
    assert got == {"late": "late", "trade-5": "repeated", "trade-4": "corrected", "trade-6": "precision", "trade-7": "new"}


def test_corrections_and_another_cost_model_rebuild(spark):
    history = CASE[:8]
    corrected = (*CASE[3][:10], 999.0, *CASE[3][11:])
    out = K.advance(K.carry(frame(spark, history)), frame(spark, [corrected]), frame(spark, history))
    assert [r.mode for r in out.modes.collect()] == ["rebuilt"] and sells(out.realized) == full(spark, [*history[:3], corrected, *history[4:]])
    cheap = K.carry(frame(spark, history), 1.0)
    out = K.advance(cheap, frame(spark, []), frame(spark, history))
    assert [r.mode for r in out.modes.collect()] == ["rebuilt"] and sells(out.realized) == full(spark, history)
    assert out.carried.wallets.first().cost_pct == 3.0


def test_first_buy_gates_what_follows(spark):
    for first in (trade(1, "buy", 1, 1, age=90.0), trade(1, "buy", 1, None, age=90.0)):
        out = K.advance(K.carry(frame(spark, [first])), frame(spark, [trade(2, "buy", 1, 1), trade(3, "sell", 2, 10)]), frame(spark, [first]))
        assert sells(out.realized) == [] and lots(out.carried.lots) == []


def test_nothing_new_and_new_wallets(spark):
    state = K.carry(frame(spark, CASE))
    out = K.advance(state, frame(spark, []), frame(spark, CASE))
    assert out.realized.count() == 0 and out.modes.count() == 0 and lots(out.carried.lots) == lots(state.lots)
    other = [trade(i, s, q, 9, wallet="New") for i, s, q in ((20, "buy", 4), (21, "sell", 3))]
    out = K.advance(state, frame(spark, other * 2), frame(spark, CASE))
    assert [r.mode for r in out.modes.collect()] == ["started"] and sells(out.realized) == full(spark, other)
    assert out.carried.wallets.count() == 2


def test_an_advance_reads_the_trades_once(spark, sf_dir):
    """History, delta and carried state are tables that the branches share; none goes back to the lines."""
    from tidemark.plans import ledger as P

    out = P._advanced(spark, sf_dir)
    for rows in (out.carried.lots, out.realized, out.modes):
        assert not [f for f in rows.inputFiles() if "lineitem" in f]


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_whole_trades_are_dealt_once_by_market(spark, sf_dir, monkeypatch):
    """No exchange of whole trades by key, wallet or order; one by market for each state."""
    from tidemark.plans import ledger as P

    written = []
    monkeypatch.setattr(K, "stored", lambda df, true=K.stored: written.append((df.columns, exchanges(df))) or true(df))
    out = P._advanced(spark, sf_dir)
    states = [x for columns, x in written if "remaining" in columns]
    assert len(states) == 1 and len(out.carried.lots.columns) > 0
    states = [x for columns, x in written if "remaining" in columns]
    for dealt in states:
        assert len(dealt) == 1 and "hashpartitioning(chain" in dealt[0] and "token" in dealt[0]
    # what else is dealt whole, for keys or for wallets in doubt, are trades that met another's hash or a few wallets'
    assert len(states) == 2 and all("key" not in x for columns, dealt in written if columns == ["_hash"] for x in dealt)


def test_trades_of_repeated_keys(spark):
    rng = random.Random(8)
    trades = [trade(i, "buy", rng.randint(1, 9), i, wallet=rng.choice("abc")) for i in range(200)]
    # a key of two wallets, a key met three times, and trades without a key
    trades += [(f"trade-{i}", *trade(i + rng.randint(1, 50), "sell", 1, 1, wallet=rng.choice("abc"))[1:]) for i in (3, 90, 90, 150)] + [(None, *trade(i, "buy", 1, 1)[1:]) for i in (500, 501)]
    df = frame(spark, trades)
    got, plain = (sorted(map(repr, x.select(*K.TRADE).collect())) for x in (K._trades(df), K.dedupe_trades(df)))
    assert got == plain and len(got) == 201


def test_wallets_in_doubt_are_classed_trade_by_trade(spark):
    """Modes equal those of every trade's class, with new trades of the last slot, finer ones, and ones without a slot."""
    rng = random.Random(12)
    # slots are shared, so only the rest of the order tells what is late
    made = [trade(i, rng.choice(["buy", "sell"]), 2, 5, rng.choice("xyz"), wallet=rng.choice("abcdefghijklmnop"), decimals=rng.choice([4, 5])) for i in range(300)]
    made = [(*t[:4], None if i in (40, 290) else t[4] // 40, *t[5:]) for i, t in enumerate(made)]
    history, delta = made[:200], [*made[200:], *made[7:8]]
    carried = K.carry(frame(spark, history))
    classes = K.classify(carried, frame(spark, delta), frame(spark, history)).collect()
    odd = {}
    for r in classes:
        odd[r.wallet] = odd.get(r.wallet, False) or r.kind != "new"
    known = {r.wallet for r in carried.wallets.collect()}
    modes = {r.wallet: r.mode for r in K.advance(carried, frame(spark, delta), frame(spark, history)).modes.collect()}
    assert modes == {w: "rebuilt" if o else "continued" if w in known else "started" for w, o in odd.items()}
    assert {"rebuilt", "continued"} <= set(modes.values()) and {"late", "precision", "repeated", "new"} <= {r.kind for r in classes}


def test_sells_of_an_advance_are_dealt_once(spark, sf_dir, monkeypatch):
    """Sells of continued and of rebuilt wallets come from one pass, and no state is written for them."""
    from tidemark.plans import ledger as P

    written = []
    monkeypatch.setattr(K, "stored", lambda df, true=K.stored: written.append(df.columns) or true(df))
    out = P._advanced(spark, sf_dir)
    dealt = exchanges(out.realized)
    assert len(dealt) == 1 and "hashpartitioning(chain" in dealt[0] and "token" in dealt[0]
    assert {r.mode for r in out.modes.collect()} >= {"continued", "rebuilt"}
    assert len([columns for columns in written if "remaining" in columns]) == 1
