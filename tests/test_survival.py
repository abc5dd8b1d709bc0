"""Contextual survival against a plain loop in time order; nothing later than a decision counts."""

import math
import random

from tidemark.operators import survival as S

SCHEMA = (
    "market string, dex string, t long, frozen_t long, net_return_pct double, cost_pct double, rugged boolean, liquidity_usd double, pool_age_minutes double, top10_percent double, volume_liquidity_ratio double, "
    "buy_share_5m double, transactions_5m long, supporters array<struct<wallet:string,prior_tokens:long>>, controlled_flow boolean, risk_known boolean, risk_passed boolean, mint_revoked boolean, freeze_revoked boolean"
)


def record(i, t, net, supporters, rugged=False, dex="d", liquidity=20_000.0, last=50, age=6.0, risk=True):
    return (f"m{i:04d}", dex, t, t + last, net, 8.0, rugged, liquidity, age, 10.0, 0.3, 0.5, 9, supporters, True, risk, True, True, True)


def records(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.9
        who = [(f" {w} " if rng.random() < 0.1 else w, rng.randint(-1, 9)) for w in rng.choices(["good", "fair", "bad", "new", ""] + (["lucky"] if good else ["unlucky"]), k=3)]
        out.append(record(i, rng.randrange(40 * n) // 20 * 20, float(rng.choice([60, 90, 40]) if good else rng.choice([-25, -90])), who, not good and rng.random() < 0.2, rng.choice("dde"), rng.choice([20_000.0, 40_000.0]), rng.randrange(1, 900)))
    return out


def loop(rows):
    """(market, history, risk, market score, wallet score, thresholds, selections) in order; rows as of record()."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if r[3] >= r[2]:
            first.setdefault(r[0], r)
    out, past, series, wallets = [], [], ([], []), S.WALLET_STRENGTH
    for r in sorted(first.values(), key=lambda r: (r[2], r[0])):
        who = {}
        for w, n in r[13]:
            if w.strip():
                who[w.strip()] = max(who.get(w.strip(), 0), n, 0)
        if not who or r[8] < 5 or not r[15]:
            continue
        context = (r[1], r[7] >= 15_000, r[7] >= 30_000)
        value = -100.0 if r[6] else r[4]
        done = [p for p in past if p[0] < r[2]]

        def sums(some):
            calm = [min(100, max(-100, v)) for _, _, _, v, h in some if not h]
            return len(some), sum(h for *_, h in some), len(calm), sum(calm), sum(x * x for x in calm), sum(min(100, max(-100, v)) for _, _, _, v, _ in some)

        def shrink(part, n, prior, k):
            return (part + prior * k) / max(1, n + k)

        g, c = sums(done), sums([p for p in done if p[1] == context])
        risk = shrink(c[1], c[0], shrink(g[1], g[0], 0.1, 10), 24)
        mean = shrink(c[3], c[2], shrink(g[3], g[2], 0, 10), 24)
        variance = 900
        if c[2] >= 2:
            own = c[3] / c[2]
            variance = (max(0, (c[4] - c[2] * own * own) / (c[2] - 1)) * c[2] + 900 * 24) / (c[2] + 24)
        m = c[0] + 24
        upper = min(1, (risk + 1.645**2 / (2 * m) + 1.645 * math.sqrt((risk * (1 - risk) + 1.645**2 / (4 * m)) / m)) / (1 + 1.645**2 / m))
        expected = (1 - risk) * mean - risk * 100
        score = expected - max(0, upper - risk) * 100 - 1.28 * math.sqrt(variance / max(1, c[2] + 24))
        moves = []
        for w in who:
            a, b = sums([p for p in done if w in p[2]]), sums([p for p in done if w in p[2] and p[1] == context])
            if a[0]:
                moves.append(((shrink(b[5], b[0], shrink(a[5], a[0], expected, wallets), wallets) - expected) * a[0] / (a[0] + wallets), a[0]))
        top = sorted(moves, key=lambda x: (-x[0], -x[1]))[:2]
        both = score, score + (sum(x for x, _ in top) / len(top) if top else 0)
        marks = [sorted(s[-S.LOOKBACK :])[math.ceil((len(s[-S.LOOKBACK :]) - 1) * 0.9)] if len(s) >= S.LEAST_HISTORY else None for s in series]
        ok = g[0] >= S.LEAST_HISTORY and upper <= S.TOP_RISK
        chosen = [ok and s > 0 and k is not None and s >= k - 1e-9 for s, k in zip(both, marks, strict=True)]
        out.append((r[0], g[0], round(risk, 6), *(round(x, 6) for x in both), *(None if k is None else round(k, 6) for k in marks), chosen[0], chosen[1] and bool(moves), len(moves), sum(n >= 6 for n in who.values())))
        for s, x in zip(series, both, strict=True):
            s.append(x)
        past.append((r[3], context, set(who), value, r[6] or value <= -80))
    return out


def decided(spark, rows):
    got = S.decide(S.decision_records(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    six = lambda x: None if x is None else round(x, 6)
    return sorted((r.market, r.history, six(r.risk), six(r.market_score), six(r.wallet_score), six(r.market_threshold), six(r.wallet_threshold), r.by_market, r.by_wallet, r.evidence, r.experienced) for r in got)


def test_equals_a_loop(spark, monkeypatch):
    for name, value in (("LEAST_HISTORY", 20), ("LOOKBACK", 50), ("BLOCK", 17), ("TOP_RISK", 0.5)):
        monkeypatch.setattr(S, name, value)
    monkeypatch.setattr(S.rolling_quantile, "__defaults__", (50, 20, 0.9))
    rows = records(3, 220)
    rows += [record(5, 10**9, 99.0, [("good", 1)]), record(900, 500, 9.0, [("good", 1)], age=4.0), record(901, 500, 9.0, [(" ", 1)]), record(902, 500, 9.0, [("good", 1)], risk=False), record(903, 500, 9.0, [("good", 1)], last=-1)]
    got, want = decided(spark, rows), sorted(loop(rows))
    assert got == want and any(r[7] for r in got) and any(r[8] for r in got)


def test_later_outcomes_and_order_change_nothing(spark):
    rows = [record(i, 60 * i, 12.0, [("causal", i)], last=120) for i in range(115)]
    good, bad = record(115, 60 * 115, 100.0, [("causal", 1)]), record(115, 60 * 115, 100.0, [("causal", 1)], rugged=True)
    a, b = decided(spark, [*rows, good]), decided(spark, [bad, *reversed(rows)])
    assert a == b and len(a) == 116


def test_shuffled_supporters_go_round(spark):
    rows = S.decision_records(spark.createDataFrame([record(i, i, 1.0, [(f"w{i}", 1)]) for i in range(10)], SCHEMA))
    got = {r.market: r.supporters[0].wallet for r in S.shuffled_supporters(rows).collect()}
    assert got == {f"m{i:04d}": f"w{(i + 3) % 10}" for i in range(10)}


def test_no_records(spark):
    out = S.contextual_survival(spark.createDataFrame([], SCHEMA))
    assert out.decisions.count() == 0
    rows = out.policies.collect()
    assert len(rows) == 20 and {r.verdict for r in rows} == {"reject"} and all(r.reasons.startswith("count") for r in rows)


def test_nested_scopes_by_one_exchange(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(300), rng.choice("aab"), rng.choice("xyz"), rng.randrange(-9, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t long, wallet string, context string, v long")
    done = df.select("wallet", "context", (df.t + 7).alias("frozen_t"), "v")
    scopes = {"w": ["wallet"], "x": ["wallet", "context"]}
    want = sorted((i, sum(r[4] for r in rows if r[2] == w and r[1] + 7 < t), sum(r[4] for r in rows if r[2:4] == (w, c) and r[1] + 7 < t)) for i, t, w, c, _ in rows)
    for hot in (10**6, 150, 0):
        got = S.causal_sums(df.select("id", "t", "wallet", "context"), done, scopes, ["v"], buckets=9, hot_rows=hot)
        assert sorted((r.id, r.w_v, r.x_v) for r in got.collect()) == want
        if hot > 400:
            assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    whole = S.causal_sums(df.select("id", "t", "context"), done, {"g": [], "c": ["context"]}, ["v"], buckets=9)
    want = sorted((i, sum(r[4] for r in rows if r[1] + 7 < t), sum(r[4] for r in rows if r[3] == c and r[1] + 7 < t)) for i, t, _, c, _ in rows)
    assert sorted((r.id, r.g_v, r.c_v) for r in whole.collect()) == want


def test_quantiles_of_several_values(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 13)
    rng = random.Random(7)
    rows = [(i, float(rng.randrange(40)), float("nan") if i == 70 else float(i % 11)) for i in range(150)]
    out = S.rolling_quantile(spark.createDataFrame(rows, "place long, a double, b double"), [], ["a", "b"], None, None, ["qa", "qb"], 30, 10)
    for r in out.collect():
        for k, q in ((1, r.qa), (2, r.qb)):
            seen = sorted((x[k] for x in rows[max(0, r.place - 30) : r.place]), key=lambda x: (math.isnan(x), x))
            assert q == (seen[math.ceil((len(seen) - 1) * 0.9)] if len(seen) >= 10 else None)
