"""Streams over parts of a table give what a batch gives over the whole."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest as I
from tidemark.operators import ledger as L
from tidemark.operators import market as M
from tidemark.operators import outcomes as O
from tidemark.sources import adapters as A
from tidemark.streaming import streams as S


@pytest.fixture
def stream(spark, tmp_path):
    """A stream over a frame, cut in two files by a condition, earlier rows first."""

    def make(df, first, name="in"):
        path = f"{tmp_path}/{name}"
        df.where(first).coalesce(1).write.parquet(f"{path}/a")
        df.where(~first).coalesce(1).write.parquet(f"{path}/b")
        return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)

    return make


def drain(df, tmp_path, mode="append"):
    name = "t" + tmp_path.name.replace("-", "_")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def drain_rows(df, tmp_path, n):
    """For streams with timers by processing time, which never say that they are done: until n rows and all input have come."""
    name = "t" + tmp_path.name.replace("-", "_")
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for _ in range(240):
            if df.sparkSession.table(name).count() >= n and q.lastProgress and q.lastProgress["numInputRows"] == 0:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_dedupe(spark, sf_dir, stream, tmp_path):
    p = A.price_observations(spark, sf_dir).select(F.concat_ws(":", "wallet", "token").alias("key"), F.timestamp_seconds("t").alias("ts")).limit(300)
    out = drain(S.dedupe(stream(p.unionByName(p), F.col("ts") < "2024-01-10"), "key", "60 days"), tmp_path)
    assert out.count() == p.select("key").distinct().count()


def test_ohlc_equals_batch(spark, sf_dir, stream, tmp_path):
    p = A.price_observations(spark, sf_dir).select("token", F.timestamp_seconds("t").alias("ts"), "t", F.col("obs_key").alias("leg_key"), F.col("price_usd").alias("price"), F.col("price_usd").alias("volume"))
    out = drain(S.ohlc(stream(p, F.col("ts") < "2024-01-12"), "1 day", "0 seconds"), tmp_path)
    batch = p.groupBy("token", F.floor(F.col("t") / 86400).alias("d")).agg(F.max("price").alias("high"), F.min_by("price", F.struct("ts", "leg_key")).alias("open"))
    want = {(r.token, r.d): (r.high, r.open) for r in batch.collect()}
    got = {(r.token, r.d): (r.high, r.open) for r in out.select("token", F.floor(F.unix_timestamp("bucket") / 86400).alias("d"), "high", "open").collect()}
    last = p.agg(F.max("t")).first()[0] // 86400
    assert got == {k: v for k, v in want.items() if k[1] < last} and len(got) > 50


def test_missing_streak_equals_batch(spark, sf_dir, stream, tmp_path):
    p = A.price_observations(spark, sf_dir).select("token", "t", F.timestamp_seconds("t").alias("ts"), F.col("obs_key").alias("tie"), F.col("event_type").isin("error", "click").alias("missing"), F.col("price_usd").alias("price"))
    out = drain(S.missing_streak(stream(p, F.col("ts") < "2024-01-15")), tmp_path)
    want = {r.tie: r.streak for r in M.missing_streaks(p, "token", 3).collect()}
    assert {r.tie: r.streak for r in out.collect()} == want


LEDGER = "chain string, strategy string, wallet string, token string, slot long, t long, signature string, key string, side string, qty double, value_usd double, pool_age_minutes double, data_quality string"


def files(spark, tmp_path, parts, schema):
    """A stream over lists of rows, one file for each, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
    df = spark.createDataFrame([], schema).withColumn("ts", F.timestamp_seconds("t"))
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_ledger_equals_batch_whatever_the_arrival(spark, sf_dir, tmp_path):
    """Rows out of order within the delay, several markets, a market with an old pool; a late row comes out once."""
    cols = [c.split()[0] for c in LEDGER.split(", ")]
    rows = [tuple(r) for r in A.trades(spark, sf_dir).where("wallet IN ('w1', 'w2') AND token IN ('Brand#1', 'Brand#2', 'Brand#13')").orderBy("slot", "signature").select(*cols).collect()]
    day = 86_400
    rows += [("c", "s", "w9", "tok", s, s * day, f"g{s}", f"k{s}", side, 5.0, 9.0, age, "price-proxy") for s, side, age in ((9_500, "buy", 45.0), (9_600, "buy", 1.0), (9_700, "sell", 1.0))]
    rng = random.Random(1)
    ordered = sorted(rows, key=lambda r: r[4] + rng.randint(0, 40))
    cut = [ordered[i : i + 1 + len(ordered) // 5] for i in range(0, len(ordered), 1 + len(ordered) // 5)]
    end = [("c", "s", "beat", "beat", 20_000 + i, (20_000 + i) * day, "g", f"b{i}", "sell", 1.0, 1.0, 0.0, "price-proxy") for i in range(2)]
    first = min((r for r in rows if r[8] == "buy" and r[2] == "w1"), key=lambda r: r[4])
    late = (*first[:6], "late", "late", *first[8:])
    batch = L.realizations(L.fifo_match(spark.createDataFrame(rows, LEDGER)))
    out = drain_rows(S.ledger(files(spark, tmp_path, [*cut, [end[0]], [late], [end[1]]], LEDGER), "60 days"), tmp_path, batch.count() + 1)
    realized, behind = S.side_tables(out)
    show = lambda df: sorted((r.wallet, r.token, r.sell_key, r.episode, r.units, round(r.invested, 6), round(r.proceeds, 6)) for r in df.collect())
    assert show(realized) == show(batch) and len(show(batch)) > 10
    assert [r.key for r in behind.collect()] == ["late"]


PRICE = "kind int, token string, pool string, t long, name long, price double, rugged boolean, executable boolean"


@pytest.mark.parametrize("exit_strategy", ["fixed-horizon", "tp15-sl20"])
def test_outcomes_equal_batch(spark, tmp_path, exit_strategy):
    """Every entry's last state is the batch outcome at the last watermark; no state comes twice."""
    rng = random.Random(7)
    rows = [(0, rng.choice("ab"), rng.choice(["p", "q", None]), rng.randrange(20_000), i, 100.0, False, True) for i in range(60)]
    rows += [(1, rng.choice("ab"), rng.choice("pq"), rng.randrange(20_000), 1000 + i, float(rng.choice([70, 95, 100, 104, 130])), rng.random() < 0.02, rng.random() < 0.9) for i in range(150)]
    ordered = sorted(rows, key=lambda r: r[3] + rng.randint(0, 900))
    cut = [ordered[i : i + 60] for i in range(0, len(ordered), 60)]
    stream = files(spark, tmp_path, [*cut, [(1, "z", "z", 30_000, 1, 1.0, False, True)], [(1, "z", "z", 30_001, 2, 1.0, False, True)]], PRICE)
    entries = stream.where("kind = 0").select(F.col("name").alias("entry_key"), "token", "pool", "ts", F.col("price").alias("entry_price"))
    prices = stream.where("kind = 1").select("token", "pool", "ts", F.col("name").alias("obs_key"), F.col("price").alias("price_usd"), "rugged", "executable")
    got = [r.asDict() for r in drain(S.outcomes(entries, prices, 1200, 1200, "1000 seconds", exit_strategy, spread=2), tmp_path).collect()]
    states = {}
    for r in got:
        states.setdefault(r["entry_key"], []).append(r["status"])
    assert all(s in (["provisional"], ["provisional", "unresolved"], ["provisional", "mature"], ["provisional", "unresolved", "mature"]) for s in states.values())
    df = spark.createDataFrame(rows, PRICE)
    e = df.where("kind = 0").select(F.col("name").alias("entry_key"), "token", "pool", "t", F.col("price").alias("entry_price"))
    o = df.where("kind = 1").select("token", "pool", "t", F.col("name").alias("obs_key"), F.col("price").alias("price_usd"), "rugged", "executable")
    batch = {str(r.entry_key): r for r in O.outcomes(e, o, 29_000, 1200, 1200, exit_strategy).collect()}
    assert {k: s[-1] for k, s in states.items()} == {k: r.status for k, r in batch.items()}
    for r in got:
        if r["status"] == "mature":
            b = batch[r["entry_key"]]
            assert (r["outcome_price"], r["frozen_t"], r["rugged"]) == (b.outcome_price, b.frozen_t, b.rugged) and abs(r["net_pct"] - b.net_pct) < 1e-9
    assert {"mature", "unresolved"} <= {s[-1] for s in states.values()}


def test_flow_before_equals_batch(spark, tmp_path):
    schema = "kind int, token string, t long, name long, side string, trader string, volume double"
    rng = random.Random(5)
    rows = [(0, rng.choice("abc"), rng.randrange(5_000), i, None, None, None) for i in range(40)]
    rows += [(1, rng.choice("ab"), rng.randrange(5_000), 100 + i, rng.choice(["buy", "sell"]), f"w{rng.randrange(5)}", float(rng.randrange(9))) for i in range(120)]
    ordered = sorted(rows, key=lambda r: r[2] + rng.randint(0, 200))
    end = [[(k, "z", 20_000 + i, 900 + 2 * i + k, "buy", "w", 1.0) for k in (0, 1)] for i in range(2)]
    stream = files(spark, tmp_path, [ordered[:60], ordered[60:], *end], schema)
    entries = stream.where("kind = 0").select(F.col("name").alias("entry_key"), "token", "ts")
    trades = stream.where("kind = 1").select("token", "ts", "side", "trader", "volume")
    out = drain(S.flow_before(entries, trades, "300 seconds", "300 seconds"), tmp_path).where("entry_key < 100")
    want = {}
    for _, token, t, name, *_ in rows[:40]:
        near = [r for r in rows[40:] if r[1] == token and t - 300 <= r[2] <= t]
        traders = lambda side: len({r[5] for r in near if r[4] == side})  # noqa: E731, B023
        want[name] = (len(near), sum(r[4] == "buy" for r in near), traders("buy"), traders("sell"), sum(r[6] for r in near))
    assert {r.entry_key: (r.swaps, r.buys, r.buyers, r.sellers, r.volume) for r in out.collect()} == want


def test_finality_equals_batch_and_fails_closed(spark, tmp_path):
    schema = "kind int, name string, signature string, t long, finality string"
    rng = random.Random(6)
    events = [(0, f"k{i}", f"g{i}", 1_000 + 10 * i, None) for i in range(60)]
    said = {i: rng.choice(["finalized", "failed", "unresolved"]) for i in range(60) if i % 4}
    known = [(1, None, f"g{i}", 1_000 + 10 * i + (5_000 if i % 10 == 1 else rng.randrange(200)), f) for i, f in said.items()]
    ordered = sorted(events + known, key=lambda r: r[3])
    end = [[(k, "end", f"end{i}", 20_000 + i, "finalized") for k in (0, 1)] for i in range(2)]
    stream = files(spark, tmp_path, [ordered[:50], ordered[50:], *end], schema)
    held = stream.where("kind = 0").select(F.col("name").alias("key"), "signature", "ts", F.lit("confirmed").alias("commitment"), F.lit("pending").alias("status"))
    out = drain(S.finality(held, stream.where("kind = 1").select("signature", "ts", "finality"), "1000 seconds", "0 seconds"), tmp_path).where("key <> 'end'")
    got = {r.key: (r.finality, r.commitment, r.status) for r in out.collect()}
    batch_events = spark.createDataFrame([(n, g, "pending", "confirmed", True) for _, n, g, _, _ in events], "key string, signature string, status string, commitment string, finality_required boolean")
    # what came too late counts as unresolved
    final = spark.createDataFrame([(f"g{i}", "unresolved" if i not in said or i % 10 == 1 else said[i]) for i in range(60)], "signature string, finality string")
    want = {r.key: (r.commitment, r.status) for r in I.finality_reconcile(batch_events, final).collect()}
    assert {k: v[1:] for k, v in got.items()} == want and got["k0"] == ("unresolved", "confirmed", "rolled_back")
