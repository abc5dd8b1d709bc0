"""Markets cut to blocks give the rows of the plain ledger and of a loop."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_ledger import SCHEMA, loop, rows

from tidemark.functions import common
from tidemark.operators import hot_markets as H
from tidemark.operators import ledger as L


def found(df):
    return sorted((r.wallet, r.lot_key, r.sell_key, r.units, round(r.invested, 6), round(r.proceeds, 6), r.episode, r.high_quality, r.lot_t, r.sell_t) for r in df.collect())


def test_equals_the_plain_ledger_and_a_loop(spark):
    rng = random.Random(5)
    trades = [(rng.choice("aaaaaaaab"), rng.choice(["buy", "sell"]), rng.randint(1, 9), rng.randint(1, 500)) for _ in range(600)]
    df = rows(spark, trades)
    got = H.fifo_match(df, hot_rows=100).collect()
    assert sorted((r.lot_key, r.sell_key, r.units, round(r.invested, 6)) for r in got) == loop(trades)
    assert found(H.fifo_match(df, hot_rows=100)) == found(L.fifo_match(df)) == found(H.fifo_match(df, hot_rows=10)) == found(H.fifo_match(df))


def test_ledger_rows_of_a_long_run_of_sells(spark):
    # whole blocks without a lot, then whole blocks without a sell, then one sell of all
    trades = [("a", "sell", 3, 3)] * 150 + [("a", "buy", 2, 4)] * 300 + [("a", "sell", 1000, 9), ("a", "buy", 1, 1), ("a", "sell", 1, 2)]
    df = rows(spark, trades)
    names = ["key", "before", "after", "sold", "bought_end", "sold_end", "episode"]
    plain, cut = (sorted(tuple(r) for r in d.select(*names).collect()) for d in (L.ledger_rows(df), H.block_ledger_rows(df)))
    assert cut == plain
    assert found(H.fifo_match(df, hot_rows=100)) == found(L.fifo_match(df)) and len(found(L.fifo_match(df))) == 301


def test_edges(spark):
    assert H.fifo_match(rows(spark, []), hot_rows=0).count() == 0
    old = rows(spark, [("a", "buy", 1, 1), ("a", "sell", 1, 1)] * 20, age=31.0)
    assert H.fifo_match(old, hot_rows=5).count() == 0
    # a null wallet is a market, rows without quantity or value take no part
    odd = [(f"k{i:03d}", "c", "s", f"g{i}", i, i, None, "tok", "buy" if i % 2 else "sell", None if i % 7 == 0 else 2.0, None if i % 5 == 0 else 3.0, 0.0, "price-proxy") for i in range(200)]
    df = spark.createDataFrame(odd, SCHEMA)
    name = F.coalesce("wallet", F.lit("none"))
    assert found(H.fifo_match(df, hot_rows=50).withColumn("wallet", name)) == found(L.fifo_match(df).withColumn("wallet", name)) != []


def test_blocks_are_even(spark):
    df = rows(spark, [("a" if i % 10 else "b", "buy" if i % 2 else "sell", 1, 1) for i in range(4000)])
    sizes = Counter(r.block for r in H.in_blocks(df, L.ORDER).select("block").collect())
    assert len(sizes) == 4 and max(sizes.values()) < 2 * sorted(sizes.values())[1]


def test_hot_markets_are_few(spark):
    df = rows(spark, [("a" if i % 10 else f"w{i}", "buy", 1, 1) for i in range(500)])
    assert [r.wallet for r in H.hot_markets(df, hot_rows=0, parts=10).collect()] == ["a"]
    assert H.hot_markets(df, hot_rows=450).count() == 0


def test_episodes_of_blocks_in_one_stored_pass(spark, monkeypatch):
    rng = random.Random(9)
    # often empty, and levels that fall below those of earlier blocks
    trades = [("a", "buy" if rng.random() < 0.45 else "sell", rng.randint(1, 4), 5) for _ in range(500)]
    df = rows(spark, trades)
    written = []
    monkeypatch.setattr(H, "stored", lambda d, true=H.stored: written.append(d.columns) or true(d))
    names = ["key", "before", "after", "sold", "bought_end", "sold_end", "episode"]
    plain, cut = (sorted(tuple(r) for r in d.select(*names).collect()) for d in (L.ledger_rows(df), H.block_ledger_rows(df)))
    assert cut == plain and max(r[-1] for r in cut) > 20
    assert len(written) == 1


def test_rows_of_blocks_are_dealt_once(spark, monkeypatch):
    """One exchange, by block, for the ledger rows and one for the matches, which are not written."""
    df = rows(spark, [("a", "buy" if i % 3 else "sell", 1 + i % 4, 1) for i in range(400)])
    written = []
    plan = lambda d: [x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "rangepartitioning" in x or ("Exchange " in x and "block" in x)]
    monkeypatch.setattr(H, "stored", lambda d, true=H.stored: written.append((d.columns, plan(d))) or true(d))
    out = H.block_match_rows(H.block_ledger_rows(df))
    wide = [dealt for columns, dealt in written if "key" in columns]
    for dealt in (*wide, plan(out)):
        assert len(dealt) == 1 and "hashpartitioning(block" in dealt[0]
    assert len(wide) == 1


def test_bounds_of_blocks(spark):
    places = [("a" if i % 3 else None, "buy", 1, 1) for i in range(900)]
    df = rows(spark, places).withColumn("slot", F.when(F.col("slot") % 7 > 0, F.floor(F.col("slot") / 2)))
    got = H.in_blocks(df, L.ORDER[:1]).select("wallet", "slot", "block").collect()
    in_order = sorted(got, key=lambda r: (r.wallet is not None, r.slot is not None, r.slot or 0))
    blocks = [r.block for r in in_order]
    assert blocks == sorted(blocks) and len(set(blocks)) == 4
    shared = {}
    for r in got:
        shared.setdefault((r.wallet, r.slot), set()).add(r.block)
    assert all(len(x) == 1 for x in shared.values())


def test_more_tasks_than_the_sessions_and_one(spark, monkeypatch):
    rng = random.Random(6)
    df = rows(spark, [("a", rng.choice(["buy", "sell"]), rng.randint(1, 9), rng.randint(1, 500)) for _ in range(700)])
    plain = found(L.fifo_match(df))
    monkeypatch.setattr(common, "TASK_ROWS", 90)
    assert len({r.block for r in H.in_blocks(df, L.ORDER).select("block").collect()}) > 20
    assert found(H.fifo_match(df, hot_rows=100)) == plain
    monkeypatch.undo()
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert found(H.fifo_match(df, hot_rows=100)) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


def test_the_query_joins_lines_and_parts_once(spark, sf_dir):
    from tidemark.plans import ledger as P

    assert not [f for f in P.e1_hot(spark, sf_dir).inputFiles() if "lineitem" in f]
