"""Quantiles against sorted lists, and the grid's numbers."""

import math
import random

from tidemark.operators import candidate_grid as C


def at(values, q):
    ordered = sorted(v for v in values if v is not None and math.isfinite(v) and v >= 0)
    return ordered[math.floor((len(ordered) - 1) * q)]


def test_quantiles_equal_sorted_lists(spark):
    rng = random.Random(3)
    # a heavy tail, one value in a third of all rows, zeros, and what is no value
    a = [rng.choice([7.25, 0.0, rng.lognormvariate(8, 4), rng.lognormvariate(0, 1e-9)]) for _ in range(3000)]
    b = [rng.choice([None, float("nan"), float("inf"), -1.0, rng.random() * 1e-12, 5.0 + rng.random() * 1e-7]) for _ in range(3000)]
    df = spark.createDataFrame(list(zip(a, b, [None] * 3000)), "a double, b double, c double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = {(r.column, r.q): r.value for r in C.lower_quantiles(df, {"a": qs, "b": qs, "c": qs}).collect()}
    assert got == {(n, q): at(v, q) for n, v in (("a", a), ("b", b)) for q in qs}


def test_thresholds_keep_the_free_one(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    free = C.thresholds(df, [C.Axis("x", (0.25, 0.5, 0.755), (1, 2, 4, C.FREE))], most=4)
    assert sorted(r.threshold for r in free.collect()) == [1, 2, 4, C.FREE]
    plain = C.thresholds(df, [C.Axis("x", (0.25, 0.5, 0.755), (60, -3))], most=4)
    assert sorted(r.threshold for r in plain.collect()) == [25, 50, 60, 75]
    none = C.thresholds(df.limit(0), [C.Axis("x", (0.5, 0.9), (3,))])
    assert sorted(r.threshold for r in none.collect()) == [0, 3]


def test_the_grid_and_its_bound(spark):
    levels = spark.createDataFrame([(a.column, float(x)) for a in C.AXES for x in a.fixed], "column string, threshold double")
    grid = C.candidate_grid(levels).cache()
    # repeat wallets x volume x swaps x shares, times liquidity x ratio x age where the cohort leaves them open
    assert grid.count() == 18 * 5 * 5 * 6 * 4 * 5 * 4 + 10 * 5 * 5 * 6
    assert grid.where("baseline").count() == 6 and grid.select("id").distinct().count() == grid.count()
    some = C.bounded(grid, 50).collect()
    rest = [r.id for r in some if not r.baseline]
    assert len(some) == 50 and sum(r.baseline for r in some) == 6
    assert rest == [r.id for r in grid.where("NOT baseline").orderBy("id").limit(44).collect()]
    one = grid.where("cohort = 'all' AND baseline").first()
    assert one.label == "all / repeat>=0 / liq>=0 / vol5m>=0 / buyShare=0-1 / swaps<=inf / vlr<=inf / age<=inf"
    assert grid.where("label LIKE '%buyShare=0.45-0.85 / swaps<=50 /%' AND label LIKE '%liq>=10000 %'").count() > 0
