import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for length in {len(rows[i][1]) for i in ok}:
        some = [i for i in ok if len(rows[i][1]) == length]
        x = np.array([rows[i][1] for i in some], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True):
            links[some[a]] += 1
            links[some[b]] += 1
            up[root(some[a])] = root(some[b])
    key = lambda d: -(1 << 63) if d is None else d
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d, key=key)
    return sorted(((d, links[i], least[root(i)], key(d) == key(least[root(i)])) for i, (d, _) in enumerate(rows)), key=repr)


def cluster(rng, center, n, noise):
    return [(center + noise * rng.standard_normal(len(center))).astype(np.float32).tolist() for _ in range(n)]


def corpus(seed, dim=64):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dim).astype(np.float32).tolist() for _ in range(150)]
    for noise in (0.05, 0.15, 0.2, 0.25, 0.3):
        out += cluster(rng, rng.standard_normal(dim), 30, noise)
    out += [out[0]] * 25 + [out[200]] * 3 + [(3 * np.array(out[1])).tolist()]
    return [(i * 3, v) for i, v in enumerate(out)]


def result(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(parts).withColumns({"NODE": F.lit(1), "a.b": F.lit(2), "N": F.lit(3)})
    return sorted((tuple(r) for r in ed.link_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize(("seed", "block"), [(1, 1000), (2, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (None, [2.0, 0.1]), (8, [1.0]), (9, [3.0]), (10, [-1.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.01, 0.0])]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_decode_finds_all_and_only_what_exceeds():
    rng = np.random.default_rng(5)
    x = ed.unit(rng.standard_normal((40, 21)))
    for blocks, words in ((1, 9), (2, 12), (3, 7)):
        code = ed.Code(21, blocks, words, 0)
        every = np.zeros((1, 0))
        for part, c in code.blocks:
            every = np.concatenate([np.repeat(every, words, axis=0), np.tile(c, (len(every), 1))], axis=1)
        product = (x @ code.turn)[:, np.concatenate([p for p, _ in code.blocks])] @ every.T
        row, name, found = code.decode(x, np.full(len(x), 0.2))
        want = set(zip(*np.nonzero(product >= 0.2), strict=True))
        assert set(zip(row.tolist(), name.tolist(), strict=True)) == want and len(row) == len(want)
        assert np.allclose(found, product[row, name])


@pytest.mark.parametrize("n", [500, 50_000, 2_000_000])
def test_filters_meet_pairs_at_the_bound(n):
    filters = ed.Filters(64, n, 0.95)
    rng = np.random.default_rng(9)
    x = ed.unit(rng.standard_normal((1500, 64)))
    z = rng.standard_normal((1500, 64))
    y = ed.unit(0.95 * x + np.sqrt(1 - 0.95**2) * ed.unit(z - (z * x).sum(axis=1, keepdims=True) * x))
    sizes = [len(a) for a, _ in filters.lists(x)]
    met = [len(np.intersect1d(a, b)) > 0 for (a, _), (b, _) in zip(filters.lists(x), filters.lists(y), strict=True)]
    assert np.mean(met) >= 0.995 and min(sizes) >= filters.least and np.mean(sizes) < 3 * filters.least


def test_recall_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    near = [(10**6 + i, (np.array(v) + 0.02 * np.random.default_rng(i).standard_normal(len(v))).tolist()) for i, v in rows[:300]]
    got, want = result(spark, rows + near), brute(rows + near)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) > 0
    assert all(g[1] <= w[1] for g, w in zip(sorted(got, key=lambda r: r[0]), sorted(want, key=lambda r: r[0]), strict=True))
