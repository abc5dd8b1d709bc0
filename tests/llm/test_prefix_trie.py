import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for c, *t in rows:
        if c is not None:
            turns.setdefault(c, []).append(t)
    convs = {c: [(r or "", x or "") for _, r, x in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0))] for c, ts in turns.items()}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    nodes = {}
    for c, path in full.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children, below = {}, {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    out = []
    for node, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(node))))
        saved = sum((len(nodes[v]) - 1) * len(v[-1][1]) for v in below[node] if v)
        leaves = sum(v not in children for v in below[node])
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=260):
    rng = random.Random(seed)
    texts = [f"t{i}é" * rng.randint(1, 4) for i in range(3)] + [None, ""]
    rows = []
    for c in rng.sample(range(700), n):
        k = rng.choice([1, 2, 3, 5, 8, 12])
        same = rng.random() < 0.4
        rows += [(c, None if i == 0 and rng.random() < 0.3 else i, "user" if same else rng.choice(["user", "assistant", None]), "again" if same else rng.choice(texts)) for i in range(k)]
    rows += [(5000, i, "user", f"long {i % 7}") for i in range(900)]
    rows += [(5001, i, "user", f"long {i % 7}") for i in range(700)]
    rng.shuffle(rows)
    return rows


def result(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"N_convs": F.lit(1), "a.b": F.lit(2), "path": F.lit("x")})
    return sorted((tuple(r) for r in pt.prefix_trie(df).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize(("seed", "nodes"), [(1, 500_000), (2, 40), (3, 5), (4, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, nodes):
    monkeypatch.setattr(pt, "SHARD_NODES", nodes)
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


def test_copies_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(pt, "SHARD_NODES", 8)
    rows = [(c, i, "user", x) for c in range(0, 6000, 100) for i, x in enumerate(["hi", "yo", *(["a", "b", "c"] if c % 300 else [])])]
    assert result(spark, rows, 7) == brute(rows)


def test_edges(spark):
    one = [(3, 0, None, None), (None, 1, "user", "of no conversation"), (3, 0, None, None)]
    assert result(spark, one) == brute(one)
    # a conversation whose turns all give way to those of an absent one keeps none
    gone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    turnless = [(gone, 0, "user", "x")]
    assert result(spark, turnless) == brute(turnless) and len(brute(turnless)) == 1
    assert result(spark, []) == []


@pytest.mark.parametrize("size", [1, 3, 70, 700, 9000])
def test_findclose(size):
    rng, signs, open_ = random.Random(size), [], 0
    for _ in range(size):
        if open_ and rng.random() < rng.choice([0.2, 0.6]):
            signs.append(-1)
            open_ -= 1
        else:
            signs.append(1)
            open_ += 1
    signs += [-1] * open_
    stack, want = [], {}
    for i, s in enumerate(signs):
        if s > 0:
            stack.append(i)
        else:
            want[stack.pop()] = i
    parens = pt.Parens(np.array([1, *signs, -1], np.int8))
    assert parens.findclose(parens.opens).tolist() == [len(signs) + 1, *[want[i] + 1 for i in sorted(want)]]
