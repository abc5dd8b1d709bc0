import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard_join as jj
from tidemark.llm.components import connected

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 85 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", "Two words", "two WORDS", "one", "É x y z", "é x y z"]
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 300))]
        texts += [near(rng, base, rng.choice([0, 0, 1, 2, 3, len(base) // 30, len(base) // 20])) for _ in range(12)]
    texts += [" ".join([f"q{rng.randrange(10**5)}" for _ in range(rng.randint(5, 40))] + passage) for _ in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "block"), [(1, 4_000_000), (2, 7000), (3, 20_000)])
def test_equals_brute_force(documents, monkeypatch, seed, block):
    monkeypatch.setattr(jj, "BLOCK_BYTES", block)
    docs = documents(corpus(seed))
    monkeypatch.setattr(jj, "read_documents", lambda s, d: docs)
    got = sorted(tuple(r) for r in jj.query(docs.sparkSession, "").select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(corpus(seed))
    assert len({c for _, _, c in got}) < len(got)
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})


@pytest.mark.parametrize("block", [4_000_000, 9000])
def test_class_links_are_all_links(documents, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK_BYTES", block)
    rows = corpus(5)
    least = {}
    for d, t in rows:
        if s := frozenset(shingles(t)):
            least[s] = min(least.get(s, d), d)
    sets = sorted((d, s) for s, d in least.items())
    want = set()
    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if 100 * len(s & t) >= 85 * len(s | t):
                want.add((e, d, len(s & t)))
    got = [(min(r.left_id, r.right_id), max(r.left_id, r.right_id), r.shared) for r in jj.class_links(documents(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_frequent_shingles_part_families_nowhere(documents, monkeypatch):
    """Texts of a shared passage and few words of their own link over all salts, as the brute force says."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *[f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 9))]])) for i in range(80)]
    docs = documents(rows)
    monkeypatch.setattr(jj, "read_documents", lambda s, d: docs)
    got = sorted(tuple(r) for r in jj.query(docs.sparkSession, "").select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows) and len({c for _, _, c in got}) < 60


def test_keep_one_carries_clashing_columns(documents):
    docs = documents([(1, "a b c d e"), (2, "a b c d e"), (3, None)])
    for c in ("k_id", "k_hash", "node", "name", "n", "lone", "place", "least", "component"):
        docs = docs.withColumn(c, docs.doc_id)
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.k_id, r.place) for r in kept.collect()) == [(1, 1, 1), (3, 3, 3)]


def test_trees_lose_no_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(150):
        if sets and rng.random() < 0.5:
            s = sets[rng.integers(len(sets))].copy()
            s[rng.integers(len(s), size=max(1, len(s) // 25))] = rng.integers(1 << 62, size=max(1, len(s) // 25))
            sets.append(np.unique(s))
        else:
            sets.append(np.unique(rng.integers(1 << 62, size=rng.integers(1, 200)).astype(np.uint64)))
    want = {(i, j) for i in range(150) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= jj.needed(len(sets[i]), len(sets[j]))}
    tree = jj.Tree(sets, 1024)
    got = {(max(i, j), min(i, j)) for a, b in jj.candidate_pairs(tree, tree) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert want <= got and len(got) < 150 * 149 / 4


def test_repeated_rows_nulls_and_empty(documents, monkeypatch):
    docs = documents([(5, "a b c d e"), (5, "a b c d e"), (3, "A b c d e"), (3, "other words here now ok"), (None, "solo text of five words"), (9, None)])
    monkeypatch.setattr(jj, "read_documents", lambda s, d: docs)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, r.component_id) for r in jj.query(docs.sparkSession, "").collect())
    assert got == [(-1, 2, None), (3, 2, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 0, 9)]
    empty = documents([])
    monkeypatch.setattr(jj, "read_documents", lambda s, d: empty)
    assert jj.query(docs.sparkSession, "").collect() == []
    assert jj.keep_one(empty).collect() == []


def test_keep_one_of_components_with_one_id(documents):
    rows = [(3, "A b c d e"), (3, "other words here now ok"), (5, "a b c d e"), (None, "solo text of five words"), (None, "quite another text without id"), (None, "SOLO text of five words"), (7, "solo text of five words"), (None, None), (8, "")]
    kept = sorted(((-1 if r.doc_id is None else r.doc_id), (r.text or "").lower()) for r in jj.keep_one(documents(rows)).collect())
    assert kept == [(-1, ""), (-1, "quite another text without id"), (-1, "solo text of five words"), (3, "a b c d e"), (3, "other words here now ok"), (8, "")]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("percent", [85, 80, 55])
def test_linked_sets_agree_in_a_part(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for _ in range(1500):
        n = int(rng.integers(1, rng.choice([8, 30, 120, 900])))
        pool = np.unique(rng.integers(1 << 63, size=3 * n + 3).astype(np.uint64))
        rng.shuffle(pool)
        cut = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        s, t = np.sort(pool[:n]), np.sort(pool[int(rng.integers(0, cut + 1)) : n + cut])
        i = len(np.intersect1d(s, t))
        if len(s) and len(t) and len(np.setxor1d(s, t)) and 100 * i >= percent * (len(s) + len(t) - i):
            met += 1
            assert len(np.intersect1d(jj.signatures(s, percent), jj.signatures(t, percent)))
    assert met > 300


def test_shared_passages_form_no_family(documents):
    """Of unlike texts that share a passage few come to a task, and only the texts of families are kept."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*passage, *[f"x{rng.randrange(10**6)}" for _ in range(170)]])) for i in range(60)]
    rows += [(60, rows[0][1] + " more"), (61, rows[0][1])]
    join = jj._Join(documents(rows), 4, 85)
    assert 2 <= join.members.count() == join.texts.count() < 20
    assert sorted(r.component_id for r in jj.link_documents(documents(rows)).collect()) == sorted([0, 0, *range(60)])


def test_one_frequent_shingle_forms_no_family(documents):
    """At 80 percent parts hold two shingles too: texts that share one alone stay apart, else families grow faster than the input."""
    rng = random.Random(11)
    rows = [(i, " ".join([*[f"x{rng.randrange(10**6)}" for _ in range(rng.randint(60, 90))], "all of us say so", *[f"x{rng.randrange(10**6)}" for _ in range(20)]])) for i in range(200)]
    rows += [(200, rows[0][1] + " more")]
    join = jj._Join(documents(rows), 5, 80)
    assert join.members.count() == 2
    assert sorted(r.component_id for r in jj.link_documents(documents(rows), 5, 80).collect()) == sorted([0, *range(200)])
