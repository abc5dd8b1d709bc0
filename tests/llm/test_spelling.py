import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import spelling


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def near(v, w):
        if len(v) == len(w):
            return sum(a != b for a, b in zip(v, w, strict=True)) == 1
        v, w = sorted((v, w), key=len)
        return len(w) == len(v) + 1 and any(w[:i] + w[i + 1 :] == v for i in range(len(w)))

    form, count = {}, {}
    for w in n:
        beside = [v for v in n if near(v, w)]
        count[w] = len(beside)
        best = min(beside, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n[w], form[w], n[form[w]] if form[w] else None, root(w), count[w]) for w in n)


def corpus(seed):
    rng = random.Random(seed)
    bases = ["planet", "aaaaaa", "bookkeeper", "Straße", "mississippi", "élèves", "x" * 70, "ab" * 40]
    words = []
    for base in bases:
        words += [base] * rng.randint(150, 400)
        for _ in range(25):
            w, letters = list(base), "abés"
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters), w[at]])
            words += ["".join(w)] * rng.choice([2, 5, 6, 30, 60])
    rng.shuffle(words)
    texts = [rng.choice([" ", "-", "1", "\n"]).join(words[i : i + 40]) for i in range(0, len(words), 40)]
    return [*enumerate(texts), (None, " ".join(["planet", "PLANET"] * 4)), (7, None), (8, ""), (9, "12 é!"), (3, texts[3])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(documents, monkeypatch, seed):
    monkeypatch.setattr(spelling, "COUNTED", 40)
    rows = corpus(seed)
    got = spelling.group_spellings(documents(rows).withColumns({"WORD": F.lit(1), "a.b": F.lit(2), "N": F.lit(3)}))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_chains_follow_to_the_last(documents):
    rows = [(0, " ".join(["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdgg"] * 125 + ["abcggg"] * 625))]
    got = {r.word: (r.form, r.root) for r in spelling.group_spellings(documents(rows)).collect()}
    assert got["abcdef"] == ("abcdeg", "abcggg") and got["abcggg"] == (None, "abcggg")


def test_ranges_are_bounded_by_the_alphabet():
    prefixes = Counter(p for c in "abcdefghijklmnopqrstuvwxyz" for p, _ in spelling.rotations(f"plan{c}tary"))
    assert max(prefixes.values()) == 26


def test_rotations_of_long_words_stay_short():
    assert max(len(p) for p, _ in spelling.rotations("ab" * 5000)) < 120
    lacking = {p for p, kind in spelling.rotations("q" * 40 + "r" * 40) if kind == spelling.WHOLE}
    assert any(p in lacking for p, kind in spelling.rotations("q" * 40 + "z" + "r" * 40) if kind == spelling.FIRST)


def test_empty_table(documents):
    assert spelling.group_spellings(documents([])).collect() == []
