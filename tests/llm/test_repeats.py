import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import repeats, substring_dedup, suffix_dedup

sha = lambda b: hashlib.sha256(b).hexdigest()
W = re.compile(r"[^\x20\x09-\x0D]+")


def flagged(units, width):
    """Brute force: per document, which units lie in a window that also starts elsewhere."""
    count = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        f = [False] * len(u)
        for i in range(len(u) - width + 1):
            if count[tuple(u[i : i + width])] > 1:
                f[i : i + width] = [True] * width
        out.append(f)
    return out


def corpus(rng, n):
    base = [" ".join(rng.choice(["alpha", "be", "gamma", "né", "x"]) + str(rng.randint(0, 99)) for _ in range(300)) for _ in range(4)]
    texts = [None, "", " \t", "short", "periodic " * 200, "a" * 900, base[0], base[0]]
    for _ in range(n):
        b = rng.choice(base).split(" ")
        i = rng.randint(0, 200)
        own = [f"own{rng.random()}" for _ in range(rng.randint(0, 60))]
        texts.append(rng.choice([" ", "\n", "  "]).join(own[:30] + b[i : i + rng.randint(20, 100)] + own[30:]))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_brute_force(documents, seed):
    rng = random.Random(seed)
    texts = corpus(rng, 60)
    rows = substring_dedup.remove_repeats(documents(list(enumerate(texts))), ["doc_id"]).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    units = [W.findall(t or "") for t in texts]
    for i, f in enumerate(flagged(units, 35)):
        assert got[i].n_words == len(units[i]) and got[i].n_removed == sum(f)
        assert got[i].kept == " ".join(w for w, x in zip(units[i], f, strict=True) if not x)
    assert any(r.n_removed for r in rows) and any(r.n_words > r.n_removed for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_brute_force(documents, monkeypatch, seed):
    rng = random.Random(seed)
    texts = corpus(rng, 50)
    docs = documents(list(enumerate(texts)))
    monkeypatch.setattr(suffix_dedup, "read_documents", lambda s, d: docs)
    got = {r.doc_id: r for r in suffix_dedup.query(docs.sparkSession, "").collect()}
    units = [(t or "").encode() for t in texts]
    assert len(got) == len(texts)
    for i, f in enumerate(flagged(units, 200)):
        assert got[i].n_bytes == len(units[i]) and got[i].n_removed == sum(f), (i, got[i], sum(f))
        assert got[i].n_spans == sum(x and not y for x, y in zip(f, [False, *f[:-1]], strict=True)) if f else got[i].n_spans == 0
        assert got[i].kept_sha256 == sha(bytes(b for b, x in zip(units[i], f, strict=True) if not x))


@pytest.mark.parametrize("step", [1, 3])
def test_transform_sorts_all_suffixes(step):
    rng = random.Random(7)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 14))) for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    data = np.frombuffer(b"".join(strings), np.uint8)
    starts = suffix_dedup.suffix_order(*suffix_dedup.numbered(data, offsets, step), step, 1)
    owner = np.searchsorted(offsets, starts, "right") - 1
    suffix = lambda p, j: strings[j][p - offsets[j] :]
    # all places from which a whole symbol follows, in the order of the symbols and the ends behind them
    assert sorted(starts.tolist()) == [offsets[j] + i for j, s in enumerate(strings) for i in range(len(s) - step + 1)]
    whole = [suffix(p, j)[: len(suffix(p, j)) // step * step] + b"\xff" * step for p, j in zip(starts, owner, strict=True)]
    assert whole == sorted(whole)


def test_shared_windows_equal_brute_force():
    rng = random.Random(9)
    strings = [bytes(rng.choices(b"abc", k=rng.randint(0, 60))) for _ in range(60)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    data = np.frombuffer(b"".join(strings), np.uint8)
    for width, step in ((8, 8), (8, 4), (6, 4)):
        count = Counter(s[i : i + width] for s in strings for i in range(len(s) - width + 1))
        want = [i + width <= len(s) and count[s[i : i + width]] > 1 for s in strings for i in range(len(s))]
        assert suffix_dedup.shared_windows(data, offsets, width, step).tolist() == want


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_chunks_hold_whole_names(monkeypatch, size):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", size * 16)
    rng = random.Random(2)
    names = np.sort(np.array([rng.randint(0, 20) for _ in range(300)] + [21] * 200))
    cuts = [0, *sorted(rng.sample(range(1, 500), 20)), 500]
    batches = [pa.RecordBatch.from_arrays([pa.array(names[a:b]), pa.array(np.arange(a, b))], ["name", "i"]) for a, b in zip(cuts, cuts[1:])]
    tables = list(repeats._chunks(iter(batches)))
    assert [i for t in tables for i in t["i"].to_pylist()] == list(range(500))
    seen = [set(t["name"].to_pylist()) for t in tables]
    assert sum(map(len, seen)) == len(set(names.tolist())) and (size > 500 or len(seen) > 5)


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_clashing_columns(documents, module):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, text), (2, text), (3, "other words")])
    for c in ("packed", "spans", "n_words", "n_removed", "kept", "k_id", "o_0", "r_0", "first", "name"):
        docs = docs.withColumn(c, docs.doc_id * 10)
    left = module.remove_repeats(docs, docs.columns)
    assert len(left.columns) == len(set(left.columns))
    assert sorted((r.doc_id, r.packed, r.o_0, r.r_0, r.n_removed > 0) for r in left.collect()) == [(1, 10, 10, 10, True), (2, 20, 20, 20, True), (3, 30, 30, 30, False)]


def test_very_long_text(documents):
    """A text of a million words loses what it repeats, and no other."""
    words = [f"w{i}" for i in range(1_000_000)]
    words[600_000:600_040] = words[100:140]
    rows = substring_dedup.remove_repeats(documents([(1, " ".join(words)), (2, "short")]), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in rows) == [(1, 1_000_000, 80), (2, 1, 0)]


def test_repeated_ids_nulls_and_empty(documents):
    text = " ".join(f"w{i}" for i in range(50))
    rows = documents([(1, text), (1, text), (None, text), (1, "other"), (2, None)])
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(rows, ["doc_id", "lang"]).collect())
    assert got == [(0, 0, ""), (1, 0, "other"), (50, 50, ""), (50, 50, ""), (50, 50, "")]
    assert substring_dedup.remove_repeats(documents([]), ["doc_id"]).collect() == []
    assert suffix_dedup.remove_repeats(documents([]), ["doc_id"]).collect() == []


@pytest.mark.parametrize("by_words", [True, False])
def test_hot_names_meet_each_stretch_once(documents, monkeypatch, by_words):
    monkeypatch.setattr(repeats, "HOT_NAME", 4)
    rng = random.Random(3)
    texts = corpus(rng, 30)
    passage = " ".join(f"shared{i}" for i in range(40))
    texts += [" ".join([f"l{rng.random()}" for _ in range(20)] + [passage] + [f"r{rng.random()}" for _ in range(20)]) for _ in range(60)]
    seen = []
    within = repeats._hot_spans

    def hot_spans(segments, by_words, width, find):
        seen.append(segments.count())
        return within(segments, by_words, width, find)

    monkeypatch.setattr(repeats, "_hot_spans", hot_spans)
    module, width = (substring_dedup, 35) if by_words else (suffix_dedup, 200)
    got = {r.doc_id: r for r in module.remove_repeats(documents(list(enumerate(texts))), ["doc_id"]).collect()}
    units = [W.findall(t or "") if by_words else (t or "").encode() for t in texts]
    assert seen and seen[0] > 60
    for i, f in enumerate(flagged(units, width)):
        assert got[i].n_removed == sum(f), i


def test_common_passage_is_dealt_as_few_segments(documents, monkeypatch):
    """A passage in 60 texts of their own reaches the tasks as few distinct stretches, not as one for each text."""
    monkeypatch.setattr(repeats, "HOT_NAME", 4)
    rng = random.Random(5)
    passage = " ".join(f"shared{i}" for i in range(40))
    docs = documents([(i, " ".join([f"l{rng.random()}" for _ in range(20)] + [passage] + [f"r{rng.random()}" for _ in range(20)])) for i in range(60)])
    total = docs.sparkSession.sparkContext.accumulator(0)

    def find(distinct, times):
        total.add(len(distinct))
        return substring_dedup.passages(distinct, times, 35)

    assert repeats.repeated_spans(docs, True, 35, 8, find).select("k_id").distinct().count() == 60
    assert 0 < total.value < 20
