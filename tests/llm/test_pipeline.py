"""The whole pipeline against a plain version of each stage."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe

W = re.compile(r"[^\x20\x09-\x0D]+")


def texts(rng):
    base = [[f"w{rng.randrange(3000)}" for _ in range(200)] for _ in range(4)]
    passage = [f"p{i}" for i in range(55)]
    out = []
    for i in range(40):
        own = [f"o{i}x{rng.randrange(9000)}" for _ in range(rng.randint(60, 160))]
        if i % 4 == 0:
            own = list(base[i % 3])
            own[rng.randrange(200)] = "changed"
        elif i % 4 == 1:
            own[30:30] = passage
        elif i % 4 == 2:
            own = own[:20] if i % 8 == 2 else ["same", "old", "words"] * 40
        out.append(" ".join(own))
    return [*out, out[3], None, "", "tiny"]


def plain(rows):
    def repeat_words(w):
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        return len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)})

    good = [(d, t, s) for d, t, s in rows if len(W.findall(t or "")) >= 50 and 100 * repeat_words(W.findall(t)) <= 50 * len(W.findall(t))]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (W.findall(t.lower()) for _, t, _ in good)]
    comp = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    lone = [good[i] for i in sorted(set(comp))]
    count = Counter(tuple(w[i : i + 35]) for _, t, _ in lone for w in [W.findall(t)] for i in range(len(w) - 34))
    cut = []
    for d, t, s in lone:
        w = W.findall(t)
        gone = {i + k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(35)}
        cut.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t, s))
    size = {d: len(W.findall(t)) for d, t, _ in cut}
    per = defaultdict(int)
    for d, _, s in cut:
        per[s] += size[d]
    order = sorted(per)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = 1.5 * sum(per.values()) - sum(2.0 * per[s] for s in order if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * per[s]}
        if not over:
            break
        open_ -= over
    target = {s: share.get(s, 2.0 * per[s]) for s in order}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    out = []
    for d, t, s in cut:
        rate = target[s] / per[s]
        u = int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:12], 16) / 2**48
        ids = library.encode_ordinary(t)
        out += [(d, s, len(ids), " ".join(map(str, ids)), hashlib.sha256(t.encode()).hexdigest())] * (int(rate) + (u < rate - int(rate)))
    return sorted(out)


def test_stages_equal_the_plain_version(spark: SparkSession, documents, tmp_path):
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(texts(random.Random(11)))]
    documents([(d, t, "en", s) for d, t, s in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = plain(rows)
    assert got == want and 10 < len({d for d, *_ in want}) < len(rows)


def test_stages_keep_columns_and_take_empty_tables(spark, documents, tmp_path):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.collect() == []


def test_a_stage_leaves_the_results_of_others_alone(spark, documents):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", f"s{i % 3}") for i in range(12)]
    docs = documents(rows)
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    n = kept.count()
    one = corpus_pipeline.near_duplicates(spark, docs, "")
    assert one.count() == 12
    corpus_pipeline.repeated_passages(spark, docs, "").count()
    assert kept.count() == n and one.count() == 12


def test_rows_of_one_document_and_odd_names(spark, documents):
    """Which of several rows with one id and text stays does not depend on the order of rows; dots and case in names do no harm."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = documents([(1, text, lang, "s") for lang in ("a", "b", "c")]).withColumns({"a.b": F.col("lang"), "DOC_ID_2": F.lit(1)})
    first = corpus_pipeline.near_duplicates(spark, rows, "")
    again = corpus_pipeline.near_duplicates(spark, rows.orderBy(F.desc("lang")).coalesce(1), "")
    assert first.columns == rows.columns and [tuple(r) for r in first.collect()] == [tuple(r) for r in again.collect()] and first.count() == 1
