import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(3)
    bits = ["a", " ", "  ", "\n", " ", "'s", "éß", "7", "!?", "\t", "\x1c", "<|endoftext|>", "thing", "ation", "日本"]
    return [None, "", " ", "abc" * 3000, "the cat's hat", "nbsp x   y", "zz<|endoftext|>", "word " * 3000] + ["".join(rng.choices(bits, k=25)) for _ in range(80)]


def test_equals_the_library_and_round_trips(documents, library, monkeypatch):
    docs = documents(list(enumerate(texts())))
    monkeypatch.setattr(bpe, "read_documents", lambda s, d: docs)
    got = {r.doc_id: r for r in bpe.query(docs.sparkSession, "").collect()}
    assert len(got) == len(texts())
    for i, t in enumerate(texts()):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha(" ".join(map(str, ids)).encode())
        assert got[i].decoded_sha256 == sha((t or "").encode())


def test_folds_equal_the_library(spark, library):
    words = ["a", "the", " the", "entthion", " ourenati", "éàü", "\n\n", "!!!", "Zzyzx", "0123456789", "日本語"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold_merges(F.col("w"), bpe.load_ranks(PATH)).alias("ids")).collect()
    assert {r.w: r.ids for r in rows} == {w: library.encode_ordinary(w) for w in words}


def test_merge_in_a_task_equals_the_library(library):
    rng = random.Random(5)
    for _ in range(300):
        w = "".join(rng.choices("abcdethinorés", k=rng.randint(1, 60)))
        assert bpe.merge_bytes(w.encode(), bpe.load_ranks(PATH)) == library.encode_ordinary(w)


def test_empty_table(documents):
    assert bpe.encode(documents([])).collect() == []
