import random

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import tokens

SAMPLES = [
    None,
    "",
    " ",
    "a",
    "  lead and trail  ",
    "it's we'll they'd 'tis 're",
    "x<|endoftext|> y <|endoftext|>",
    "a  <|endoftext|>\n\n b",
    "tab\there\r\nnew\n\n\nline  two   three",
    "nbsp here   and there  x　y",
    "ctrl\x1c!\x1c a\x0bb\x0cc",
    "日本語のテキスト と 中文",
    "emoji 😀😀 é",
    "12ab34 cd56",
    "z" * 5000,
    "word " * 9000,
    "nbsp word " * 5000,
]


def expected(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return len(t.encode(text or "", add_special_tokens=False))


def test_equals_the_library(documents):
    rng = random.Random(1)
    bits = ["a", " ", "  ", "\n", "\u00a0", "'s", "é", "7", "!", "\t", "\x1c", "<|endoftext|>", "word", "\u2009"]
    texts = SAMPLES + ["".join(rng.choices(bits, k=30)) for _ in range(150)]
    got = {r.doc_id: r for r in tokens.count_tokens(documents(list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].n_tokens == expected(t), repr(t)[:80]
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 1024)


def test_small_memory_gives_the_same(documents, monkeypatch):
    c = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tokens, "KEEP_PIECES", 2)
    monkeypatch.setattr(tokens, "CALL_BYTES", 5)
    texts = ["one two three four", "five six one two " * 3, "seven"]
    for _ in range(2):
        assert c.counts(texts) == [expected(t) for t in texts]


def test_empty_table(documents):
    assert tokens.count_tokens(documents([])).collect() == []
