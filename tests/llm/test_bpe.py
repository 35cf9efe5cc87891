import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, odd
from veilspark.llm import bpe

CODER = bpe.ChunkCoder(bpe.tokenizer_path())
HARD = ["", "a b \r\n c \x0b d \u2003 e", "a", "  a  b\n\nc ", "x<|endoftext|>y z <|startoftext|>", "́ á á", "a b\r\n c\x0b\x0cd", "ΣΑΣ ΟΔΟΣ İ " * 40, "ab" * 3000 + " " + "c" * 5000 + "  \t\n " * 30 + "don't 's 'd ", "ẞ Ω Å"]


def exact(text):
    ids = CODER.tok.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), CODER.tok.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert list(CODER.code([text])) == [exact(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["the", " ", "\n", "\t", "́", "it's", "<|endoftext|>", "12ab"])), max_size=120).map(" ".join))
def test_any_text(text):
    assert list(CODER.code([text])) == [exact(text)]


def test_chunks_cover_the_text_and_are_shared():
    passage = " ".join(f"w{i * 7 % 31}x{i}" for i in range(600))
    a, b = bpe.ChunkCoder.cut("intro one two " + passage), bpe.ChunkCoder.cut("other start here and there " + passage)
    assert "".join(a) == "intro one two " + passage and len(set(a) & set(b)) >= 3


PIECES = ["don't", "<|endoftext|>", "<|", "|>", "endoftext", "###", "...", " ", " ", " ", "\n", "é", "́", "a", "b12", "x'", "'s", "$", "İ", " the ", "<|startoftext|>", "한", "q" * 30]


def pieced(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(PIECES) for _ in range(n))


def test_borders_cut_words_and_are_repaired():
    """Without its repair the coder gives other ids, at the borders that it sets itself."""
    coder, texts = bpe.ChunkCoder(bpe.tokenizer_path()), [pieced(i, 2000) for i in range(40)]
    assert list(coder.code(texts)) == [exact(t) for t in texts]
    assert coder.repaired > 100 and coder.checked > 500
    plain = bpe.ChunkCoder(bpe.tokenizer_path())
    cut = [plain.cut(t) for t in texts]
    plain.fill([x for chunks in cut for x in chunks])
    joined = [b"".join(plain.chunks[x][0] for x in chunks) for chunks in cut]
    assert sum(a != exact(t)[0] for a, t in zip(joined, texts, strict=True)) > 20
    assert any(a[-1:].strip() and b[:1].strip() for chunks in cut for a, b in zip(chunks, chunks[1:], strict=False))


@pytest.mark.parametrize("text", ["x" * 20_000 + " y", "é. " * 9000, "a.b," * 9000, " " * 30_000, "." * 30_000 + " a"])
def test_long_texts_are_cut_at_white_space_only_where_there_is_some(text):
    chunks = bpe.ChunkCoder.cut(text)
    assert "".join(chunks) == text and all(set(x) & set(" \t\n") for x in chunks[:-1])
    assert list(CODER.code([text])) == [exact(text)]


def test_full_dictionaries_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 10)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    coder = bpe.ChunkCoder(bpe.tokenizer_path())
    for text in HARD * 2:
        assert list(coder.code([text])) == [exact(text)]


def test_a_join_that_disagrees_is_repaired(monkeypatch):
    monkeypatch.setattr(bpe.ChunkCoder, "cut", staticmethod(lambda t: [t[i : i + 5] for i in range(0, len(t), 5)]))
    coder = bpe.ChunkCoder(bpe.tokenizer_path())
    text = "overlapping words with no border at all here"
    assert list(coder.code([text])) == [exact(text)] and coder.repaired


def test_table(spark):
    docs = odd(spark)
    out = bpe.encode(docs).collect()
    assert len(out) == 10 and all((bytes(r.ids), r.decoded) == exact(r.text or "") and r.n_tokens == len(r.ids) // 4 for r in out)
    assert bpe.encode(documents(spark, [])).count() == 0
    assert [f.name for f in bpe.encode(docs, keep=["doc_id"]).schema] == ["doc_id", "n_tokens", "ids", "decoded"]
