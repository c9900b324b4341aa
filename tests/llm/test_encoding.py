"""Piecewise encoding against whole-text encoding."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import encoding

ENCODERS = {
    name: encoding.PieceEncoder(encoding.tokenizer_path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")
}


def check(name, texts):
    coder = ENCODERS[name]
    got = []
    for ids, ends in coder.encode(pa.array(texts, pa.string())):
        assert ends[-1] == len(ids)
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [coder.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ENCODERS)
def test_hard_texts(name):
    check(name, [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "a \n b", "\n\n a", "x y  z", "é ́e",
                 "I'm  it's ' s", "<|endoftext|> a", "a  <|endoftext|>  b", "<|startoftext|>", "\x1c a\x1f", "a \x1cb", "ΑΣ ΑΣ.",
                 "12 345", "ß ẞ İ", "tab\t tab", "a\r\nb", "　 x", "word " * 5000,
                 "“quoted” – a…b €5 x²", "it's don't 's'S I'LL", "a\n\n b \n\nc\t\td", "a,b;c--d &&& x### 1234 5,6", "Ā İ ĭ ĸ ŉ µ ª"])


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sa.1éΣ<|́ "), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_any_text(name, texts):
    check(name, texts)


def test_small_cache(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE", 2)
    check("byte_bpe_50k.json", ["one two three", "two three four", "", "five  six"] * 3)


def test_kinds_and_slices(monkeypatch):
    assert {n: e.kind for n, e in ENCODERS.items()} == {"byte_bpe_50k.json": "bytes", "word_bpe_49k.json": "words"}
    monkeypatch.setattr(encoding, "SLICE", 20)
    for name in ENCODERS:
        check(name, ["one two", None, "three  four", "", "five " * 9, "ΑΣ", "<|endoftext|>", "six"] * 3)


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZéÉ'st 1.,#\n\t–“€²ª\xa0"), max_size=30), max_size=6))
def test_nearly_simple_texts(name, texts):
    check(name, texts)
