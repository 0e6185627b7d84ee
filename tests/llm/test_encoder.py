"""The encoder against the tokenizers library."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from voltrail.llm import packing


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    exact.encode_special_tokens = True
    return packing.Encoder("byte_bpe_50k.json"), lambda text: exact.encode(text, add_special_tokens=False).ids


def ids(encoder, text):
    return np.frombuffer(encoder([text])[0], "<u4").tolist()


def test_the_file_is_run_as_ranks(both):
    assert both[0].ranked


def test_all_code_points_are_cut_alike(both):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 211 == 0)]
    for at in range(0, len(points), 200):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)}  {chr(c)}.{chr(c)}" for c in points[at:at + 200])
        assert ids(both[0], text) == both[1](text)


@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r'st.,!9aZ<|>é漢🙂‍ \x1c\x85")), st.characters(exclude_categories=["Cs"])), max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_text(both, text):
    assert ids(both[0], text) == both[1](text)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 50_000, "\n" * 30_000 + "x", "^" * 30_000, "🙂" * 10_000, "<|endoftext|> " * 500, "ab cd  " * 20_000])
def test_long_texts(both, text):
    assert ids(both[0], text) == both[1](text)


def test_other_files_are_run_by_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = packing.Encoder("word_bpe_49k.json")
    assert not encoder.ranked
    exact = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for text in ("Some Words, and more.", "", " x "):
        assert ids(encoder, text) == exact.encode(text, add_special_tokens=False).ids
