"""Likeness by blocks, against the standard library."""

from difflib import SequenceMatcher

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.functions.likeness import ratios

SHORT = st.text("abcé ", max_size=12)
LONG = st.lists(st.sampled_from(["a", "b", "ab ", "zq", "é", "\U0001f600", "cab"]), max_size=150).map("".join)


def expected(xs, ys):
    return [SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(xs, ys, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(SHORT | LONG, SHORT | LONG), min_size=1, max_size=8))
def test_ratios_are_those_of_longest_blocks(pairs):
    xs, ys = zip(*pairs, strict=True)
    assert np.allclose(ratios(list(xs), list(ys)), expected(xs, ys), rtol=0, atol=1e-12)


def test_frequent_characters_of_long_texts():
    """Only characters that are too frequent; rare ones between them; a text and itself; both sides of the limit."""
    rare = "".join(chr(0x4E00 + i) + "aaab"[i % 4] for i in range(120))
    texts = ["a" * 199, "a" * 200, "ab" * 150, rare, rare[::-1], "x" + rare, "", "b" * 3, rare[:199], rare[:200]]
    pairs = [(x, y) for x in texts for y in texts]
    xs, ys = zip(*pairs, strict=True)
    assert np.allclose(ratios(list(xs), list(ys)), expected(xs, ys), rtol=0, atol=1e-12)
    assert ratios([], []).shape == (0,)
