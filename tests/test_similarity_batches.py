"""Similarities of a batch of pairs."""

import random
import time

import pandas as pd

from tests.test_linkage import lcs
from tidemill.functions.text import common_lengths


def test_lengths_equal_dynamic_program():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcé1 𝄞\0") for _ in range(r.randint(0, n)))
    pairs = [(text(n), text(m)) for n in (3, 30, 64, 65, 130) for m in (3, 64, 130) for _ in range(25)] + [(None, "a"), ("a", None), (None, None), ("", "a")] * 2
    got = common_lengths(*(pd.Series(side, dtype=object) for side in zip(*pairs)))
    assert list(got) == [-1 if a is None or b is None else lcs(a, b) for a, b in pairs]


def test_many_pairs_take_little_time():
    """A batch needs a bounded time, so that all pairs of a service and day can be scored."""
    r = random.Random(4)
    text = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz@.0") for _ in range(r.randint(10, 36)))
    a, b = (pd.Series([text() for _ in range(100_000)]) for _ in "ab")
    began = time.process_time()
    common_lengths(a, b)
    assert time.process_time() - began < 15
