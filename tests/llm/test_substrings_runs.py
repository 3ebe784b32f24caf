"""Texts of few different bytes: runs of one anchor split at every place of the seed."""

import random

import numpy as np
import pyarrow as pa
import pytest

from trackclean.llm import substrings
from trackclean.llm.shingles import raw


def by_window(texts):
    """(text, start): anchor, by looking at every window."""
    out = {}
    for t, text in enumerate(texts):
        buf = np.frombuffer(text + bytes(64), np.uint8)
        h = substrings.rolling(buf, substrings.SEED)
        for s in range(len(text) - substrings.LENGTH + 1):
            part = h[s : s + substrings.SPAN]
            out[t, s] = s + int(part.argmin())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_every_window_has_its_leftmost_least_seed(seed):
    rng = random.Random(seed)
    texts = [b"a" * 150, b"ab" * 130, b"- " * 90, b"", b"x" * 99, bytes(rng.choice(b"ab") for _ in range(400)), b"a" * 120 + b"b" * 120, bytes(rng.choice(b"abcdefgh") for _ in range(900))]
    rng.shuffle(texts)
    x = substrings.anchors(*raw(pa.array(texts)))
    got = {}
    for t, first, last, anchor in zip(*(x[k].tolist() for k in ("text", "first", "last", "anchor")), strict=True):
        for s in range(first, last + 1):
            assert (t, s) not in got
            got[t, s] = anchor
    assert got == by_window(texts)


def test_a_megabyte_of_one_byte(spark):
    n = 1_000_000
    rows = [(1, "a" * n), (2, "ab" * (n // 2)), (3, "b" + "a" * 200), (4, "short")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # all windows but the first of each kind start earlier
    assert got == {1: (n - 1, 1), 2: (n - 2, 1), 3: (200, 1), 4: (0, 0)}
