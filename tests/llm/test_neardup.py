"""Rows that share a doc_id, tiny tables, hash-like words, hot buckets, and the recall of what is near the threshold."""

import random

import numpy as np
import pyarrow as pa

from trackclean.llm import neardup
from trackclean.llm.shingles import shingle_sets

from .test_operators import shingles


def labels(spark, rows):
    return neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_rows_of_one_doc_id(spark):
    """Each of the texts of one doc_id is linked to what is like it, and to nothing else."""
    text = lambda k, n=100: " ".join(f"{k}{j}" for j in range(n))
    rows = [(0, text("a")), (0, text("b")), (1, text("a", 98)), (2, text("b", 98)), (3, text("c")), (5, text("a", 99)), (5, text("d")), (5, text("d"))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in labels(spark, rows))
    assert got == [(0, 0, True), (0, 0, True), (1, 0, False), (2, 0, False), (3, 3, True), (5, 0, False), (5, 5, True), (5, 5, True)]
    stay = neardup.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in stay.collect()) == [0, 0, 3, 5]


def test_a_table_of_few_words(spark):
    """Batches of fewer words than a shingle has, alone and in front of a text that is a batch of its own."""
    for n in range(7):
        text = " ".join(f"w{i}" for i in range(n))
        assert [len(s) for s in shingle_sets(pa.array([text]))] == [max(n - 4, min(n, 1))]
    assert [(r.n_shingles, r.component_id) for r in labels(spark, [(7, "hello world")])] == [(1, 7)]
    assert {r.doc_id: r.n_shingles for r in labels(spark, [(7, "hello world"), (8, "x " * 300_000)])} == {7: 1, 8: 1}


def test_structured_words_are_told_apart(spark):
    """Words that a polynomial hash modulo a power of two takes for the same: a Thue-Morse word and its complement."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert [r.component_id for r in sorted(labels(spark, [(1, a), (2, b)]))] == [1, 2]


def test_hot_bucket_in_many_parts(spark, monkeypatch):
    """Chains of near copies that all share a long passage, with indexes and streams of a few sets."""
    monkeypatch.setattr(neardup, "INDEXED", 500)
    monkeypatch.setattr(neardup, "STREAMED", 3)
    monkeypatch.setattr(neardup, "CHUNK", 2)
    shared = [f"s{j}" for j in range(60)]
    rows = [(100 * c + k, " ".join(shared + [f"c{c}w{j}" for j in range(10 * k, 10 * k + 90)])) for c in range(5) for k in range(6)]
    want = {i: i // 100 * 100 for i, _ in rows}
    assert {r.doc_id: r.component_id for r in labels(spark, rows)} == want


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.8: all are linked, as a miss has a chance of 5 in a million; those below are not."""
    rng = random.Random(3)
    rows, want = [], {}
    while len(rows) < 1600:
        words = [f"{len(rows)}x{j}" for j in range(rng.randint(60, 300))]
        other = list(words)
        for k in rng.sample(range(len(words)), max(1, len(words) * rng.randint(25, 40) // 1000)):
            other[k] += "y"
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        similar = 100 * len(a & b) / len(a | b)
        if 70 <= similar <= 80:
            want[len(rows) + 1] = len(rows) if similar >= 75 else len(rows) + 1
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in labels(spark, rows)}
    assert all(got[i] == k for i, k in want.items()) and len(set(want.values()) & {i - 1 for i in want}) > 100


def test_held_sets_tell_all_similar_ones():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 40, 30, dtype=np.uint64)
    sets = []
    for _ in range(120):
        own = rng.integers(0, 1 << 40, int(rng.integers(1, 60)), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([common[: int(rng.integers(0, 30))], own])))
    sets += [np.unique(np.append(s[: len(s) - len(s) // 8], np.uint64(k))) for k, s in enumerate(sets[:60])]
    held = neardup.Held(sets)
    for s in sets:
        want = [k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))]
        assert held.similar(s, held.candidates(s)).tolist() == want


def test_many_texts_of_one_doc_id_and_a_bucket_of_many_components(spark):
    """A shared passage puts texts into one bucket that are not similar; sizes at which quadratic work does not end."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(1, " ".join(word() for _ in range(30))) for _ in range(5000)]
    rows += [(i, passage + " " + " ".join(word() for _ in range(40))) for i in range(10, 6010)]
    rows += [(7000 + i, rows[5000 + i][1] + " end") for i in range(20)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.component_id for r in got}
    assert all(found[7000 + i] == 10 + i for i in range(20))
    assert all(found[i] == i for i in range(10, 6010))
