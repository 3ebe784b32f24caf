"""The mix against one made slot by slot in plain Python."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil

from trackclean.llm import mixing

from .test_operators import WORD, sample_rows, targets_of

md5 = lambda s: hashlib.md5(s.encode()).hexdigest()


def plain_mix(rows, slots):
    """rows: (doc_id, text, source). (number of the row, turn): [first slot, words, slots]."""
    sizes = Counter()
    n = [len(WORD.findall(r[1] or "")) for r in rows]
    for r, k in zip(rows, n, strict=True):
        sizes[r[2]] += k
    words, target = sum(n), targets_of(sizes)
    key = lambda i: md5("" if rows[i][0] is None else str(rows[i][0]))
    row_key = lambda r: md5(f"{'' if r[0] is None else r[0]}|{'' if r[2] is None else md5(r[2])}|{r[1] or ''}")
    stream = defaultdict(list)
    for i in sorted(range(len(rows)), key=lambda i: (key(i)[:3], key(i), rows[i][0] or 0, n[i], row_key(rows[i]))):
        stream[rows[i][2]] += [i] * n[i]
    b = max(1, ceil(words / slots))
    names = [s for s in sorted((s for s in sizes if s is not None)) + [None] * (None in sizes) if sizes[s]]
    edges, at = {}, 0.0
    for s in names:
        edges[s] = at, (at := at + target[s] / words)
    want = {s: round(target[s]) for s in names}
    ranks = Counter()
    out = defaultdict(lambda: [None, 0, set()])

    def take(slot, s):
        blocks = ceil(sizes[s] / b)
        turn, block = divmod(ranks[s], blocks)
        ranks[s] += 1
        left = want[s] - turn * sizes[s] if turn == want[s] // sizes[s] else sizes[s] if turn < want[s] // sizes[s] else 0
        for i in stream[s][block * b : max(block * b, min((block + 1) * b, left))]:
            x = out[i, turn]
            x[0] = slot if x[0] is None else min(x[0], slot)
            x[1] += 1
            x[2].add(slot)

    for slot in range(slots):
        x = Fraction(slot * mixing.GOLDEN % (1 << 32), 1 << 32)
        take(slot, next((s for s in names if edges[s][0] <= x < edges[s][1]), names[-1]))
    for s in names:
        while ranks[s] <= (want[s] // sizes[s] + 1) * ceil(sizes[s] / b):
            take(slots + ranks[s], s)
    return out


def test_mix_slot_by_slot(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 512)
    monkeypatch.setattr(mixing, "STRETCH", 64)
    rows = [(r[0], r[1], r[3]) for r in sample_rows()] + [(3, "another text of the third", "s1"), (3, "a third one", "S0"), (None, "no number at all", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = plain_mix(rows, 512)
    want = Counter()
    for i, r in enumerate(rows):
        mine = [x for (k, _), x in found.items() if k == i]
        want[(r[0], len(WORD.findall(r[1] or "")), sum(x[1] for x in mine), min((x[0] for x in mine), default=None), len(set().union(*[x[2] for x in mine])))] += 1
    got = Counter((r.doc_id, r["size"], r.taken, r.first_slot, r.n_slots) for r in mixing.mix_digest(docs).collect())
    assert got == want
    turns = Counter((r.turn, r.first_slot, r.words) for r in mixing.taken_documents(docs).collect())
    assert turns == Counter((turn, x[0], x[1]) for (_, turn), x in found.items())


def test_more_slots_for_more_words():
    assert mixing.number_of_slots(10) == 1 << 17 and mixing.number_of_slots(1 << 34) == 1 << 17 and mixing.number_of_slots((1 << 34) + 1) == 1 << 18
