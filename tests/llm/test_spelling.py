import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from trackclean.llm import spelling
from trackclean.llm.shingles import raw


def near_words(w, known, letters):
    found = {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters}
    found |= {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in letters}
    return (found - {w}) & known.keys()


def counted(rows, altered=97):
    n = Counter()
    for d, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % altered == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(rows, altered=97):
    known = counted(rows, altered)
    letters = {c for w in known for c in w}
    first = {}
    for w, n in known.items():
        near = near_words(w, known, letters)
        form = min(near, key=lambda x: (-known[x], x), default=None)
        form = form if form and known[form] >= 2 * n else None
        first[w] = (form, n, len(near), known.get(form))
    out = set()
    for w, (form, n, k, form_n) in first.items():
        root = w
        while first[root][0]:
            root = first[root][0]
        out.add((w, form, root, n, k, form_n))
    return out


def some_rows(n):
    rng = random.Random(4)
    letters = "abcdeéÿ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    words += [w[:2] + rng.choice(letters) + w[3:] for w in words] + [w + rng.choice(letters) for w in words] + ["aaaaa", "aaaaaa", "ababab", "bababab", "Aaaaaa"]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(60))), "x", 1) for i in range(n)]
    return rows + [(None, "Straße aaaaa nulls", "x", 1)] * 4 + [(7, None, "x", 1), (8, "", "x", 1), (9, "× ÷ 12 -", "x", 1)]


SCHEMA = "doc_id long, text string, word string, n int"


def test_variants_by_definition(spark):
    rows = some_rows(400)
    got = spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA), altered=11)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    want = brute(rows, 11)
    assert len(found) == len(set(found)) and set(found) == want and max(r[4] for r in want) > 5
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_deals_are_dealt_again(spark):
    rng = random.Random(9)
    words = sorted({"prefix" + "".join(rng.choice("abc") for _ in range(rng.randrange(3, 6))) + "suffixes" for _ in range(300)})
    table = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    known = {w: i + 1 for i, w in enumerate(words)}
    want = {(w, x, known[x]) for w in words for x in near_words(w, known, "abc")}
    for most in (4, 10_000):
        found = [tuple(r) for r in spelling.near_pairs(table, most).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_automaton_is_minimal_and_numbers_its_words():
    words = sorted(["a" * 5, "taste", "tasted", "tastes", "waste", "wasted", "wastes", "paste"])
    found = spelling.Automaton(words)
    assert found.words[found.root] == len(words)
    for i, w in enumerate(words):
        assert found.exact(w, 0, found.root, 0) == i
    assert found.exact("tast", 0, found.root, 0) == -1
    # right languages: of a's path 5 and the end, "(aste(d|s|)" 6 and its end shared by t and w, and so on
    assert len(found.ways) == len({right_language(words, p) for w in words for p in [w[:k] for k in range(len(w) + 1)]})


def right_language(words, prefix):
    return frozenset(w[len(prefix) :] for w in words if w.startswith(prefix))


def test_stretches_count_as_whole_texts_do():
    rng = random.Random(1)
    text = " ".join(rng.choice(["Hello", "éÀx", "x" * 300, "12"]) for _ in range(200))
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], ["doc_id", "text"])
    whole = spelling.altered_counts(*raw(pa.array([text])), [5], 2)
    before, spelling.STRETCH = spelling.STRETCH, 50
    try:
        parts = Counter()
        for buf, offsets, docs in spelling._stretches(batch):
            for w, n in zip(*spelling.altered_counts(buf, offsets, docs, 2), strict=True):
                parts[w] += int(n)
    finally:
        spelling.STRETCH = before
    assert +parts == +Counter(dict(zip(whole[0], whole[1].tolist(), strict=True)))


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w3")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {a: "w40" for a, _ in chain}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).collect() == []
