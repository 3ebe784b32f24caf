"""License scans against a brute-force containment scan of all windows, short templates and the families."""

import random
import re

import pyarrow as pa
import pytest

from trackclean.llm import licenses

T = re.compile(rb"[0-9a-z\x80-\xff]+")
LONG = {name: x if isinstance(x, str) else x[0] for name, x in licenses.TEMPLATES.items() if len(T.findall((x if isinstance(x, str) else x[0]).encode().lower())) >= licenses.LONG + 4}


def words_of(text):
    return T.findall(text.encode().lower())


def brute(text, template, reach=16):
    """The highest containment of the template in any window of the text, of so many eighths of the template's length."""
    w, t = words_of(text), words_of(template)
    if len(t) < 5:
        return float(any(w[i : i + len(t)] == t for i in range(len(w) - len(t) + 1)))
    m = len(t) - 4
    s = {tuple(t[i : i + 5]) for i in range(m)}
    x = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    size = max(m + 2, m * reach // 8)
    return max((len(s & set(x[i : i + size])) / len(s) for i in range(len(x))), default=0.0)


def names(text):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    return {scanner.names[x[1]] for x in scanner.scan(pa.array([text]))[0]}


def test_short_notices():
    assert names("All rights reserved.") == {"Proprietary notice"} and names("words (c) 2020 all rights RESERVED") == {"Proprietary notice"}
    assert names("under GPL v3 or so") == {"GPL-3.0 notice"} and names("it is under the MIT licence") == {"MIT notice"}
    assert names("all rights are reserved") == set() and names("all rights") == set()
    both = licenses.Scanner(licenses.TEMPLATES).scan(pa.array(["so all rights", "reserved, and so on"]))
    assert both[0] == []


def test_families():
    for name, x in licenses.TEMPLATES.items():
        for wording in (x,) if isinstance(x, str) else x:
            assert name in names("some words before. " + wording + " and some behind"), wording
    assert names(licenses.TEMPLATES["GPL-2.0 header"]) == {"GPL-2.0 header"}
    assert names(licenses.TEMPLATES["BSD-2-Clause"] + " " + licenses.TEMPLATES["BSD-3-Clause"]) == {"BSD-2-Clause", "BSD-3-Clause"}


def altered(rng, words, how):
    w = list(words)
    for n, k in enumerate(sorted(rng.sample(range(len(w)), max(1, rng.randint(len(w) // 40, len(w) // 15 + 1))), reverse=True)):
        w[k : k + (how != "insert")] = {"replace": [f"other{n}"], "insert": [f"new{n}x{j}" for j in range(4)], "delete": []}[how]
    return [f"a{j}" for j in range(rng.randrange(40))] + w + [f"b{j}" for j in range(rng.randrange(40))]


@pytest.mark.parametrize("how", ["replace", "insert", "delete"])
def test_altered_copies_against_all_windows(how):
    """Copies with words replaced, deleted, or runs of four inserted, near the threshold on both sides: a template is found
    if and only if a window contains enough of it. Retrieval is certain, so recall is 1."""
    rng = random.Random(9)
    near = 0
    for name, template in LONG.items():
        scanner = licenses.Scanner({name: template})
        texts = [" ".join(altered(rng, template.split(), how)) for _ in range(60)]
        best = [0.0] * len(texts)
        for d, _, _, _, share in scanner.scan(pa.array(texts))[0]:
            best[d] = max(best[d], share)
        for text, got in zip(texts, best, strict=True):
            widest, tight = brute(text, template), brute(text, template, licenses.REACHES[0])
            near += 0.75 <= widest <= 0.9
            assert (got > 0) == (100 * widest >= licenses.SHARE) and (100 * tight < licenses.SHARE or got >= tight)
    assert near > 100


def test_place_of_a_copy():
    """The words that a match names are those of the copy, also where two copies follow each other."""
    template = LONG["MIT"]
    n = len(words_of(template))
    text = "x y z " + template + " " + template + " u v"
    got = sorted((x[2], x[3], x[4]) for x in licenses.Scanner({"MIT": template}).scan(pa.array([text]))[0])
    assert got == [(3, n, 1.0), (3 + n, n, 1.0)]


def test_tables_of_few_words(spark):
    for n in range(7):
        rows = [(1, " ".join(f"w{i}" for i in range(n)))]
        scanner = licenses.Scanner(licenses.TEMPLATES)
        assert scanner.scan(pa.array([rows[0][1]]))[0] == []
    rows = [(1, "hello world"), (2, "x " * 200_000), (3, "y " * 200_000 + LONG["ISC"])]
    got = {r.doc_id: r.licenses for r in licenses.license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "ISC"}


def test_many_notices_in_one_text(spark):
    text = "All rights reserved. " * 50_000
    found, words = licenses.Scanner(licenses.TEMPLATES).scan(pa.array([text]))
    assert len(found) == 50_000 and words.tolist() == [150_000]
