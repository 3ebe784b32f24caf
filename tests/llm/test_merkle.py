import hashlib
import random
import zlib
from collections import Counter

from trackclean.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, level int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    """The top of a list of nodes and each one's (left, right) siblings from below."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, i in enumerate(at):
            g = i // 8 * 8
            paths[k].append(("".join(level[g:i]), "".join(level[i + 1 : g + 8])))
        at = [i // 8 for i in at]
        level = [sha(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    by_lang = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        low = None if text is None else "".join(c.lower() if c.isascii() else c for c in text)
        leaf, other = (sha(*map(said, (doc_id, source, lang, n_chars, t))) for t in (text, low))
        altered = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 3 == 0
        by_lang.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, other if altered else leaf, doc_id))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for k in langs:
        by_lang[k].sort(key=lambda x: x[:3])
    trees = {k: tree([r[2] for r in by_lang[k]]) for k in langs}
    root, upper = tree([trees[k][0] for k in langs])
    out = []
    for k, above in zip(langs, upper, strict=True):
        for (_, _, leaf, h, doc_id), path in zip(by_lang[k], trees[k][1], strict=True):
            path = path + above
            for left, right in path:
                h = sha(left, h, right)
            out.append((doc_id, leaf, trees[k][0], root, sha(*[x for p in path for x in p]), h, h == root))
    return Counter(out)


def test_manifest_by_definition(spark):
    rng = random.Random(3)
    rows = [(i, f"Text {i} É", rng.choice(["en", "fr"]), f"s{i % 5}", i, "x", 1) for i in range(300)]
    rows += [(i, "A", f"lang{i % 11}", None, None, "x", 1) for i in range(300, 330)]
    rows += [(400, None, None, None, None, None, None), (None, "B", None, "s", 1, None, None), (None, "", "alone", "s", 1, None, None)]
    rows += [(7, "Same", "en", "s", 4, None, None)] * 9 + [(7, "Other", "en", "s", 5, None, None)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_trees_of_several_passes_and_of_nothing(spark):
    rows = [(i, f"Words {i}" if i % 2 else f"words {i}", "en", "s", 7, None, None) for i in range(4700)] + [(-1, "x", "fr", "s", 1, None, None)]
    got = Counter(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows)
    # altered rows verify only where lower case leaves the text as it is
    wrong = {r[0] for r in got if not r[6]}
    assert wrong == {i for i in range(4700) if i % 2 or i >= 0 and f"Words {i}"[0] == "W" and i % 2} & {i for i in range(4700) if zlib.crc32(str(i).encode()) % 3 == 0}
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert Counter(map(tuple, merkle.manifest(spark.createDataFrame(rows[:1], SCHEMA)).collect())) == brute(rows[:1])
