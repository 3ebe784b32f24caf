"""The byte stream's scores against a plain tree, and that words are not scored apart from their neighbours."""

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from xxhash import xxh3_64_intdigest

from trackclean.llm import bytestream, ctw, queries

from .test_operators import WORD, lowered, sample_rows


def pairs(text):
    c = b"".join(w.encode() + b" " for w in WORD.findall(lowered(text))) + b"\n"
    padded = bytes(ctw.DEPTH - 1) + b" " + c
    return [(tuple(padded[i : i + ctw.DEPTH][::-1]), c[i]) for i in range(len(c))]


def bits(byte):
    node = 1
    for k in range(7, -1, -1):
        yield node, byte >> k & 1
        node = node * 2 + (byte >> k & 1)


def plain_scores(texts):
    """doc_id: log10 of the chance of its stream, by the tree of the texts that are not held out."""
    tree = defaultdict(lambda: [0, 0])
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for context, byte in pairs(t):
                for node, bit in bits(byte):
                    for d in range(ctw.DEPTH + 1):
                        tree[context[:d], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weight, below = {}, defaultdict(float)
    for key in sorted(tree, key=lambda k: -len(k[0])):
        context, node = key
        own = kt(*tree[key])
        weight[key] = own if len(context) == ctw.DEPTH else math.log(0.5) + np.logaddexp(own, below[key])
        if context:
            below[context[:-1], node] += weight[key]

    def chance(context, node, d=0):
        key = context[:d], node
        if key not in tree:
            return 0.5
        a, b = tree[key]
        if d == ctw.DEPTH:
            return (b + 0.5) / (a + b + 1)
        own = 1 / (1 + math.exp(min(below[key] - kt(a, b), 700)))
        return own * (b + 0.5) / (a + b + 1) + (1 - own) * chance(context, node, d + 1)

    known = {}

    def score(pair):
        if pair not in known:
            known[pair] = sum(math.log10(p if bit else 1 - p) for node, bit in bits(pair[1]) for p in [chance(pair[0], node)])
        return known[pair]

    return {i: sum(map(score, pairs(t))) for i, t in texts.items()}


def test_stream_scores(spark, monkeypatch):
    monkeypatch.setattr(bytestream, "BLOCK_BYTES", 8000)
    rows = [(r[0], r[1]) for r in sample_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_scores({i: t or "" for i, t in rows})
    of = {i: [*WORD.findall(lowered(t or "")), None] for i, t in rows}
    counts = Counter(w for i, x in of.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(counts.values()), len(counts)
    got = bytestream.score_texts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = of[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) and r.score == pytest.approx(want[r.doc_id], rel=1e-6)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (sum(len(x.encode()) + 1 for x in w[:-1]) + 1))
    # asks and answers of more blocks than are taken together
    monkeypatch.setattr(bytestream, "JOINED", 2)
    assert {r.doc_id: r.score for r in bytestream.score_texts(docs).collect()} == pytest.approx({r.doc_id: r.score for r in got})


def test_texts_in_pieces(spark, monkeypatch):
    """Long texts are coded in pieces; cuts fall into runs of white space, before the end, and behind a word without any."""
    rows = [(i, t or "") for i, t in ((r[0], r[1]) for r in sample_rows())]
    rows += [(9001, " \t\n" * 40 + "a b  c" * 90 + " " * 64), (9002, "q" * 300), (9003, "q" * 64 + " "), (9004, " " * 200), (9005, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    whole = {r.doc_id: r for r in bytestream.score_texts(docs).collect()}
    monkeypatch.setattr(bytestream, "SLICE_BYTES", 100)
    got = bytestream.score_texts(docs, piece_bytes=64).collect()
    assert len(got) == len(rows)
    for r in got:
        w = whole[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (w.n_tokens, w.n_known, w.train_tokens)
        assert (r.base_score, r.score, r.bits_per_byte) == pytest.approx((w.base_score, w.score, w.bits_per_byte), rel=1e-6)


def test_pieces_are_the_stream():
    for text in (b"", b"   ", b"ab cd  ef\n" * 50, b"x" * 500, b"x" * 64 + b" " + b"y" * 63 + b" "):
        buf = np.frombuffer(text, np.uint8)
        want = bytestream.stream_keys(buf, np.array([0, len(buf)]))[0].tolist()
        for size in (1, 5, 64, 1000):
            parts = list(bytestream.coded_pieces(buf, np.array([0, len(buf)]), size))
            assert [k for p in parts for k in p[3].tolist()] == want
            assert b"".join(p[1].tobytes() for p in parts) == text


def test_chances_sum_to_one():
    context = np.array([1, 2, 3, 0x7A7A7A7A7A7A], np.int64) << 20
    keys = np.sort(np.concatenate([(c << 8) | np.arange(256) for c in context]))
    counts = np.where(np.arange(len(keys)) % 7 == 0, 3, 0)
    rows = defaultdict(lambda: np.zeros(3))
    for node, *x in zip(*ctw.branch_top(keys, counts), strict=True):
        rows[int(node)] += x
    p = 10 ** ctw.log10_chances(keys, counts, ctw.top_of_tree([(k, *x) for k, x in rows.items()]))
    assert p.reshape(-1, 256).sum(axis=1) == pytest.approx(np.ones(4))


def test_order_of_words_counts(spark, tmp_path):
    """Texts that repeat one order of words: the same words in another order are less likely."""
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    a, b = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, "ab cd ef gh " * 20) for i in train] + [(a, "ab cd ef gh " * 5), (b, "gh ef cd ab " * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op2_context_tree_scores"](spark, str(tmp_path)).collect()}
    assert got[a].base_score == pytest.approx(got[b].base_score) and got[a].score > got[b].score + 1


def test_branches_without_training_text(spark):
    held = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(held, "zxcvbnm qwpoiuy 1234567890 -=+_"), (next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2), "ab")]
    want = plain_scores(dict(rows))
    got = {r.doc_id: r.score for r in bytestream.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_empty(spark):
    docs = spark.createDataFrame([(None, None), (None, "a b")], "doc_id long, text string")
    assert bytestream.score_texts(docs.limit(0)).count() == 0 and bytestream.score_texts(docs).count() == 2


def test_words_are_hashed_together(monkeypatch):
    """Only long words are hashed one by one; hashes do not depend on a word's neighbours, and a seed changes them."""
    alone = []
    monkeypatch.setattr(bytestream, "xxh3_64_intdigest", lambda w, seed: alone.append(w) or xxh3_64_intdigest(w, seed))
    words = [b"a", b"b", b"ab", b"ba", b"\0", b"\0\0", b"x" * 64, b"x" * 65, b"y" * 100_000] + [b"%d" % i for i in range(40_000)]
    got = bytestream.hashes(pa.array(words, pa.large_binary()), 0).tolist()
    assert alone == [b"x" * 65, b"y" * 100_000] and len(set(got)) == len(words)
    assert [bytestream.hashes(pa.array([w]), 0).tolist()[0] for w in words[:20]] == got[:20]
    assert not set(got) & set(bytestream.hashes(pa.array(words), 1).tolist())
    assert len(bytestream.hashes(pa.array([], pa.binary()), 0)) == 0


def test_words_of_one_hash_get_another_seed(monkeypatch):
    words = pa.array([b"a", b"b", b"c"])
    monkeypatch.setattr(bytestream, "hashes", lambda w, seed: np.array([[5, 7, 5], [1, 1, 2], [3, 2, 1]][seed]))
    seed, found = bytestream.telling(words)
    assert (seed, found.tolist()) == (2, [3, 2, 1])


@pytest.mark.parametrize("texts", (1, 256, 257, 700))
def test_chances_of_many_texts(texts):
    """More texts than are summed together, some without a key; keys of all 56 bits."""
    rng = np.random.default_rng(texts)
    keys = np.unique(np.append(rng.integers(0, 1 << 56, 500), [0, (1 << 56) - 1]))
    chance = -rng.random(len(keys)).astype(np.float32)
    text = np.sort(rng.choice(np.arange(0, texts, 1 + (texts > 1)), 3000))
    at = rng.integers(0, len(keys), 3000)
    want = np.bincount(text, weights=chance[at], minlength=texts)
    assert bytestream.summed_chances(keys, chance, keys[at], text, texts) == pytest.approx(want)


def test_asks_do_not_depend_on_how_much_is_sorted_at_once(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in sample_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {r.doc_id: r.score for r in bytestream.score_texts(docs).collect()}
    monkeypatch.setattr(bytestream, "SORTED", 500)
    monkeypatch.setattr(bytestream, "PENDING", 100)
    monkeypatch.setattr(bytestream, "SLICE_BYTES", 2000)
    assert {r.doc_id: r.score for r in bytestream.score_texts(docs).collect()} == pytest.approx(want)


def test_sums_are_added_to_in_chunks(monkeypatch):
    """Adding to many sums takes little more than they and what waits to be added, not copies of them all."""
    monkeypatch.setattr(bytestream, "PENDING", 50_000)
    monkeypatch.setattr(bytestream, "CHUNK", 10_000)
    rng = np.random.default_rng(5)
    parts = [np.sort(rng.choice(500_000, 20_000, replace=False)) for _ in range(150)]
    want = np.bincount(np.concatenate(parts), minlength=500_000)
    tracemalloc.start()
    keys, n = bytestream.added((p, np.ones(len(p), np.int64)) for p in parts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys.tolist() == np.flatnonzero(want).tolist() and n.tolist() == want[want > 0].tolist()
    assert most < 2 * (keys.nbytes + n.nbytes)
    keys, n = bytestream.added(iter([]))
    assert len(keys) == len(n) == 0


def test_asks_of_a_block(monkeypatch):
    """Words of many slices are not all held until the end, and asks are handed over in parts."""
    held_words = []
    concat = pa.concat_arrays
    monkeypatch.setattr(bytestream.pa, "concat_arrays", lambda x: held_words.append(sum(map(len, x))) or concat(x))
    monkeypatch.setattr(bytestream, "PENDING", 500)
    monkeypatch.setattr(bytestream, "HANDED", 100)
    texts = ["".join(f"w{(i * j) % 300} " for j in range(200)) for i in range(1, 60)]
    held = [i % 3 == 0 for i in range(len(texts))]
    pack = zstandard.ZstdCompressor()
    rows = [[7, [i], [h], [len(t)], pack.compress(t.encode())] for i, (t, h) in enumerate(zip(texts, held, strict=True))]
    batches = [pa.RecordBatch.from_pylist([dict(zip(["block", "doc_id", "held_out", "sizes", "texts"], r, strict=True)) for r in part]) for part in (rows[:20], rows[20:])]
    got = list(bytestream.block_asks(iter(batches), 12, 1 << 20))
    assert max(held_words) < 1500 and max(b.num_rows for b in got) <= 100 and all(b.schema == bytestream.ASKS for b in got)
    asks = [r for b in got for r in b.to_pylist()]
    assert {(r["block"], r["seed"]) for r in asks} == {(7, 0)}
    words, keys = Counter(), Counter()
    for t, h in zip(texts, held, strict=True):
        for w in [*t.encode().split(), b"\n"]:
            words[w] += not h
        for context, byte in pairs(t):
            keys[int.from_bytes(bytes([*context, byte]))] += not h
    assert {r["word"]: r["n"] for r in asks if r["word"] is not None} == dict(words)
    assert sum(r["word"] is not None for r in asks) == len(words) == len({r["hash"] for r in asks if r["word"] is not None})
    found = [(r["branch"], bytestream.unsqueezed_keys(r["keys"]), bytestream.unsqueezed(r["counts"], np.int64)) for r in asks if r["keys"] is not None]
    assert {k: n for _, x, y in found for k, n in zip(x.tolist(), y.tolist(), strict=True)} == dict(keys)
    assert sum(len(x) for _, x, _ in found) == len(keys) and len({b for b, _, _ in found}) == len(found)
    assert all((np.diff(x) > 0).all() for _, x, _ in found)
    of = {}
    assert all(of.setdefault(c, b) == b for b, x, _ in found for c in (x >> 40).tolist())


def test_answers_of_all_branches_are_put_in_order():
    rng = np.random.default_rng(11)
    keys = np.unique(np.append(rng.integers(0, 1 << 56, 900) & ~(63 << 50), [0, (1 << 56) - 1]))
    chance = -rng.random(len(keys)).astype(np.float32)
    rows = [(bytestream.squeezed_keys(keys[at]), bytestream.squeezed(chance[at])) for _, at in bytestream.branches_of(keys, 7)]
    got = bytestream.gathered(pa.table(dict(zip(("keys", "chances"), map(list, zip(*rows, strict=True)), strict=True))))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == chance.tolist()
