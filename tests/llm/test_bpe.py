import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken

from trackclean.llm import bpe
from trackclean.llm.shingles import raw

PARTS = ["a", "s", "t", "'", "'s", "'ll", "'re", "'v", "e", " ", "  ", "\n", "\t", "1", "٣", "é", "!", "?", "　", "\xa0", "\x1c", "中", "😀", "Ᲊ", "́",
         "\U0001e5f6", "'d", "'m", "'t", "x" * 70, " hello", " the", "<|endoftext|>", "͸", "\0"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_ids_are_the_librarys(vocabulary, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(6000)] + ["", "'ll", "ab" * 5000, " " * 200, "\n" * 65, "é" * 300]
    ids, counts = vocabulary.encode(*raw(pa.array(texts)))
    for part, text in zip(np.split(ids, np.cumsum(counts)[:-1]), texts, strict=True):
        assert part.tolist() == library.encode_ordinary(text)


def test_every_code_point_has_the_librarys_class(vocabulary, library):
    texts = [chr(c) + "a" + chr(c) + "1" + chr(c) + "!" + chr(c) for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    ids, counts = vocabulary.encode(*raw(pa.array(texts)))
    for part, text in zip(np.split(ids, np.cumsum(counts)[:-1]), texts, strict=True):
        assert part.tolist() == library.encode_ordinary(text)


def test_blocks_do_not_change_what_is_found():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 500, 4096, 9000):
        classes = rng.choice([bpe.LETTER, bpe.NUMBER, bpe.OTHER, bpe.INNER, bpe.OPEN, bpe.CLOSED], n).astype(np.uint8)
        state, want = bpe.NOTHING, []
        for i, c in enumerate(classes.tolist()):
            want += [i] * bool(bpe.BEGINS[c * 8 + state])
            state = int(bpe.STATE[c * 8 + state])
        assert bpe.piece_starts(classes).tolist() == want


def test_long_texts_are_cut_where_a_piece_starts(vocabulary, library):
    rng = random.Random(6)
    text = "".join(rng.choice(PARTS[:30]) for _ in range(4000)).encode()
    at = bpe.cuts(np.frombuffer(text, np.uint8), 50)
    assert len(at) > 20 and at[0] == 0 and at[-1] == len(text)
    ids = [i for a, b in zip(at, at[1:], strict=False) for i in library.encode_ordinary(text[a:b].decode())]
    assert ids == library.encode_ordinary(text.decode())


def test_digest_and_round_trip(spark, library):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(60))), "x") for i in range(200)]
    rows += [(200, None, "x"), (201, "", "x"), (None, "it's", "x"), (5, "again", "x"), (5, "again", "x"), (300, "word and 'll more " * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    order = lambda r: (str(r[0]), r[1:])
    assert sorted(map(tuple, bpe.bpe_digest(docs).collect()), key=order) == sorted(want, key=order)
    back = bpe.decoded(bpe.encoded(docs.filter("doc_id < 250"))).collect()
    assert sorted((r[0], bytes(r[1]).decode()) for r in back) == sorted((d, t or "") for d, t, _ in rows if d is not None and d < 250)
    assert bpe.bpe_digest(docs.filter("false")).collect() == []


def test_offsets_find_a_part(spark, vocabulary):
    text = "The première of it's 12 ﬁlms"
    row = bpe.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ids, offsets = np.array(row.ids), np.array(row.offsets)
    some = slice(2, 6)
    data = text.encode()
    assert vocabulary.decode(ids[some], offsets[some]).tobytes() == data[offsets[2] : offsets[6]]
