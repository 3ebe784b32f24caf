"""op6 where rows share a doc_id, and op5 beside literal marks and in long parts without spaces."""

import random

from trackclean.llm import substrings, tokens


def test_repeats_of_rows_that_share_a_doc_id(spark):
    rng = random.Random(2)
    x, y, tail = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(1, x), (5, x + tail), (5, y)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 300, 0), (5, 300, 0), (5, 600, 300)]


def test_tokens_beside_marks_and_in_long_parts():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(tokens.MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ["▁ 😀", *["".join(rng.choice("abcde THE.,01▁▁éñ日本😀") for _ in range(40)) for _ in range(2000)], *["".join(rng.choice("abcxyzTHE.,01") for _ in range(60)) for _ in range(500)]]
    for longest in (tokens.LONGEST, 5):
        assert tokens.PieceCounter(path, longest=longest).counts(texts) == [len(t) for t in model.encode(texts)]
