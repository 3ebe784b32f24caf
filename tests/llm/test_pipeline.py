import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from trackclean.llm import mixing, packing, quality

from .test_mixing import plain_mix
from .test_operators import COLUMNS, WORD, sample_rows, shingles, without_repeats


def first_words(text, k):
    return text if k == len(WORD.findall(text)) else re.match(r"(?:[ \t-\r]*[^ \t-\r]+){%d}" % k, text).group()


def pieces_of(text, tokenizer):
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    ends = range(len(ids) % packing.CAPACITY or packing.CAPACITY, len(ids) + 1, packing.CAPACITY)
    return [(k, start, end - start, zlib.crc32(np.asarray(ids[start:end], "<u4").tobytes())) for k, (start, end) in enumerate(zip([0, *ends], ends, strict=False))]


def test_stages(spark, tmp_path, monkeypatch):
    """Every stage against brute force, over what its predecessor kept; the rules against their operator."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(mixing, "SLOTS", 512)
    rows = [r for r in sample_rows()]
    spark.createDataFrame(rows, COLUMNS).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    (_, rules), (_, near), (_, repeats), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    one = rules(spark, docs, "").cache()
    assert {r.doc_id: r.text for r in one.collect()} == {i: text[i] for i in kept} and one.columns == corpus_pipeline.COLUMNS
    two = near(spark, one, "").cache()
    left = {r.doc_id: shingles(r.text) for r in two.collect()}
    assert two.columns == corpus_pipeline.COLUMNS and all(100 * len(a & b) < 75 * len(a | b) for i, a in left.items() for j, b in left.items() if i < j)
    three = repeats(spark, two, "").cache()
    want = without_repeats([(r.doc_id, r.text) for r in two.collect()])
    got = {r.doc_id: len(r.text.encode()) for r in three.collect()}
    assert three.columns == corpus_pipeline.COLUMNS and all(want[i][0] - want[i][1] - 6 * want[i][2] <= n <= want[i][0] - want[i][1] for i, n in got.items())

    four = mix(spark, three, "").cache()
    mixed = [(r.doc_id, r.source, r.text) for r in four.collect()]
    stream = [(r.doc_id, r.text, r.source) for r in three.collect()]
    by_slot = defaultdict(list)
    for (i, _), (slot, n, _) in plain_mix(stream, 512).items():
        by_slot[slot].append((stream[i][0], stream[i][2], first_words(stream[i][1], n)))
    at = 0
    for slot in sorted(by_slot):
        assert Counter(mixed[at : at + len(by_slot[slot])]) == Counter(by_slot[slot])
        at += len(by_slot[slot])
    assert four.columns == corpus_pipeline.COLUMNS and at == len(mixed) > 0

    five = pack(spark, four, "").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.MODEL))
    expected = Counter((d, *p) for d, _, t in mixed for p in pieces_of(t, tokenizer))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in five) == expected
    sequences = defaultdict(list)
    for r in five:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == list(itertools.accumulate((n for _, n in placed[:-1]), initial=0)) and sum(n for _, n in placed) <= packing.CAPACITY
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(five)
