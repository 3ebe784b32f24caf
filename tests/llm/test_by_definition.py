"""Fingerprints and the classifier held against their definitions, written plainly."""

import cmath
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

from trackclean.llm import classifier, media, shingles


def strengths(frame):
    """The windowed frame's spectrum by the sum that defines it."""
    n = len(frame)
    x = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) for i, v in enumerate(frame)]
    return [abs(sum(v * cmath.exp(-2j * math.pi * k * i / n) for i, v in enumerate(x))) for k in range(n // 2 + 1)]


def test_peaks_by_the_definition_of_the_spectrum():
    rng = random.Random(3)
    text = " ".join(rng.choice(["the", "of", "media", "columns", "é", "0123"]) for _ in range(110)).encode()
    samples = media.payload_of(text)
    peaks = media.spectral_peaks(np.frombuffer(samples, np.uint8))
    n = max(1, -(-max(0, len(samples) - media.FRAME) // media.HOP) + 1)
    assert len(peaks) == n > 3
    silent = [v - 128 for v in samples] + [0] * media.FRAME
    for t in range(n):
        s = strengths(silent[t * media.HOP : t * media.HOP + media.FRAME])
        inner = sorted((-s[k], k) for k in range(1, len(s) - 1) if s[k] > s[k - 1] and s[k] >= s[k + 1])
        # strengths are in single precision, rounded to two places: what is closer than that may change places
        for (strength, _), got in zip(inner, peaks[t].tolist(), strict=False):
            assert abs(s[got] + strength) < 0.05


def test_pairs_and_feature_by_definition(spark):
    texts = ["", "a", "the media columns " * 30, "é" * 700, "abc" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in media.media_columns(rows).collect()}
    digests = {r.doc_id: r for r in media.media_digest(rows).collect()}
    for i, text in enumerate(texts):
        peaks = media.spectral_peaks(np.frombuffer(media.payload_of(text.encode()), np.uint8)).tolist()
        want = []
        for t, own in enumerate(peaks):
            for step in range(1, media.FAN + 1):
                if t + step < len(peaks) and peaks[t + step][0]:
                    want += [(t, p << 16 | peaks[t + step][0] << 8 | step) for p in own if p]
        want = sorted(want) or [(0, peaks[0][0] << 16)]
        assert found[i].pairs == [t << 24 | c for t, c in want]
        assert digests[i].feature == hashlib.sha256(b"".join((t << 24 | c).to_bytes(8, "little") for t, c in want)).hexdigest() and digests[i].n_pairs == len(want)


def shape(b):
    if b in b" \t\n\v\f\r":
        return "space"
    for name, of in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("mark", b"!#*$%&|<>@=+/_~^{}[]\\`"), ("stop", b".,;:?'\"()-")):
        if b in of:
            return name
    return "other"


def plain_features(text):
    data = text.encode()
    words = data.translate(shingles.LOWER.tobytes()).split()
    hashed = Counter(int.from_bytes(xxh3_128_digest(w, shingles.SEED)[:8], "little") % classifier.WORDS for w in words)
    n, lines = len(words), data.count(b"\n") + 1
    one = max(n, 1)
    x = [math.sqrt(hashed[k] / one) for k in range(classifier.WORDS)]
    shapes = Counter(map(shape, data))
    x += [shapes[s] / max(len(data), 1) for s in classifier.SHAPES]
    most = max(Counter(words).values(), default=0)
    return x + [math.log1p(len(data)) / 10, min(len(data) / one / 20, 2), math.log1p(n / lines) / 5, len(set(words)) / one, most / one, math.log1p(lines) / 5]


TEXTS = ["", "One Two two\nthree!", "\n\n", "é É ß", "a b c a b a", "Buy <b>now</b> $$$ 100%", "tab\tand\vother\x0cspaces\r", "x" * 300]


def test_features_by_plain_python():
    got = classifier.features(pa.array(TEXTS))
    assert np.allclose(got, np.array([plain_features(t) for t in TEXTS]), atol=1e-5)


def test_scores_by_all_pairs():
    """The sum-of-squares identity gives what the sum over all pairs of features does."""
    rng = np.random.default_rng(4)
    x = np.array([plain_features(t) for t in TEXTS], np.float32)
    m = classifier.Machine(0.3, rng.normal(0, 0.3, classifier.COLUMNS).astype(np.float32), rng.normal(0, 0.3, (classifier.COLUMNS, 4)).astype(np.float32), x[:, classifier.WORDS :].mean(axis=0), x[:, classifier.WORDS :].std(axis=0) + 1e-3)
    got = m.scores(x)
    for row, score in zip(x.astype(float), got, strict=True):
        row = row.copy()
        row[classifier.WORDS :] = np.clip((row[classifier.WORDS :] - m.centre) / m.scale, -4, 4)
        some = np.flatnonzero(row)
        z = m.bias + sum(row[i] * m.linear[i] for i in some)
        z += sum(float(m.factors[i] @ m.factors[j]) * row[i] * row[j] for a, i in enumerate(some) for j in some[a + 1 :])
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-4


def test_the_query_scores_with_what_it_has_fitted(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["good", "fine", "words"] if i % 2 else ["bad", "$$$", "!!"]) for _ in range(20))) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    machine = classifier.train(docs, labels)
    want = dict(zip([r[0] for r in rows], machine.scores(np.array([plain_features(t) for _, t in rows], np.float32)), strict=True))
    for r in classifier.quality_scores(docs, labels).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-3 and r.predicted == int(r.score >= 0.7)
