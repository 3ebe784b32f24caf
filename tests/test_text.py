import pytest
from pyspark.sql import functions as F

from trackclean.functions import text as X
from trackclean.functions.flags import detect_issues, is_unreadable

CASES = {
    "number": [("03 - some tune", "some tune"), ("7. Abc", "Abc"), ("12 Abc", "Abc"), ("12 a", "12 a"), ("9mm", "9mm"), ("1234 abc", "1234 abc")],
    "separators": [("a_broken_name", "a broken name"), ("name — with dash", "name - with dash"), ("a  b", "a b"), (" x -- y ", "x - y")],
    "tempo": [
        ("Tune [160]", "Tune"), ("Tune (160 bpm)", "Tune"), ("Tune 178-200bpm", "Tune"), ("Tune [190–220]", "Tune"),
        ("Tune [160] 178-200bpm", "Tune"), ("Tune (Live)", "Tune (Live)"), ("[160bpm]", "[160bpm]"), ("Tune 1999", "Tune 1999"),
        ("Tune [1] [120] [130] [140]", "Tune [1]"),
    ],
    "mix": [("Tune (Original Mix)", "Tune"), ("Tune - original mix", "Tune"), ("Tune Original Mix", "Tune"), ("Original", "Original")],
    "case": [("the tree of life", "The Tree of Life"), ("dj shadow", "DJ Shadow"), ("don't stop", "Don't Stop"), ("live in the uk", "Live in the UK"), ("one-two/three", "One-Two/Three")],
}
RULES = {
    "number": X.strip_track_number,
    "separators": lambda c: X.normalize_separators(c)["value"],
    "tempo": X.strip_tempo,
    "mix": X.strip_original_mix,
    "case": X.smart_title_case,
}


@pytest.mark.parametrize("rule", CASES)
def test_rule(spark, rule):
    df = spark.createDataFrame(CASES[rule], "s string, want string").withColumn("got", RULES[rule](F.col("s")))
    assert [(r.s, r.got) for r in df.collect()] == CASES[rule]


def test_rules_are_stable_on_their_output(spark):
    for rule in ("number", "tempo", "separators"):
        df = spark.createDataFrame([(w,) for _, w in CASES[rule]], "s string").withColumn("got", RULES[rule](F.col("s")))
        assert all(r.s == r.got for r in df.collect() if r.s not in ("12 a", "9mm"))


FILES = [
    ("Name - 03 - Tune.wav", False, ("Name", "Tune")), ("03 - Name - Tune.mp3", False, ("Name", "Tune")), ("10. Name - Tune.flac", False, ("Name", "Tune")),
    (". Name - Tune.flac", False, ("Name", "Tune")), ("04 - Tune.wav", False, (None, "Tune")), ("Name - Tune.wav", False, None), ("Name - Tune.wav", True, ("Name", "Tune")),
    ("N - Tune.wav", True, None), ("Name_-_03_-_Tune.ogg", False, ("Name", "Tune")), ("noise.ogg", True, None),
]


def test_filenames(spark):
    df = spark.createDataFrame([(f, t) for f, t, _ in FILES], "f string, two boolean").withColumn("p", X.parse_filename(F.col("f"), F.col("two")))
    assert [None if r.p is None else (r.p.artist, r.p.title) for r in df.collect()] == [w for _, _, w in FILES]


def test_generic_symbolic_unreadable(spark):
    names = ["Track 5", "Untitled 7", "Audio Track 03", "T9", "12", "9mm", "Track Record", "iii", "aaa", "xiv", "abc", "??", "a", None]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = df.select(X.text(F.col("s")).rlike(X.GENERIC).alias("g"), X.is_symbolic(F.col("s")).alias("y"), is_unreadable(F.col("s")).alias("u")).collect()
    assert [r.g for r in got] == [True] * 5 + [False] * 9
    assert [r.y for r in got] == [False] * 7 + [True, True, True, False, False, True, False]
    assert [n for n, r in zip(names, got, strict=True) if r.u] == ["12", "??", None]


def test_flags(spark):
    rows = [("03 - va - x_y", None), ("Name - Tune", ""), ("Tune [160]", "N"), ("Tune (160bpm)", "N"), ("TUNE OF ALL", "N"), (None, "N"), ("Same", "same "), ("tune webrip", "N")]
    df = spark.createDataFrame(rows, "t string, a string").select(detect_issues(F.col("t"), F.col("a")).alias("f"))
    got = [r.f for r in df.collect()]
    assert got[0] == ["artist_missing", "embedded_track_number", "embedded_artist", "weird_separators", "bad_capitalization", "missing_artist_but_present_in_title"]
    assert got[1] == ["artist_missing", "embedded_artist", "missing_artist_but_present_in_title"]
    assert got[2] == [] and got[3] == ["bpm_suffix"] and got[4] == ["bad_capitalization"]
    assert got[5] == ["unreadable_title"] and got[6] == ["duplicate_artist_title"] and got[7] == ["bad_capitalization", "scene_junk"]


def test_int_ish(spark):
    df = spark.createDataFrame([("3/12",), ("2021-05-03",), (" 7 ",), ("x",), ("",), (None,)], "s string").select(X.int_ish(F.col("s")).alias("n"))
    assert [r.n for r in df.collect()] == [3, 2021, 7, None, None, None]
