import hashlib
import json

from pyspark.sql import functions as F

from trackclean.operators import albums, decisions, modelio, normalize, suggest
from trackclean.options import Options

SCHEMA = "root string, path string, filename string, ext string, track_number int, disc_number int, title string, artist string, album string, album_artist string, mtime_us long, size_bytes long"


def album(spark, titles, artists=None, root="/lib/a", files=None, album_artists=None):
    artists = artists or ["Some Name"] * len(titles)
    rows = [(root, f"{root}/{i:03}.flac", (files or {}).get(i, f"{i:03}.flac"), ".flac", i, None, t, a, None, (album_artists or {}).get(i), i, 10) for i, (t, a) in enumerate(zip(titles, artists, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def prefix_of(spark, titles):
    rows = albums.common_prefix(album(spark, titles)).collect()
    return rows[0].album_prefix if rows else None


def test_common_prefix(spark):
    assert prefix_of(spark, [f"Zed - Tune {c}" for c in "abcd"]) == "Zed - "
    assert prefix_of(spark, [f"Zed - Disk - Tune {c}" for c in "abc"]) == "Zed - Disk - "
    assert prefix_of(spark, ["Zed - a1", "Zed - b1", "Cc", "Dd", "Ee"]) is None
    assert prefix_of(spark, ["Zed - a1", "Zed - b1"]) is None
    assert prefix_of(spark, ["Zed - X1 - a", "ZED - X2 - b", "zed - X3 - c"]) == "Zed - "


def test_prefix_equals_a_naive_scan(spark):
    import random

    rng = random.Random(3)
    for _ in range(6):
        titles = [" - ".join(rng.choice(["Aa", "Bb", "Cc"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 9))]
        cuts = {" - ".join(t.split(" - ")[:i]) + " - " for t in titles for i in range(1, len(t.split(" - ")))}
        need = max(2, int(len(titles) * 0.6))
        fit = [c for c in cuts if len(c) >= 4 and sum(t.startswith(c) for t in titles) >= need]
        got = prefix_of(spark, titles)
        assert (got is None) == (not fit) and (got is None or (got in fit and len(got) == max(map(len, fit))))


def test_sample_and_probe(spark):
    for n, want in ((1, [0]), (2, [0, 1]), (3, [0, 1, 2]), (4, [0, 1, 3]), (10, [0, 1, 4, 9])):
        got = albums.album_sample(album(spark, ["Tune"] * n)).orderBy("pos").collect()
        assert [r.pos for r in got] == want
    assert albums.probe_scores(album(spark, ["Good Tune"] * 10)).first().score == 1.0
    assert albums.probe_scores(album(spark, ["Track 1", None, "??", "12"])).first().score < 0.6
    r = albums.probe_scores(album(spark, ["Tune", None, "Tune", " ", "Tune"])).first()
    assert r.sampled_paths == [f"/lib/a/{i:03}.flac" for i in (0, 1, 2, 4)] and r.notes == ["001.flac: empty title"]


def test_sample_positions_are_an_option(spark):
    o = Options(sample_positions=("last", "second", "nowhere"))
    assert [r.pos for r in albums.album_sample(album(spark, ["Tune"] * 5), o).orderBy("pos").collect()] == [1, 4]
    r = albums.probe_scores(album(spark, ["Tune"]), Options(sample_positions=("second",))).first()
    assert (r.score, r.n_sampled, r.hard_flags, r.sampled_paths, r.notes) == (0.0, 0, 0, [], ["no tracks"])
    kind = suggest.classes(normalize.candidates(album(spark, ["Good Tune"]), Options(sample_positions=())), Options(sample_positions=())).first()
    assert kind.score == 0.0


def test_batches_have_the_header_of_their_album(spark):
    x = album(spark, ["A1", None, "A3"], album_artists={0: "Zed"})
    got = modelio.model_batches(albums.positioned(x), albums.headers(x), Options(max_tracks_per_call=2)).orderBy("chunk").collect()
    one = json.loads(got[0].payload)
    assert [r.n for r in got] == [2, 1] and (one["album_name"], one["album_artist"], one["album_folder"]) == ("a", "Zed", "/lib/a")
    assert one["album_id"] == hashlib.sha1(b"a").hexdigest()[:12]
    assert one["tracks"][1] == {"path": "/lib/a/001.flac", "filename": "001.flac", "track_number": 1, "disc_number": None, "current_title": None, "current_artist": "Some Name"}


def test_selected_albums(spark):
    x = album(spark, ["A"] * 2).unionByName(album(spark, ["B"], root="/lib/b"))
    wanted = spark.createDataFrame([(hashlib.sha1(b"b").hexdigest()[:12],), ("none",)], "album_id string")
    assert [r.title for r in albums.selected_albums(x, wanted).collect()] == ["B"]
    assert albums.selected_albums(x, wanted.filter("false")).count() == 0


def test_majority_ties_go_to_the_first(spark):
    x = album(spark, ["T1", "T2", "T3", "T4"], album_artists={0: "B", 1: "A", 2: "A", 3: "B"})
    assert albums.majority(x, "album_artist").first().album_artist == "B"


def test_fingerprint_ignores_order_and_partitions(spark):
    x = album(spark, [f"T{i}" for i in range(300)])
    a, b = albums.fingerprints(x).first(), albums.fingerprints(x.repartition(7)).first()
    assert a == b
    c = albums.fingerprints(x.withColumn("size_bytes", F.when(F.col("track_number") == 5, 11).otherwise(F.col("size_bytes")))).first()
    assert c.fingerprint != a.fingerprint
    before = spark.createDataFrame([("/lib/a", a.fingerprint)], "root string, fingerprint string")
    assert albums.changed_albums(albums.fingerprints(x), before).first().status == "unchanged"


def cleaned(spark, *a, **k):
    return {r.pos: r for r in normalize.candidates(album(spark, *a, **k)).collect()}


def test_normaliser(spark):
    got = cleaned(spark, ["Zed - First Tune", "Zed - Second Tune", "Zed - Third - Tune"], [None] * 3)
    assert (got[0].proposed_title, got[0].proposed_artist, got[0].confidence) == ("First Tune", "Zed", 0.75)
    got = cleaned(spark, ["Other - Tune", "Good Tune", "Good Song"], [None, "N1", "N2"])
    assert got[0].proposed_artist is None and "missing_artist_but_present_in_title" in got[0].remaining_flags
    got = cleaned(spark, [None, "Track 02", "i (170BPM)"], [None, None, "N"], files={0: "01. Zed - Tune One.wav", 1: "02. Zed - Tune Two.wav"})
    assert (got[0].proposed_title, got[0].proposed_artist) == ("Tune One", "Zed") and got[1].proposed_title == "Tune Two" and got[2].proposed_title == "i"
    got = cleaned(spark, ["Track 01"], ["N"])
    assert got[0].confidence == 0.3 and got[0].proposed_title is None


def test_half_the_rows_in_one_album(spark):
    x = album(spark, ["good tune"] * 2000).unionByName(album(spark, ["Good Tune"] * 3, root="/lib/b"))
    got = suggest.suggestions(normalize.candidates(x)).groupBy("root", "class").count().collect()
    assert sorted(map(tuple, got)) == [("/lib/a", "deterministic", 2000), ("/lib/b", "clean", 3)]


def suggestion(spark, **k):
    base = dict(root="/r", path="/r/1", pos=0, ext=".flac", current_title="Old Tune", current_artist="Old Name", proposed_title="New Tune", proposed_artist="Old Name", action="propose_fix", issue_flags=[], remaining_flags=[], confidence=0.9, source="deterministic")
    base.update({"class": "mixed"} | k)
    kinds = "root string, path string, pos int, ext string, current_title string, current_artist string, proposed_title string, proposed_artist string, action string, issue_flags array<string>, remaining_flags array<string>, confidence double, source string, class string"
    return spark.createDataFrame([tuple(base.values())], kinds)


def test_validator(spark):
    one = lambda **k: suggest.validated(suggestion(spark, **k)).first()
    assert one(proposed_title="Old Tune").action == "keep"
    r = one(proposed_title="  ")
    assert (r.proposed_title, r.action, r.confidence, r.downgraded_from) == ("Old Tune", "unreadable_needs_manual_review", 0.3, "propose_fix")
    r = one(proposed_title="Old Name", proposed_artist="Old Tune")
    assert r.action == "unreadable_needs_manual_review" and "suspicious_swap_artist_title" in r.issue_flags
    assert one(proposed_title="Whole Else", proposed_artist="Any Body").action == "unreadable_needs_manual_review"
    r = one(confidence=0.5)
    assert r.action == "propose_fix" and r.validator_notes == ["low confidence"]
    assert one(proposed_title="Track 03").action == "unreadable_needs_manual_review"
    r = one(issue_flags=["generic_track_name"], remaining_flags=["generic_track_name"])
    assert r.action == "propose_fix" and r.issue_flags == [] and r.remaining_flags == []
    r = one(source="llm", current_title="iii", proposed_title="i")
    assert r.proposed_title == "iii" and r.action == "keep"


def test_decisions(spark):
    rows = [suggestion(spark, path=f"/r/{i}", pos=i, confidence=c, source=s, ext=e) for i, (c, s, e) in enumerate([(0.96, "deterministic", ".flac"), (0.9, "deterministic", ".flac"), (0.97, "llm", ".flac"), (0.99, "deterministic", ".wav"), (0.99, "deterministic", ".mp3")])]
    s = rows[0]
    for r in rows[1:]:
        s = s.unionByName(r)
    kinds = "root string, path string, action string, final_title string, final_artist string, note string, ord long"
    none = spark.createDataFrame([], kinds)
    assert [r.path for r in decisions.auto_approve(s, none).orderBy("path").collect()] == ["/r/0", "/r/3", "/r/4"]
    assert decisions.auto_approve(s, none, allow_model=True).count() == 4
    d = spark.createDataFrame([("/r", "/r/0", "skip", None, None, None, 1), ("/r", "/r/1", "approve", None, None, None, 2), ("/r", "/r/3", "approve", None, None, None, 3), ("/r", "/r/4", "edit", "", None, None, 4), ("/r", "/r/9", "approve", None, None, None, 5), ("/r", "/r/0", "edit", "Old Tune", None, None, 6)], kinds)
    assert [r.path for r in decisions.auto_approve(s, d).collect()] == []
    assert decisions.review_queue(s.withColumn("action", F.lit("keep")), none, show_all=True).count() == 5
    assert decisions.review_queue(s, d).count() == 1 and decisions.latest(d).filter("path = '/r/0'").first().action == "edit"
    audit = {(r.path, r.ord): (r.success, r.note, r.applied_title) for r in decisions.apply_audit(s, d, dry_run=False).collect()}
    assert audit == {("/r/0", 1): (True, "skipped by reviewer", None), ("/r/1", 2): (True, None, "New Tune"), ("/r/3", 3): (False, "unsupported format", "New Tune"), ("/r/4", 4): (False, "refusing to write empty title", ""), ("/r/0", 6): (True, "no change needed after edit", None)}
    assert decisions.apply_audit(s, d, dry_run=True).filter("path = '/r/3'").first().success
    report = decisions.library_report(s, d).first()
    assert (report.approved, report.skipped, report.edited, report.pending_review) == (3, 1, 2, 1)
    flagged = s.withColumn("issue_flags", F.when(F.col("pos") < 2, F.array(F.lit("scene_junk"), F.lit("bpm_suffix"))).otherwise(F.array(F.lit("bpm_suffix"))))
    assert [tuple(i) for i in decisions.library_report(flagged, d).first().top_issues] == [("bpm_suffix", 5), ("scene_junk", 2)]


def test_response_checks(spark):
    entry = '{"track_path": "/p", "action": "keep", "confidence": %s, "issue_flags": [], "proposed_title": %s}'
    raws = ["nope", "[1]", '{"tracks": 5}', '{"tracks": [3]}', '{"tracks": [%s]}' % (entry % ("0.5", "null")), '{"tracks": [%s]}' % (entry % ('"0.5"', '"T"')), '{"tracks": [%s]}' % (entry % ("1.5", "null")), '{"tracks": [%s]}' % (entry % ("0.5", "7")), '{"tracks": [%s]}' % (entry % ("0.5", "null")).replace("keep", "drop"), '{"tracks": []}']
    df = spark.createDataFrame([("/r", i, r) for i, r in enumerate(raws)], "root string, chunk int, raw string")
    got = [r.reason for r in modelio.check_responses(df).orderBy("chunk").collect()]
    assert got == ["not JSON", "not an object", "tracks is not a list", "entry is not an object", None, None, "bad confidence", "proposal is not a string", "unknown action", None]
