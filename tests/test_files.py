import csv
import glob
import json

from pyspark.sql import functions as F

from tests.test_albums import album, suggestion

from trackclean.operators import albums, decisions, modelio, normalize
from trackclean.options import Options
from trackclean.sources import files


def test_listing_of_a_folder_with_and_without_tags(spark, tmp_path):
    for name in ("a/01.flac", "a/02.MP3", "a/cover.jpg", "a/.hidden.flac", "b/c/x.ogg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    found = files.listing(spark, str(tmp_path))
    assert sorted((r.filename, r.ext, r.size_bytes) for r in found.collect()) == [("01.flac", ".flac", 3), ("02.MP3", ".mp3", 3), ("x.ogg", ".ogg", 3)]
    assert {r.root for r in found.collect()} == {f"{tmp_path}/a", f"{tmp_path}/b/c"}
    tags = spark.createDataFrame([(f"{tmp_path}/a/01.flac", {"TITLE": [" Tune "], "TRACKNUMBER": ["3/12"]})], "path string, raw_tags map<string,array<string>>")
    got = {r.filename: (r.title, r.track_number) for r in files.with_tags(found, tags).collect()}
    assert got == {"01.flac": ("Tune", 3), "02.MP3": (None, None), "x.ogg": (None, None)}


def rows_of(folder):
    out = []
    for f in sorted(glob.glob(f"{folder}/*.csv")):
        with open(f, newline="", encoding="utf-8") as fh:
            out += list(csv.DictReader(fh))
    return out


def test_csv_exports(spark, tmp_path):
    s = suggestion(spark, current_title='Say "Hi", now', current_artist=None, issue_flags=["scene_junk", "artist_missing"]).withColumn("reason", F.lit("r"))
    s = s.unionByName(s.withColumn("path", F.lit("/r/0")).withColumn("action", F.lit("keep")).withColumn("pos", F.lit(1)))
    assert files.write_review_sheet(s, f"{tmp_path}/r") == 2 and files.write_pending(s, f"{tmp_path}/p") == 1
    review, pending = rows_of(f"{tmp_path}/r"), rows_of(f"{tmp_path}/p")
    assert [r["track_path"] for r in review] == ["/r/1", "/r/0"] and len(pending) == 1
    assert pending[0]["current_title"] == 'Say "Hi", now' and pending[0]["current_artist"] == ""
    assert pending[0]["confidence"] == "0.90" and pending[0]["issue_flags"] == "scene_junk;artist_missing"
    assert files.write_pending(s.filter("false"), f"{tmp_path}/e") == 0


def test_documents_hold_a_bounded_part_of_an_album_and_survive_bad_ones(spark, tmp_path):
    s = suggestion(spark).withColumn("reason", F.lit(None).cast("string")).withColumn("score", F.lit(0.5)).withColumn("class_reason", F.lit("x"))
    s = s.crossJoin(spark.range(25).select(F.col("id").cast("int").alias("k"))).withColumn("pos", F.col("k")).withColumn("path", F.concat(F.lit("/r/"), "k"))
    docs = files.documents(s, 10)
    assert sorted(len(json.loads(r.doc)["suggestions"]) for r in docs.collect()) == [5, 10, 10]
    files.write_documents(docs.select("doc").unionByName(spark.createDataFrame([("{broken",), ("",), ("[]",), ('{"root": "/q"}',)], "doc string")), f"{tmp_path}/d")
    back = files.read_documents(spark, f"{tmp_path}/d")
    assert back.count() == 25 and {r.root for r in back.collect()} == {"/r"}
    lists = [("/a", '[{"track_path": "/a/1", "action": "skip"}, 5, {"action": "skip"}, {"track_path": "/a/2", "action": "edit", "final_title": "T"}]'), ("/b", "{}"), ("/c", "[{"), ("/d", None)]
    got = files.parse_decisions(spark.createDataFrame(lists, "root string, doc string")).orderBy("ord").collect()
    assert [(r.path, r.action, r.final_title, r.ord) for r in got] == [("/a/1", "skip", None, 0), ("/a/2", "edit", "T", 3)]


def test_decision_log_and_counters(spark):
    s = suggestion(spark, confidence=0.96)
    s = s.unionByName(s.withColumn("path", F.lit("/r/2"))).unionByName(s.withColumn("path", F.lit("/r/3")).withColumn("action", F.lit("keep")))
    d = spark.createDataFrame([("/r", "/r/2", "skip", None, None, None, 1), ("/r", "/r/2", "edit", "T", None, None, 4), ("/r", "/r/9", "skip", None, None, None, 2)], "root string, path string, action string, final_title string, final_artist string, note string, ord long")
    assert decisions.approval_counters(s, d).first() == (1, 2, 1, 1)
    assert [r.path for r in decisions.orphan_decisions(s, d).collect()] == ["/r/9"]
    log = decisions.decision_log(d, decisions.auto_approve(s, d)).orderBy("path").collect()
    assert [(r.path, r.action, r.ord) for r in log] == [("/r/1", "approve", 5), ("/r/2", "edit", 4), ("/r/9", "skip", 2)]
    assert decisions.decision_log(d.filter("false"), decisions.auto_approve(s, d.filter("false"))).count() == 2


def test_routing(spark):
    x = album(spark, ["??", "!!", "Good Tune"]).unionByName(album(spark, ["Fine Tune"] * 3, root="/lib/b"))
    o = Options(max_tracks_per_call=2)
    entry = '{"track_path": "/lib/a/%s.flac", "action": "propose_fix", "confidence": 0.8, "issue_flags": [], "proposed_title": "Good Song", "reason": "why"}'
    answers = [("/lib/a", 0, '{"tracks": [%s, %s]}' % (entry % "000", entry % "002")), ("/lib/a", 1, "nope"), ("/lib/b", 0, '{"tracks": []}')]
    r = spark.createDataFrame(answers, "root string, chunk int, raw string")
    got = {r.path: r for r in modelio.routed(normalize.candidates(x), r, o).collect()}
    assert {p for p, v in got.items() if v.used_model} == {f"/lib/a/{i:03}.flac" for i in range(3)}
    one, missed, other = (got[f"/lib/a/{i:03}.flac"] for i in range(3))
    assert (one.source, one.proposed_title, one.reason) == ("llm", "Good Song", "why")
    assert (missed.source, missed.confidence, missed.action) == ("deterministic", 0.5, "keep")
    assert other.source == "deterministic" and other.proposed_title == "Good Tune"
    cut = {v.used_model for v in modelio.routed(normalize.candidates(x), r.filter("chunk = 0"), o).collect()}
    assert cut == {False}
    forced = modelio.routed(normalize.candidates(x), r, o, force=True).filter("root = '/lib/b'").collect()
    assert {(v.source, v.used_model) for v in forced} == {("deterministic", False)}
    report = decisions.routed_report(modelio.routed(normalize.candidates(x.filter("root = '/lib/a'")), r, o), spark.createDataFrame([], "root string, path string, action string, note string"), x).first()
    assert (report.total_albums, report.skipped_unchanged) == (2, 1)
