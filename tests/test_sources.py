"""The folder source, bucketed tables, the stream of decisions, whole documents or none."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.test_albums import suggestion

from trackclean.operators import decisions
from trackclean.sources import bucketed, files, folders
from trackclean.streaming.decisions import follow_decisions, followed


def test_listing_equals_a_walk(spark, tmp_path):
    for name in ("a/01.flac", "a/_x.MP3", "a/cover.jpg", "a/.hidden.flac", ".dot/deep/er/y.wav", "b/c/x.ogg", "top.opus", "b/no ending", "b/.flac"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name.startswith("a/_") else b"abc")
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "a/01.flac", tmp_path / "b/linked.flac")
    os.symlink(tmp_path / "nowhere", tmp_path / "b/broken.flac")
    walked = {os.path.join(d, f): os.stat(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names if os.path.isfile(os.path.join(d, f))}
    want = {p: (s.st_size, s.st_mtime_ns // 1000) for p, s in walked.items()}
    spark.dataSource.register(folders.FolderSource)
    for parts in (1, 3, 64):
        got = spark.read.format("folder").option("parts", parts).load(str(tmp_path)).collect()
        assert len(got) == len(want) and {r.path: (r.size_bytes, r.mtime_us) for r in got} == want
    music = {p for p in want if not os.path.basename(p).startswith(".") and os.path.splitext(p)[1].lower() in files.EXTENSIONS}
    assert {r.path for r in files.listing(spark, str(tmp_path)).collect()} == music and len(music) == 6
    assert spark.read.format("folder").load(str(tmp_path / "none")).collect() == []


def test_bucketed_tables_join_without_a_shuffle(spark):
    s = suggestion(spark).withColumn("reason", F.lit("r")).withColumn("ext", F.lit(".mp3"))
    s = s.unionByName(s.withColumn("path", F.lit("/r/2")))
    d = spark.createDataFrame([("/r", "/r/1", "approve", None, None, None, 1), ("/r", "/r/9", "skip", None, None, None, 2)], "root string, path string, action string, final_title string, final_artist string, note string, ord long")
    d = d.withColumn("root", F.lit(s.first().root))
    a, b = bucketed.save(s, "test_suggestions", 4), bucketed.save(d, "test_decisions", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for made, plain in ((decisions.apply_audit(a, b), decisions.apply_audit(s, d)), (decisions.undecided(a, b), decisions.undecided(s, d))):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan
            assert sorted(map(str, made.select(sorted(made.columns)).collect())) == sorted(map(str, plain.select(sorted(made.columns)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE test_suggestions")
        spark.sql("DROP TABLE test_decisions")


def test_replayed_and_late_batches_leave_the_last_decisions(spark, tmp_path):
    schema = "root string, path string, action string, ord long"
    batches = [[("/a", "1", "skip", 5), ("/a", "2", "edit", 1)], [("/a", "1", "approve", 3), ("/a", "2", "skip", 2), ("/b", "1", "skip", 1)], [("/a", "1", "skip", 5), ("/b", "1", "edit", 9)]]
    where = lambda name: str(tmp_path / name)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where("log"))
        stream = spark.readStream.schema(schema).parquet(where("log"))
        if k == 1:  # the job dies behind the write: its batch comes again
            os.makedirs(where("last/batch=1"))
            spark.createDataFrame([("/a", "1", "nonsense", 99)], schema).write.mode("overwrite").parquet(where("last/batch=1"))
        follow_decisions(stream, where("last"), where("checkpoint")).awaitTermination()
    want = decisions.latest(spark.createDataFrame([r for b in batches for r in b], schema))
    assert sorted(map(tuple, followed(spark, where("last")).select("root", "path", "action", "ord").collect())) == sorted(map(tuple, want.select("root", "path", "action", "ord").collect()))


def good(**more):
    one = {"pos": 0, "track_path": "/r/1", "action": "keep", "confidence": 0.5, "source": "none", "issue_flags": ["scene_junk"], "proposed_title": None}
    return {"root": "/r", "part": 0, "parts": 1, "class": "mixed", "score": 0.5, "suggestions": [one | more]}


@pytest.mark.parametrize(("doc", "reason"), [
    ("{", "not JSON"), ("[1]", "not an object"), ({**good(), "root": 7}, "root is not a text"), ({**good(), "class": "odd"}, "unknown class"),
    ({**good(), "score": "high"}, "score is not a number"), ({**good(), "suggestions": {}}, "suggestions is not a list"), ({**good(), "part": None}, "part is not a number"),
    (good(action="nonsense"), "unknown action"), (good(action=None), "unknown action"), (good(current_title=7), "current_title is not a text"),
    (good(track_path=None), "track_path is not a text"), (good(issue_flags=["unheard_of"]), "issue_flags is not a list of flags"), (good(issue_flags="x"), "issue_flags is not a list of flags"),
    (good(validator_notes=[1]), "validator_notes is not a list of texts"), (good(confidence="much"), "confidence is not a number"), (good(source="guess"), "unknown source"),
    (good(downgraded_from="odd"), "unknown downgraded_from"), ({**good(), "suggestions": [5]}, "suggestion is not an object"),
    (good(confidence="0.5"), None), (good(validator_notes=[], downgraded_from="keep"), None), ({**good(), "suggestions": []}, None),
])
def test_the_first_thing_that_is_wrong_with_a_document(spark, doc, reason):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    assert files.checked_documents(spark.createDataFrame([(text,)], "doc string")).first().reason == reason


def test_an_album_is_loaded_whole_or_kept_aside(spark):
    doc = lambda root, part, parts, **more: json.dumps({**good(track_path=f"{root}/{part}", **more), "root": root, "part": part, "parts": parts})
    rows = [doc("/ok", 0, 2), doc("/ok", 1, 2), doc("/bad", 0, 2), doc("/bad", 1, 2, action="nonsense"), doc("/gap", 0, 3), doc("/gap", 2, 3), doc("/twice", 0, 1), doc("/twice", 0, 1), "rubbish"]
    docs = spark.createDataFrame([(r,) for r in rows], "doc string")
    assert sorted(r.path for r in files.parse_documents(docs).collect()) == ["/ok/0", "/ok/1", "/twice/0"]
    got = sorted((str(r.root), str(r.part), r.reason) for r in files.rejected_documents(docs).collect())
    assert got == [("/bad", "0", "part 1: unknown action"), ("/bad", "1", "part 1: unknown action"), ("/gap", "0", "parts are missing"), ("/gap", "2", "parts are missing"), ("None", "None", "not JSON")]


def test_the_audit_of_a_run_replaces_the_dry_one(spark, tmp_path):
    s = suggestion(spark).withColumn("reason", F.lit("r")).withColumn("ext", F.lit(".mp3"))
    d = spark.createDataFrame([(s.first().root, s.first().path, "approve", None, None, None, 1)], "root string, path string, action string, final_title string, final_artist string, note string, ord long")
    for dry in (True, False):
        files.write_audit(decisions.apply_audit(s, d, dry_run=dry), str(tmp_path / "audit"))
        got = spark.read.parquet(str(tmp_path / "audit")).collect()
        assert [r.dry_run for r in got] == [dry]
