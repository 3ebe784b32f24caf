"""What the rules cost: they are compiled, bind what they name often, and store what is read."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from trackclean.functions import text as X
from trackclean.functions.flags import detect_issues
from trackclean.operators import albums, suggest, tags
from trackclean.sources import tables
from trackclean.stored import shared_folder, store

from .test_albums import album


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flags_are_not_found_by_an_interpreted_function(spark):
    x = album(spark, ["a", None])
    assert "lambda" not in plan(x.select(detect_issues(F.col("title"), F.col("artist"))))
    assert "lambda" not in plan(albums.support(x).select("filename_hints"))


def test_methods_of_stages_are_small_enough_to_be_compiled(spark):
    tables.tracks(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(tables.METHOD_LIMIT)) <= 8000


def test_trimming_where_an_end_is_plain_and_where_not(spark):
    blanks = [" ", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　"]
    cases = [a + m + z for a in ["", *blanks] for m in ["", "!", "~", "a b", "é", "\x7f", "\x00"] for z in ["", *blanks]]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    s = F.col("s")
    got = df.select("s", X.ustrip(s), X.lstrip(s), X.rstrip(s), X.blank(s), X.squeeze(s)).collect()
    assert [tuple(r)[1:] for r in got] == [(c.strip(), c.lstrip(), c.rstrip(), not c.strip(), " ".join(c.split())) for c in cases]


def test_positions_are_deleted_when_candidates_are_stored(spark):
    where = Path(shared_folder(spark).removeprefix("file:"))
    before = set(where.glob("table-*"))
    s = suggest.of_tracks(album(spark, ["good tune"] * 3))
    assert len(set(where.glob("table-*")) - before) == 1
    assert "mtime_us" not in s.columns and s.count() == 3


def test_shuffle_files_go_when_a_table_is_stored(spark):
    where = Path(spark.conf.get("spark.local.dir"))
    files = lambda: {f for f in where.rglob("shuffle_*.data")}
    before = files()
    store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def test_both_names_of_an_album_take_one_pass(spark):
    assert plan(albums.headers(album(spark, ["a", "b"]))).count("Window") == 1


def test_tags_are_looked_up_without_a_filter_each(spark):
    x = spark.createDataFrame([("/p", {"TITLE": ["A"], "title": [" B "], "Artist": [" "], "artist": [], "date": ["2021-05-03"]}), ("/q", None)], "path string, raw_tags map<string,array<string>>")
    got = tags.flatten_tags(x)
    assert [(r.title, r.artist, r.year) for r in got.orderBy("path").collect()] == [("B", None, 2021), (None, None, None)]
    assert plan(got).count("lambda key") <= 2 and plan(got.select("title", "artist")).lower().count("filter(") <= 1
