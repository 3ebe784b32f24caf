"""Ranks of groups of any size: the same as by one window, and no part of a large folder is much larger than the others."""

from statistics import median

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackclean.operators import albums, ranks
from trackclean.operators.normalize import candidates
from trackclean.operators.suggest import suggestions, validated


def library(spark, n):
    """A folder of nine in ten tracks, most of them without a number, and small ones."""
    x = spark.range(n).withColumn("h", F.abs(F.xxhash64("id")))
    root = F.when(F.col("id") % 10 < 9, "/lib/hot").otherwise(F.concat(F.lit("/lib/"), (F.col("h") % 40).cast("string")))
    return x.select(
        root.alias("root"), F.concat(root, F.lit("/"), F.col("h").cast("string"), F.lit(".mp3")).alias("path"), F.concat(F.col("h").cast("string"), F.lit(".mp3")).alias("filename"),
        F.lit(".mp3").alias("ext"), F.when(F.col("h") % 3 == 0, F.col("h") % 7).cast("int").alias("track_number"), F.when(F.col("h") % 11 == 0, 2).alias("disc_number"),
        F.concat(F.lit("va - some tune "), F.col("id").cast("string")).alias("title"), F.lit("Someone").alias("artist"), F.lit("Album").alias("album"), F.lit("Someone").alias("album_artist"))


def test_positions_are_those_of_one_window(spark):
    t = library(spark, 4000).unionByName(library(spark, 5).withColumn("root", F.lit(None).cast("string")))
    w = W.partitionBy("root")
    want = t.withColumn("pos", F.row_number().over(w.orderBy(*albums._order())) - 1).withColumn("n", F.count("*").over(w))
    key = lambda x: sorted((str(r.root), r.path, r.pos, r.n) for r in x.collect())
    expected = key(want)
    for large in (100, 1000, 10_000):
        got = albums.positioned(t, large)
        assert got.schema["pos"].dataType == want.schema["pos"].dataType and sorted(got.columns) == sorted(want.columns)
        assert key(got) == expected


def test_parts_of_a_large_folder_are_even(spark):
    t = library(spark, 30_000)
    sizes = ranks.large_groups(t, "root", 1500)
    assert [r.of for r in sizes.collect()] == ["/lib/hot"]
    parts = ranks.with_parts(t, sizes, "root", albums._order(), 1500).groupBy("root", "part").count().collect()
    hot = [r["count"] for r in parts if r.root == "/lib/hot"]
    assert sum(hot) == 27_000 and len(hot) >= 15 and max(hot) <= 2 * median(hot)
    assert {r.part for r in parts if r.root != "/lib/hot"} == {0}


def test_equal_rows_and_empty_tables(spark):
    t = library(spark, 20).withColumn("filename", F.lit("same.mp3")).withColumn("track_number", F.lit(1)).withColumn("disc_number", F.lit(1))
    got = albums.positioned(t, 3).groupBy("root").agg(F.sort_array(F.collect_list("pos")).alias("p"), F.max("n").alias("n")).collect()
    assert all(r.p == list(range(r.n)) for r in got)
    assert albums.positioned(t.filter("false")).collect() == []


def test_no_window_by_folder_behind_the_ranks(spark):
    t = library(spark, 200)
    plan = validated(suggestions(candidates(t)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan
    assert validated(suggestions(candidates(t))).count() == 200
