"""Album facts: positions, samples, probe scores, majority values, common prefixes, fingerprints.

An album is the folder (root) of its tracks. Places in an album are ranks, which a folder of any size gets in parts (see
ranks); all other facts are aggregates that Spark adds up before it shuffles, and joined to the tracks, where a folder of a
great share of them is split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.flags import detect_issues
from ..options import DEFAULT, HARD, PREFIX_SEPARATORS, SOFT, Options
from ..stored import store
from .ranks import LARGE, ranked


def _order() -> list[Column]:
    return [F.coalesce("disc_number", F.lit(0)), F.coalesce("track_number", F.lit(0)), F.lower("filename"), F.col("filename")]


def positioned(tracks: DataFrame, large: int = LARGE) -> DataFrame:
    """pos (from 0, in track order) and n (tracks of the album)."""
    return ranked(tracks, "root", _order(), large)


def in_sample(o: Options = DEFAULT) -> Column:
    """Tracks at the option's positions: first, second, middle and last track of the album. Unknown names pick none."""
    last = F.col("n") - 1
    places = {"first": F.lit(0), "second": F.lit(1), "middle": F.floor(last / 2), "last": last}
    return reduce(lambda a, b: a | b, [F.col("pos") == places[p] for p in o.sample_positions if p in places], F.lit(False))


def album_sample(tracks: DataFrame, o: Options = DEFAULT) -> DataFrame:
    return positioned(tracks).filter(in_sample(o))


def probe_scores(tracks: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """root, n_sampled, hard_flags, soft_flags, empty_titles, score, sampled_paths and notes (both in track order) of each
    album's sample. An album whose sample is empty has score 0 and the note "no tracks"."""
    hit, empty = F.col("sampled"), X.blank(F.col("title"))
    x = positioned(tracks).withColumn("sampled", in_sample(o)).withColumn("flags", F.when(hit, detect_issues(F.col("title"), F.col("artist"), o)))
    count = lambda names: F.coalesce(F.sum(F.size(F.array_intersect("flags", F.array(*map(F.lit, names))))), F.lit(0))
    in_order = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", value.alias("v"))))), lambda s: s["v"])
    x = x.groupBy("root").agg(
        F.count_if(hit).alias("n_sampled"), count(HARD).alias("hard_flags"), count(SOFT).alias("soft_flags"), F.count_if(hit & empty).alias("empty_titles"),
        in_order(hit, F.col("path")).alias("sampled_paths"), in_order(hit & empty, F.concat("filename", F.lit(": empty title"))).alias("notes"))
    cost = F.try_divide(F.col("hard_flags") * 0.4 + F.col("soft_flags") * 0.1, F.col("n_sampled"))
    x = x.withColumn("notes", F.when(F.col("n_sampled") == 0, F.array(F.lit("no tracks"))).otherwise(F.col("notes")))
    return x.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - cost), 3))


def majority(tracks: DataFrame, column: str, trimmed: bool = False) -> DataFrame:
    """root and the album's most frequent value that is not empty; ties: the first in track order."""
    return _majority(positioned(tracks), column, trimmed)


def _majority(x: DataFrame, column: str, trimmed: bool = False) -> DataFrame:
    """majority of tracks with pos."""
    value = X.ustrip(F.col(column)) if trimmed else F.col(column)
    x = x.withColumn("value", value).filter("value is not null and value <> ''")
    x = x.groupBy("root", "value").agg(F.count("*").alias("k"), F.min("pos").alias("first"))
    return x.groupBy("root").agg(F.max_by("value", F.struct("k", -F.col("first"))).alias(column))


def _cuts(sep: str) -> Column:
    """All starts of t that end in sep."""
    parts = F.split("t", f"\\Q{sep}\\E")
    ends = F.sequence(F.lit(1), F.size(parts) - 1)
    cuts = F.transform(ends, lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), sep), F.lit(sep)))
    return F.when(F.contains("t", F.lit(sep)), cuts).otherwise(F.array().cast("array<string>"))


def common_prefix(tracks: DataFrame) -> DataFrame:
    """root, album_prefix, support: the longest prefix up to a separator that three in five titles have, in any case.

    Each title gives all its cuts, so that counting cuts counts the titles that start with them: no title is held
    against another. Ties: more titles, then the earlier track.
    """
    return _common_prefix(positioned(tracks))


def _common_prefix(x: DataFrame) -> DataFrame:
    """common_prefix of tracks with pos."""
    x = x.select("root", "pos", X.ustrip(X.strip_track_number(X.text(F.col("title")))).alias("t")).filter("t <> ''")
    titles = x.groupBy(F.col("root").alias("of")).agg(F.count("*").alias("titles")).filter("titles >= 3")
    x = x.withColumn("prefix", F.explode(F.concat(*map(_cuts, PREFIX_SEPARATORS)))).filter(F.length("prefix") >= 4)
    x = x.groupBy("root", F.lower("prefix").alias("low")).agg(F.count("*").alias("support"), F.min(F.struct("pos", "prefix")).alias("one"))
    x = x.join(titles, F.col("root").eqNullSafe(F.col("of")))
    x = x.filter(F.col("support") >= F.greatest(F.lit(2), F.floor(F.col("titles") * 0.6)))
    best = F.max_by(F.struct(F.col("one.prefix").alias("album_prefix"), "support"), F.struct(F.length("one.prefix"), "support", -F.col("one.pos"))).alias("best")
    return x.groupBy("root").agg(best).select("root", "best.album_prefix", "best.support")


def split_hint() -> Column:
    """One " - " with two characters on both sides, and an artist that is empty or the title."""
    t, a = X.ustrip(X.text(F.col("title"))), X.ustrip(X.text(F.col("artist")))
    left, right = X.ustrip(F.substring_index(t, " - ", 1)), X.ustrip(F.substring_index(t, " - ", -1))
    return (F.size(F.split(t, " - ")) == 2) & (F.length(left) >= 2) & (F.length(right) >= 2) & ((a == "") | (F.lower(a) == F.lower(t)))


def with_album_facts(tracks: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """Tracks with pos, n, split_hints, filename_hints, allow_split, album_prefix, majority_artist, prefix_artist.

    Tracks with their positions are stored, as the facts and the tracks that they are joined to are read from them.
    """
    x = store(positioned(tracks))
    facts = _support(x, o)
    for more in (_majority(x, "album_artist", trimmed=True).withColumnRenamed("album_artist", "majority_artist"), _common_prefix(x).drop("support")):
        facts = joined_facts(facts, more)
    return joined_facts(x, facts).withColumn("prefix_artist", X.leftmost_segment(F.col("album_prefix")))


def joined_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows (with root) and facts of their albums, one row for each root, null too."""
    return rows.join(facts.withColumnRenamed("root", "__root"), F.col("root").eqNullSafe(F.col("__root")), "left").drop("__root")


def support(tracks: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """root, split_hints, filename_hints, allow_split."""
    return _support(positioned(tracks), o)


def _support(x: DataFrame, o: Options) -> DataFrame:
    x = x.select("root", (in_sample(o) & split_hint()).alias("split"), X.clean_name(F.col("filename")).alias("name"))
    x = x.groupBy("root").agg(
        F.count_if("split").alias("split_hints"),
        F.count_if(X.parse_name(F.col("name"), F.lit(False)).isNotNull()).alias("filename_hints"))
    return x.withColumn("allow_split", (F.col("split_hints") >= 2) | (F.col("filename_hints") >= 2))


def fingerprints(tracks: DataFrame) -> DataFrame:
    """root and a SHA-1 of the album's (path, mtime, size) lines by path; equal for equal albums, whatever the order.

    The lines of one album are hashed in 64 parts by path, so that the tracks of a giant folder are never one value.
    """
    line = F.concat_ws("\0", "path", F.coalesce("mtime_us", F.lit(0)).cast("string"), F.coalesce("size_bytes", F.lit(0)).cast("string"))
    x = tracks.select("root", line.alias("line"), F.substring(F.md5("path"), 1, 2).alias("part"))
    x = x.groupBy("root", "part").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("h"))
    return x.groupBy("root").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit(":"), "h"))), "\n")).alias("fingerprint"))


def changed_albums(now: DataFrame, before: DataFrame) -> DataFrame:
    """now's rows (root, fingerprint and others) with status: new, changed or unchanged against an earlier scan."""
    old = before.select("root", F.col("fingerprint").alias("old"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("fingerprint"), "unchanged").otherwise("changed")
    return now.join(old, "root", "left").withColumn("status", status).drop("old")


def scan_counters(changed: DataFrame) -> DataFrame:
    """One row of changed_albums: albums, those to write, those that are as they were."""
    same = F.col("status") == "unchanged"
    return changed.agg(F.count("*").alias("albums"), F.count_if(~same).alias("written"), F.count_if(same).alias("unchanged"))


#: The library's folder where none is named.
LIBRARY = "/lib/"


def album_id(root: Column, base: str = LIBRARY) -> Column:
    """Twelve hex digits of the SHA-1 of the folder's path below base; of the whole path where it is not below."""
    base = base if base.endswith("/") else f"{base}/"
    relative = F.when(F.startswith(root, F.lit(base)), F.substring(root, F.lit(len(base) + 1), F.length(root))).otherwise(root)
    return F.substring(F.sha1(relative), 1, 12)


def headers(tracks: DataFrame, base: str = LIBRARY) -> DataFrame:
    """One row for each album: root, album_id, album_name (else the folder's), album_artist, tracks. Both names are the
    majority's, which one pass over the tracks' positions finds."""
    names = ("album", "album_artist")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("value")) for c in names])).alias("said")
    x = positioned(tracks).select("root", "pos", each)
    x = x.groupBy("root", F.col("said.of").alias("of"), F.col("said.value").alias("value")).agg(F.count("*").alias("k"), F.min("pos").alias("first"))
    counts = F.col("root").isNotNull() & (F.col("value") != "")
    most = lambda c: F.max_by("value", F.when(counts & (F.col("of") == c), F.struct("k", -F.col("first")))).alias(c)
    x = x.groupBy("root").agg(*map(most, names), F.sum(F.when(F.col("of") == names[0], F.col("k"))).alias("tracks"))
    name = F.coalesce("album", F.element_at(F.split("root", "/"), -1))
    return x.select("root", album_id(F.col("root"), base).alias("album_id"), name.alias("album_name"), "album_artist", "tracks")


def albums(tracks: DataFrame, base: str = LIBRARY) -> DataFrame:
    """headers with the albums' fingerprints."""
    return headers(tracks, base).join(fingerprints(tracks), "root")


def selected_albums(rows: DataFrame, wanted: DataFrame, base: str = LIBRARY, digits: int = 0) -> DataFrame:
    """Rows (with root) of the albums whose album_id is in wanted; ids of no album pick nothing.

    digits: of the ids that make the column bucket, where rows are partitioned by it; only wanted buckets are read then.
    """
    x = rows.withColumn("__id", album_id(F.col("root"), base))
    ids = wanted.filter(F.length("album_id") == 12).select(F.col("album_id").alias("__id"))
    keys = ["__id"]
    if digits:
        ids = ids.withColumn("bucket", F.substring("__id", 1, digits))
        keys = ["bucket", "__id"]
    return x.join(ids, keys, "left_semi").drop("__id").select(*rows.columns)
