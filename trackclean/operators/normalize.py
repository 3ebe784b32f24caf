"""The track normaliser: one row in, a candidate out, as a chain of column stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.flags import detect_issues, has_any, is_generic, those
from ..options import BLOCKING, DEFAULT, Options
from .albums import with_album_facts


def _step(x: DataFrame, value: Column, note: Column) -> DataFrame:
    """Set t to value and add the note where t changes."""
    x = x.withColumn("__new", value)
    return x.withColumn("notes", F.when(F.col("__new") != F.col("t"), F.array_append("notes", note)).otherwise(F.col("notes"))).withColumn("t", F.col("__new")).drop("__new")


def normalize(x: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """Tracks with album facts -> the same with proposed_title, proposed_artist, notes, original_flags, remaining_flags,
    confidence. Each stage binds its input once, so that the plan grows with the number of rules only."""
    t, a = F.col("t"), F.col("a")
    x = x.withColumn("t", X.text(F.col("title"))).withColumn("a", X.text(F.col("artist"))).withColumn("notes", F.array().cast("array<string>"))
    x = x.withColumn("original_flags", detect_issues(F.col("title"), F.col("artist"), o))
    x = x.withColumn("name", F.when(X.blank(t) | is_generic(t), X.clean_name(F.col("filename"))))
    x = x.withColumn("file", X.parse_name(F.col("name"), F.col("allow_split")))
    fill = X.blank(a) & F.col("file.artist").isNotNull()
    said = lambda what, value: F.concat(F.lit(f"{what}: "), F.col(value))
    x = x.withColumn("notes", those([(F.col("file").isNotNull(), said("title from filename", "file.title")), (fill, said("artist from filename", "file.artist"))]))
    x = x.withColumn("a", F.when(F.coalesce(fill, F.lit(False)), F.col("file.artist")).otherwise(a)).withColumn("t", F.coalesce("file.title", "t"))
    x = _step(x, X.strip_track_number(t), F.lit("stripped track number"))
    x = x.withColumn("sep", X.normalize_separators(t, o))
    x = x.withColumn("notes", F.when(F.col("sep.noted"), F.array_append("notes", F.lit("normalized separators"))).otherwise(F.col("notes"))).withColumn("t", F.col("sep.value"))
    x = x.withColumn("before", t)
    x = _step(x, X.strip_literal_prefix(t, F.col("album_prefix")), F.lit("stripped album prefix"))
    back = (F.col("before") != t) & X.blank(a) & F.col("prefix_artist").isNotNull()
    x = x.withColumn("notes", F.when(back, F.array_append("notes", said("artist from album prefix", "prefix_artist"))).otherwise(F.col("notes"))).withColumn("a", F.when(back, F.col("prefix_artist")).otherwise(a))
    x = _step(x, X.strip_artist_prefix(t, a, F.col("majority_artist")), F.lit("stripped artist prefix"))
    x = _step(x, X.strip_junk_prefix(t, o), F.lit("stripped junk prefix"))
    x = _step(x, X.strip_junk_suffix(t, o), F.lit("stripped junk suffix"))
    if o.remove_bpm_suffix:
        x = _step(x, X.strip_tempo(t), F.lit("stripped tempo"))
    if o.remove_original_mix:
        x = _step(x, X.strip_original_mix(t), F.lit("stripped original mix"))
    same = F.lower(X.ustrip(a)) == F.lower(X.ustrip(t))
    x = x.withColumn("two", F.when(F.col("allow_split") & (X.blank(a) | same), X.split_artist_title(t)))
    split = F.when(X.blank(a), said("artist from title", "two.artist")).otherwise(said("artist was the title, now", "two.artist"))
    x = x.withColumn("notes", F.when(F.col("two").isNotNull(), F.array_append("notes", split)).otherwise(F.col("notes")))
    x = x.withColumn("a", F.coalesce("two.artist", "a")).withColumn("t", F.coalesce("two.title", "t"))
    x = x.withColumn("t", X.squeeze(t)).withColumn("a", X.squeeze(a))
    x = x.withColumn("t", F.when(X.needs_title_case(t), X.smart_title_case(t)).otherwise(t)).withColumn("a", F.when(X.needs_artist_case(a), X.smart_title_case(a)).otherwise(a))
    x = x.withColumn("remaining_flags", detect_issues(t, a, o))
    old_t, old_a = X.text(F.col("title")), X.text(F.col("artist"))
    confidence = (F.when(has_any(F.col("remaining_flags"), BLOCKING), 0.3).when((t == old_t) & (a == old_a), 1.0)
                  .when(X.blank(old_a) & ~X.blank(a), 0.75).otherwise(0.9))
    x = x.withColumn("confidence", confidence)
    x = x.withColumn("proposed_title", F.when((t != "") & (t != old_t), t)).withColumn("proposed_artist", F.when((a != "") & (a != old_a), a))
    return x.drop("t", "a", "name", "file", "sep", "before", "two")


#: The columns of tracks that candidates are made of: others need not be stored with the tracks' positions.
READ = ("root", "path", "filename", "ext", "track_number", "disc_number", "title", "artist", "album_artist")


def candidates(tracks: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """A candidate for every track, by album facts and the normaliser."""
    return normalize(with_album_facts(tracks, o), o)
