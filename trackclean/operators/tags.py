"""Raw tag records flattened into typed columns, and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import int_ish, ustrip

EXTENSIONS = (".flac", ".mp3", ".m4a", ".ogg", ".opus", ".wav")


def flatten_tags(records: DataFrame) -> DataFrame:
    """raw_tags (map of arrays) -> title, artist, album, album_artist, track_number, disc_number, year.

    Keys count in lower case (the last of equal ones wins), the first value of each, trimmed; blank ones are absent.
    """
    entries = F.transform(F.map_entries("raw_tags"), lambda e: F.struct(F.lower(e["key"]).alias("key"), ustrip(F.get(e["value"], F.lit(0))).alias("value")))
    entries = F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    x = records.withColumn("tags", F.reverse(entries))
    last = lambda k: F.get("tags.value", F.array_position("tags.key", F.lit(k)).cast("int") - 1)
    return x.select(
        *[c for c in records.columns if c != "raw_tags"], last("title").alias("title"), last("artist").alias("artist"), last("album").alias("album"),
        F.coalesce(last("albumartist"), last("album_artist")).alias("album_artist"), int_ish(last("tracknumber")).alias("track_number"),
        int_ish(last("discnumber")).alias("disc_number"), int_ish(F.coalesce(last("date"), last("year"))).alias("year"))


def listed_files(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """A listing's files (path, size_bytes, mtime_us) that have a known extension and no leading dot, with their parts."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    x = files.withColumn("filename", name).withColumn("ext", F.lower(F.regexp_extract("filename", r"(?<=.)(\.[^.]*)$", 1)))
    return x.filter(~F.startswith("filename", F.lit(".")) & F.col("ext").isin(*extensions)).withColumn("root", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
