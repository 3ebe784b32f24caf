"""Row-only cleaning on a stream of tracks: flags and text rules need no other row, so they run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.flags import detect_issues
from ..options import DEFAULT, Options


def cleaned_stream(tracks: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """tracks (title, artist, and any other columns; streaming or not) with flags and clean_title.

    Stateless: no watermark is needed, and the output mode is append. What needs the whole album is a batch job.
    """
    x = tracks.withColumn("flags", detect_issues(F.col("title"), F.col("artist"), o))
    x = x.withColumn("clean_title", X.strip_track_number(X.text(F.col("title"))))
    for rule in (lambda c: X.normalize_separators(c, o)["value"], lambda c: X.strip_junk_prefix(c, o), lambda c: X.strip_junk_suffix(c, o), X.strip_tempo, X.strip_original_mix, X.squeeze):
        x = x.withColumn("clean_title", rule(F.col("clean_title")))
    t = F.col("clean_title")
    return x.withColumn("clean_title", F.when(X.needs_title_case(t), X.smart_title_case(t)).otherwise(t))
