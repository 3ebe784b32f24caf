"""Review decisions: queue, auto-approval, cascades, application with an audit, the cleaned table, the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.flags import has_any
from ..functions.text import blank, text
from ..options import AUTO_NOTE, DEFAULT, FLAGS, MANUAL, PENDING, WRITABLE, Options
from .albums import LIBRARY, album_id

#: Flags that no row may have that is approved without a reviewer.
AUTO_BLOCKING = ("generic_track_name", "unreadable_title", "suspicious_swap_artist_title")


def pending(s: DataFrame) -> DataFrame:
    return s.filter(F.col("action").isin(*PENDING))


def undecided(s: DataFrame, decisions: DataFrame, show_all: bool = False) -> DataFrame:
    """Pending suggestions (or all) without any decision."""
    return (s if show_all else pending(s)).join(decisions.select("root", "path").distinct(), ["root", "path"], "left_anti")


def latest(decisions: DataFrame) -> DataFrame:
    """One decision for each track: the last, by ord."""
    rest = [c for c in decisions.columns if c not in ("root", "path")]
    x = decisions.groupBy("root", "path").agg(F.max_by(F.struct(*rest), "ord").alias("kept_row"))
    return x.select("root", "path", "kept_row.*")


def review_queue(s: DataFrame, decisions: DataFrame, show_all: bool = False) -> DataFrame:
    """Undecided pending rows (or all undecided rows) with i of n in their album."""
    album = W.partitionBy("root")
    return undecided(s, decisions, show_all).withColumn("i", F.row_number().over(album.orderBy("pos"))).withColumn("of", F.count("*").over(album))


def safe_to_approve(least: float = 0.95, allow_model: bool = False) -> Column:
    flags = F.when(F.size("remaining_flags") > 0, F.col("remaining_flags")).otherwise(F.col("issue_flags"))
    source = F.lit(True) if allow_model else F.col("source") == "deterministic"
    return (F.col("action") == "propose_fix") & source & (F.col("confidence") >= least) & ~has_any(flags, AUTO_BLOCKING)


def auto_approve(s: DataFrame, decisions: DataFrame, least: float = 0.95, allow_model: bool = False) -> DataFrame:
    """New approvals (root, path, action, note) of undecided pending rows that the policy finds safe; what is decided stays."""
    return undecided(s, decisions).filter(safe_to_approve(least, allow_model)).select("root", "path", F.lit("approve").alias("action"), F.lit(AUTO_NOTE).alias("note"))


def decision_log(decisions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Decisions, the last of each track, with new approvals after them: columns and order numbers as in decisions.

    New approvals are of tracks without a decision, so that one order number after all others serves them all.
    """
    after = decisions.agg((F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord"))
    new = approvals.crossJoin(F.broadcast(after))
    return latest(decisions).unionByName(new, allowMissingColumns=True)


def approval_counters(s: DataFrame, decisions: DataFrame, least: float = 0.95, allow_model: bool = False) -> DataFrame:
    """One row: albums, pending tracks, those of them that have a decision, and those newly approved."""
    old = decisions.select("root", "path", F.lit(True).alias("decided")).distinct()
    x = s.withColumn("is_pending", F.col("action").isin(*PENDING)).join(old, ["root", "path"], "left")
    open_ = F.col("is_pending") & F.col("decided").isNull()
    return x.agg(
        F.countDistinct("root").alias("albums"), F.count_if("is_pending").alias("considered"),
        F.count_if(F.col("is_pending") & F.col("decided").isNotNull()).alias("already_decided"),
        F.count_if(open_ & safe_to_approve(least, allow_model)).alias("newly_approved"))


def orphan_decisions(s: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions of tracks that have no suggestion: they are not applied."""
    return decisions.join(s.select("root", "path"), ["root", "path"], "left_anti")


def cascade(s: DataFrame, decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts (root, from_pos, action): the verdict's row and all later undecided pending rows of the album take it."""
    x = undecided(s, decisions).join(verdicts.withColumnRenamed("action", "verdict"), "root").filter("pos >= from_pos")
    note = F.when(F.col("pos") == F.col("from_pos"), F.concat(F.lit("bulk "), "verdict")).otherwise(F.concat(F.lit("bulk "), "verdict", F.lit(" (cascade)")))
    return x.select("root", "path", "pos", F.col("verdict").alias("action"), note.alias("note"))


def apply_audit(s: DataFrame, decisions: DataFrame, dry_run: bool = True) -> DataFrame:
    """One row for each decision that has a suggestion: what is written, or why nothing is.

    Values that stay as they are are not written; blank values are refused, dry run or not; other formats than those that
    can be written fail when it is no dry run. What was attempted is kept where it failed. Null and empty are different.
    """
    return _audited(s, decisions, dry_run, "inner").drop("current_title", "current_artist", "suggested")


def _audited(s: DataFrame, decisions: DataFrame, dry_run: bool, how: str) -> DataFrame:
    """The audit's rows, or by a full join those of suggestions without a decision, and of decisions without a suggestion
    (suggested is false), too."""
    x = s.join(decisions.select("root", "path", "ord", F.col("action").alias("decision"), "final_title", "final_artist"), ["root", "path"], how)
    manual = F.col("action") == MANUAL

    def final(edit: str, proposed: str, current: str) -> Column:
        return F.when(F.col("decision") == "edit", F.col(edit)).when(manual, F.col(current)).otherwise(F.col(proposed))

    def write(value: str, current: str) -> Column:
        return F.when(F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col(current)), F.col(value))

    x = x.withColumn("ft", final("final_title", "proposed_title", "current_title")).withColumn("fa", final("final_artist", "proposed_artist", "current_artist"))
    x = x.withColumn("wt", write("ft", "current_title")).withColumn("wa", write("fa", "current_artist"))
    skip = F.col("decision") == "skip"
    nothing = F.col("wt").isNull() & F.col("wa").isNull()
    refused = (F.when(skip, "skipped by reviewer").when(nothing, "no change needed after edit")
               .when(F.col("wt").isNotNull() & blank(F.col("wt")), "refusing to write empty title")
               .when(F.col("wa").isNotNull() & blank(F.col("wa")), "refusing to write empty artist")
               .when(~F.lit(dry_run) & ~F.col("ext").isin(*WRITABLE), "unsupported format"))
    x = x.withColumn("note", refused)
    ok = skip | nothing | F.col("note").isNull()
    tried = ~skip
    return x.select("root", "path", "ord", "decision", F.when(tried, F.col("wt")).alias("applied_title"), F.when(tried, F.col("wa")).alias("applied_artist"),
                    F.col("current_title").alias("previous_title"), F.col("current_artist").alias("previous_artist"), ok.alias("success"), "note", F.lit(dry_run).alias("dry_run"),
                    "current_title", "current_artist", F.col("source").isNotNull().alias("suggested"))


def cleaned_tracks(tracks: DataFrame, audit: DataFrame) -> DataFrame:
    """Tracks with what was applied last; all other columns as they were."""
    done = audit.filter(F.col("success") & (F.col("applied_title").isNotNull() | F.col("applied_artist").isNotNull()))
    last = done.groupBy("root", "path").agg(F.max_by("applied_title", F.when(F.col("applied_title").isNotNull(), F.col("ord"))).alias("new_title"), F.max_by("applied_artist", F.when(F.col("applied_artist").isNotNull(), F.col("ord"))).alias("new_artist"))
    x = tracks.join(last, ["root", "path"], "left")
    return x.withColumn("title", F.coalesce("new_title", "title")).withColumn("artist", F.coalesce("new_artist", "artist")).drop("new_title", "new_artist")


def apply_counters(s: DataFrame, decisions: DataFrame, dry_run: bool = True) -> DataFrame:
    """One row: albums, those with any decision and those without, rows that went well and that failed.

    A decision counts for its album even if its track has no suggestion. Suggestions and decisions are gone through once.
    """
    x = _audited(s, decisions, dry_run, "full")
    made = F.col("decision").isNotNull()
    counted = made & F.col("suggested")
    x = x.groupBy("root").agg(F.bool_or("suggested").alias("any"), F.bool_or(made).alias("has"), F.count_if(counted & F.col("success")).alias("ok"), F.count_if(counted & ~F.col("success")).alias("failed")).filter("any")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return x.agg(F.count("*").alias("albums"), F.count_if("has").alias("albums_applied"), F.count_if(~F.col("has")).alias("albums_no_decisions"), total("ok"), total("failed"))


ROW_COUNTERS = ("total_tracks", "proposed", "unreadable", "low_confidence")
DECISION_COUNTERS = ("approved", "auto_approved", "skipped", "edited")


def suggestion_counters(s: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """root, class and the counters of each album that suggestions alone tell, its flags' numbers too."""
    low = (F.col("confidence") < o.low_confidence_flag) & (F.col("action") == "propose_fix")
    model = [F.bool_or("used_model").alias("used_model")] if "used_model" in s.columns else []
    number = lambda k: F.sum(F.size(F.filter("issue_flags", lambda f: f == k)))
    return s.groupBy("root").agg(
        F.first("class").alias("class"), F.count("*").alias("total_tracks"), F.count_if(F.col("action") == "propose_fix").alias("proposed"),
        F.count_if(F.col("action") == MANUAL).alias("unreadable"), F.count_if(low).alias("low_confidence"),
        F.count_if(F.col("action").isin(*PENDING)).alias("pending"), *model, *[number(k).alias(k) for k in FLAGS])


def decision_counters(s: DataFrame, decisions: DataFrame) -> DataFrame:
    """root and the counters of each album's decisions; decided: its pending suggestions with a decision."""
    of = lambda when, name: F.count_if(when).alias(name)
    approve = F.col("action") == "approve"
    d = decisions.groupBy("root", "path").agg(
        of(approve, "approved"), of(approve & (F.col("note") == AUTO_NOTE), "auto_approved"), of(F.col("action") == "skip", "skipped"), of(F.col("action") == "edit", "edited"))
    d = d.join(pending(s).select("root", "path", F.lit(1).alias("is_pending")).distinct(), ["root", "path"], "left")
    total = [F.sum(c).alias(c) for c in DECISION_COUNTERS]
    return d.groupBy("root").agg(*total, F.count("is_pending").alias("decided"))


def _album_counters(counters: DataFrame, decided: DataFrame) -> DataFrame:
    """suggestion_counters with decision_counters, for albums that have suggestions."""
    return counters.join(decided, "root", "left").withColumn("pending_review", F.col("pending") - F.coalesce("decided", F.lit(0)))


def _totals(albums: DataFrame, *more: Column, most: int = 15) -> DataFrame:
    """top_issues: the most frequent issue flags and their numbers, ties by name; the flags are a fixed few."""
    of = lambda k: F.count_if(F.col("class") == k).alias(f"{k}_albums")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    issue = lambda k: F.struct((-F.coalesce(F.sum(k), F.lit(0))).alias("less"), F.lit(k).alias("flag"))
    x = albums.agg(F.count("*").alias("total_albums"), of("clean"), of("deterministic"), of("broken"), of("mixed"), *map(total, (*ROW_COUNTERS, *DECISION_COUNTERS, "pending_review")), *more, F.array(*map(issue, FLAGS)).alias("issues"))
    found = F.slice(F.array_sort(F.filter("issues", lambda i: i["less"] < 0)), F.lit(1), F.lit(most))
    return x.withColumn("top_issues", F.transform(found, lambda i: F.struct(i["flag"].alias("flag"), (-i["less"]).alias("n")))).drop("issues")


def library_report(s: DataFrame, decisions: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """One row of counters over albums, suggestions and all decision rows of albums that have suggestions."""
    return _totals(_album_counters(suggestion_counters(s, o), decision_counters(s, decisions)))


def report_of_counters(counters: DataFrame, s: DataFrame, decisions: DataFrame, scanned: DataFrame) -> DataFrame:
    """routed_report where the suggestions' counters are stored: of s, root, path and action are read."""
    x = scanned.select("root").distinct().join(_album_counters(counters, decision_counters(s, decisions)), "root", "full")
    return _totals(x, F.count_if(F.col("class").isNull()).alias("skipped_unchanged"), F.count_if((F.col("class") == "mixed") & F.col("used_model")).alias("model_albums"))


def routed_report(s: DataFrame, decisions: DataFrame, scanned: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """The report of suggestions with used_model, over all scanned albums (root): an album without suggestions counts as
    skipped_unchanged and in the total; model_albums are the mixed ones that the model answered."""
    return report_of_counters(suggestion_counters(s, o), s, decisions, scanned)


def top_issues(flagged: DataFrame, column: str, most: int = 15) -> DataFrame:
    """The most frequent flags; ties by name."""
    x = flagged.select(F.explode(column).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return x.orderBy(F.desc("n"), "flag").limit(most)


def export_rows(s: DataFrame, base: str = LIBRARY) -> DataFrame:
    """Pending rows as the export has them behind root and pos: text columns, empty for null, confidence with two decimals."""
    show = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return pending(s).select("root", "pos", album_id(F.col("root"), base).alias("album_id"), F.col("path").alias("track_path"), "source", F.format_string("%.2f", "confidence").alias("confidence"),
                             *map(show, ("current_title", "proposed_title", "current_artist", "proposed_artist")), F.array_join("issue_flags", ";").alias("issue_flags"), "reason")


def review_rows(s: DataFrame) -> DataFrame:
    """All rows as an album's review sheet has them, null as empty text."""
    show = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return s.select("root", "pos", F.col("path").alias("track_path"), "action", F.format_string("%.2f", "confidence").alias("confidence"),
                    *map(show, ("current_title", "proposed_title", "current_artist", "proposed_artist")), F.array_join("issue_flags", ";").alias("issue_flags"), "reason")
