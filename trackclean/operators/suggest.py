"""Album classes, suggestions, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.flags import has_any, is_generic, is_unreadable
from ..options import BLOCKING, DEFAULT, HARD, MANUAL, SOFT, Options
from ..stored import own_tables, store
from .albums import in_sample, joined_facts
from .normalize import READ
from .normalize import candidates as make_candidates


def classes(candidates: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """root, score, class, class_reason: one row for each album, by aggregates of its candidates."""
    count = lambda names: F.size(F.array_intersect("original_flags", F.array(*map(F.lit, names))))
    cost = F.when(in_sample(o), count(HARD) * 0.4 + count(SOFT) * 0.1)
    changed = F.col("proposed_title").isNotNull() | F.col("proposed_artist").isNotNull()
    x = candidates.groupBy("root").agg(
        F.round(F.greatest(F.lit(0.0), 1 - F.sum(cost) / F.count(cost)), 3).alias("score"), F.bool_or(changed).alias("any_change"),
        F.bool_and(F.col("confidence") >= 0.75).alias("confident"), F.bool_or(has_any(F.col("remaining_flags"), BLOCKING)).alias("blocked"),
        F.count_if(has_any(F.col("remaining_flags"), ("unreadable_title", "generic_track_name"))).alias("bad"), F.count("*").alias("n"))
    # The wording of reasons, which reviewers and reports see.
    score = F.format_string("%.2f", "score")
    clean, fixed = f"{o.clean_threshold:.2f}", f"{o.deterministic_threshold:.2f}"
    kind = (F.when((F.col("score") >= o.clean_threshold) & ~F.col("any_change"), "clean")
            .when((F.col("score") >= o.deterministic_threshold) & F.col("confident") & ~F.col("blocked"), "deterministic")
            .when(F.col("bad") * 2 > F.col("n"), "broken").otherwise("mixed"))
    mixed = F.concat_ws(
        "; ", F.when(F.col("score") < o.deterministic_threshold, F.concat(F.lit("probe "), score, F.lit(f" < deterministic_threshold {fixed}"))),
        F.when(~F.col("confident"), "low-confidence deterministic candidates"), F.when(F.col("blocked"), "blocking remaining flags present"))
    x = x.withColumn("class", kind)
    reason = (F.when(F.col("class") == "clean", F.concat(F.lit("probe "), score, F.lit(f" ≥ clean_threshold {clean} and no rule changes")))
              .when(F.col("class") == "deterministic", F.concat(F.lit("probe "), score, F.lit(f" ≥ deterministic_threshold {fixed}; all candidates confident and no blocking remaining flags")))
              .when(F.col("class") == "broken", "majority of tracks have unreadable/generic titles after deterministic pass")
              .otherwise(F.when(mixed == "", "mixed evidence").otherwise(mixed)))
    return x.select("root", "score", "class", reason.alias("class_reason"))


def suggestions(candidates: DataFrame, o: Options = DEFAULT, keep_clean: bool = True, carry: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """A suggestion for every track: kept as it is in clean albums (unless keep_clean is off), else what the rules propose.

    Candidates are stored, as their albums' classes are worked out from them all and joined to each. carry: columns of the
    candidates that stay. outer: as in store, so that what candidates are read from can be deleted first.
    """
    x = store(candidates.select("root", "path", "pos", "n", "ext", "title", "artist", "proposed_title", "proposed_artist", "original_flags", "remaining_flags", "confidence", "notes", *[c for c in carry if c != "n"]), outer)
    x = joined_facts(x, classes(x, o))
    clean = (F.col("class") == "clean") & F.lit(keep_clean)
    changed = F.col("proposed_title").isNotNull() | F.col("proposed_artist").isNotNull()
    action = (F.when(clean, "keep").when(changed, "propose_fix")
              .when(F.array_contains("remaining_flags", "unreadable_title"), MANUAL).otherwise("keep"))
    return x.select(
        "root", "path", "pos", "ext", "class", "score", "class_reason", F.col("title").alias("current_title"), F.col("artist").alias("current_artist"),
        F.when(clean, F.col("title")).otherwise(F.coalesce("proposed_title", "title")).alias("proposed_title"),
        F.when(clean, F.col("artist")).otherwise(F.coalesce("proposed_artist", "artist")).alias("proposed_artist"),
        action.alias("action"), F.col("remaining_flags").alias("issue_flags"), "original_flags", "remaining_flags",
        F.when(clean, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(clean, "album probe clean; no change needed").when(F.size("notes") == 0, "no changes proposed").otherwise(F.array_join("notes", "; ")).alias("reason"),
        F.when(clean, "none").otherwise("deterministic").alias("source"), *carry)


def of_tracks(tracks: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """suggestions of tracks; their stored positions are deleted when candidates are stored."""
    with own_tables(tracks.sparkSession):
        return suggestions(make_candidates(tracks.select(*READ), o), o, outer=True)


def changes(proposed: Column, current: Column) -> Column:
    return proposed.isNotNull() & (X.text(proposed) != X.text(current))


def validated(s: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """Suggestions with the guard rules applied, in order: state is carried in columns, one stage for each rule.

    Adds downgraded_from and validator_notes. A row that changes nothing is kept and left alone.
    """
    pt, pa = F.col("proposed_title"), F.col("proposed_artist")
    ct, ca = F.col("current_title"), F.col("current_artist")
    model = F.col("source") == "llm"
    x = s.withColumn("downgraded_from", F.lit(None).cast("string")).withColumn("validator_notes", F.array().cast("array<string>"))

    def apply(x: DataFrame, when: Column, note: str, cap: float | None = None, down: bool = False, **sets: Column) -> DataFrame:
        x = x.withColumn("__hit", F.coalesce(when, F.lit(False)))
        hit = F.col("__hit")
        x = x.withColumn("validator_notes", F.when(hit, F.array_append("validator_notes", F.lit(note))).otherwise(F.col("validator_notes")))
        if cap is not None:
            x = x.withColumn("confidence", F.when(hit, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence")))
        if down:
            first = hit & (F.col("action") != MANUAL) & F.col("downgraded_from").isNull()
            x = x.withColumn("downgraded_from", F.when(first, F.col("action")).otherwise(F.col("downgraded_from")))
            x = x.withColumn("action", F.when(hit, MANUAL).otherwise(F.col("action")))
        for name, value in sets.items():
            x = x.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
        return x.drop("__hit")

    symbolic = model & pt.isNotNull() & X.is_symbolic(ct) & (X.ustrip(X.text(pt)) != X.ustrip(X.text(ct)))
    x = apply(x, symbolic, "rejected edit of symbolic title", cap=0.3, proposed_title=ct)
    x = x.withColumn("live", changes(pt, ct) | changes(pa, ca))
    live = F.col("live")
    x = apply(x, ~live & (F.col("action") == "propose_fix"), "no effective change, marked keep", action=F.lit("keep"))
    x = apply(x, live & pt.isNotNull() & X.blank(pt), "rejected empty proposed_title", cap=0.3, down=True, proposed_title=ct)
    x = apply(x, live & pa.isNotNull() & X.blank(pa), "rejected empty proposed_artist", cap=0.3, proposed_artist=ca)
    generic = (X.text(pt) != "") & is_generic(pt)
    x = x.withColumn("generic", generic)
    x = apply(x, live & F.col("generic"), "proposed title is still generic", cap=0.3, down=True)
    spurious = live & ~F.col("generic") & (X.text(pt) != "") & F.array_contains("remaining_flags", "generic_track_name")
    x = apply(x, spurious, "removed spurious generic_track_name flag", remaining_flags=F.array_remove("remaining_flags", "generic_track_name"), issue_flags=F.array_remove("issue_flags", "generic_track_name"))
    x = apply(x, live & (X.text(pt) != "") & is_unreadable(pt), "proposed title still looks unreadable", down=True)
    shared_t, shared_a = X.no_shared_tokens(ct, pt), X.no_shared_tokens(ca, pa)
    x = x.withColumn("rewritten", shared_t & shared_a)
    x = apply(x, live & model & (changes(pt, ct) | changes(pa, ca)) & F.col("rewritten"), "possible invention", cap=0.4)
    low = lambda c: F.lower(X.ustrip(X.text(c)))
    swap = (low(ct) != "") & (low(ca) != "") & (low(ct) == low(pa)) & (low(ca) == low(pt))
    x = apply(x, live & swap, "artist/title look swapped", down=True, issue_flags=F.array_union("issue_flags", F.array(F.lit("suspicious_swap_artist_title"))))
    x = apply(x, live & (F.col("confidence") < o.low_confidence_flag) & (F.col("action") == "propose_fix"), "low confidence")
    x = apply(x, live & changes(pt, ct) & changes(pa, ca) & F.col("rewritten"), "both fields fully rewritten", down=True)
    return x.drop("live", "generic", "rewritten")
