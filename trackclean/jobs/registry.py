"""The registered queries of the cleaning jobs and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.flags import detect_issues, is_generic, is_unreadable
from ..operators import albums, decisions, modelio, normalize, suggest, tags
from ..options import DEFAULT
from ..sources import bucketed, files, generations, tables
from ..stored import new_folder, store
from ..streaming.decisions import follow_decisions, followed
from .oracles import ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
SMALL_CHUNKS = replace(DEFAULT, max_tracks_per_call=2)


def joined(c: str) -> Column:
    return F.array_join(c, ";").alias(c)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.candidates(tables.tracks(spark, sf_dir).select(*normalize.READ))


def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.of_tracks(tables.tracks(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's responses, stored, as they are read several times."""
    return store(tables.responses(spark, sf_dir))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.validated(suggested(spark, sf_dir))


def on_titles(value: Callable[[Column], Column], name: str) -> Query:
    """A query of one text rule over every track's title."""
    return lambda spark, sf_dir: tables.tracks(spark, sf_dir).select("path", value(X.text(F.col("title"))).alias(name))


def parsed_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.tracks(spark, sf_dir).select("path", "l_linenumber", X.clean_name(F.col("filename")).alias("name"))
    x = x.select("path", X.parse_name(F.col("name"), F.col("l_linenumber") % 2 == 0).alias("p"))
    return x.select("path", "p.artist", "p.title")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tracks(spark, sf_dir).select("path", detect_issues(F.col("title"), F.col("artist")).alias("flags"))


def track_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("path", "proposed_title", "proposed_artist", joined("notes"), joined("original_flags"), joined("remaining_flags"), "confidence")


def suggestion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggested(spark, sf_dir).select("path", "class", "current_title", "current_artist", "proposed_title", "proposed_artist", "action", joined("issue_flags"), "confidence", "reason", "source")


def validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid(spark, sf_dir).select("path", "proposed_title", "proposed_artist", "action", joined("issue_flags"), joined("remaining_flags"), "confidence", "downgraded_from", joined("validator_notes"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.review_queue(valid(spark, sf_dir), tables.decisions(spark, sf_dir)).select("path", "class", "score", "action", "i", "of")


def full_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.review_queue(valid(spark, sf_dir), tables.decisions(spark, sf_dir), show_all=True).select("path", "action", "i", "of")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.tracks(spark, sf_dir)
    return modelio.model_batches(albums.positioned(t), albums.headers(t), SMALL_CHUNKS)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return albums.probe_scores(tables.tracks(spark, sf_dir)).withColumn("sampled_paths", F.array_join("sampled_paths", ";")).withColumn("notes", F.array_join("notes", ";"))


def named_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions of the albums whose id is given: those with an edit among their decisions."""
    edited = tables.decisions(spark, sf_dir).filter("action = 'edit'").select(albums.album_id(F.col("root")).alias("album_id")).distinct()
    return albums.selected_albums(valid(spark, sf_dir), edited).select("path", "class", "action")


def issues_shown(report: DataFrame) -> DataFrame:
    return report.withColumn("top_issues", F.array_join(F.transform("top_issues", lambda i: F.concat_ws("=", i["flag"], i["n"].cast("string"))), ";"))


def cascaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict from the second track on, for each album: skip for folders ending in an even digit, else approve."""
    s = valid(spark, sf_dir)
    verdicts = s.select("root").distinct().select("root", F.lit(1).alias("from_pos"), F.when(F.col("root").rlike("[02468]$"), "skip").otherwise("approve").alias("action"))
    return decisions.cascade(s, tables.decisions(spark, sf_dir), verdicts).select("path", "action", "note")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.apply_audit(valid(spark, sf_dir), tables.decisions(spark, sf_dir), dry_run=False).drop("root")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decisions.apply_audit(valid(spark, sf_dir), tables.decisions(spark, sf_dir), dry_run=False)
    return decisions.cleaned_tracks(tables.tracks(spark, sf_dir), done).select("path", "title", "artist", "album", "album_artist", "track_number")


def tag_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tag maps of the tracks, with keys in either case and values in arrays."""
    t = tables.tracks(spark, sf_dir)
    key = lambda name: F.when(F.col("l_linenumber") % 2 == 0, F.lit(name.upper())).otherwise(F.lit(name))
    year = F.concat((F.col("l_orderkey") % 40 + 1980).cast("string"), F.lit("-05-03"))
    pairs = {"title": F.col("title"), "artist": F.concat(F.lit(" "), "artist", F.lit(" ")), "album": F.col("album"), "albumartist": F.col("album_artist"), "tracknumber": F.concat(F.col("track_number").cast("string"), F.lit("/9")), "discnumber": F.concat((F.col("l_linenumber") % 2 + 1).cast("string"), F.lit("/2")), "date": year}
    return t.select("path", F.map_from_arrays(F.array(*map(key, pairs)), F.array(*[F.array(v) for v in pairs.values()])).alias("raw_tags"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = modelio.merge_responses(suggested(spark, sf_dir), responses(spark, sf_dir), SMALL_CHUNKS)
    return x.select("path", "proposed_title", "proposed_artist", "action", "confidence", joined("issue_flags"), "source")


def merged_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = suggest.validated(modelio.merge_responses(suggested(spark, sf_dir), responses(spark, sf_dir), SMALL_CHUNKS))
    return x.select("path", "proposed_title", "proposed_artist", "action", "confidence", "source", joined("validator_notes"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelio.routed_tracks(tables.tracks(spark, sf_dir), responses(spark, sf_dir), SMALL_CHUNKS)


def routed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run that left out the albums whose earlier scan was the same, from the scan's stored counters."""
    folder, t = new_folder(spark, "library"), store(tables.tracks(spark, sf_dir))
    before = albums.fingerprints(tables.previous_tracks(spark, sf_dir))
    said = responses(spark, sf_dir)
    generations.write_scan(t, folder, 1, lambda x: modelio.routed_tracks(x, said, SMALL_CHUNKS), before=before, digits=1)
    read = lambda name: generations.of_latest(spark, folder, name)
    return issues_shown(decisions.report_of_counters(read("counters"), read("suggestions"), tables.decisions(spark, sf_dir), t))


def two_scans(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a library that is scanned twice: the first time without some albums, with others that are gone later,
    and with other titles and sizes in every fourth album."""
    folder, now = new_folder(spark, "library"), store(tables.tracks(spark, sf_dir))
    other = F.col("l_orderkey") % 4 == 0
    first = now.filter("l_orderkey % 9 <> 0").withColumn("size_bytes", F.when(other, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    first = first.withColumn("title", F.when(other, F.concat(F.lit("va - "), "title")).otherwise(F.col("title")))
    gone = now.filter("l_orderkey % 7 = 0").withColumn("root", F.concat("root", F.lit("-gone"))).withColumn("path", F.concat("root", F.lit("/"), "filename"))
    generations.update(first.unionByName(gone), folder, 1, digits=1)
    generations.update(now, folder, 2, digits=1)
    return folder


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated suggestions after two scans, the second of which works out the changed albums only: those of a full run."""
    s = generations.of_latest(spark, two_scans(spark, sf_dir), "suggestions")
    return s.select("path", "proposed_title", "proposed_artist", "action", joined("issue_flags"), joined("remaining_flags"), "confidence", "downgraded_from", joined("validator_notes"))


def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums and the number of the scan that each was found changed in last, after two scans and a compaction."""
    folder = two_scans(spark, sf_dir)
    found = generations.read_albums(spark, folder).select("root", "tracks", F.col("scan").alias("scan"))
    generations.compact(spark, folder)
    kept = generations.of_latest(spark, folder, "tracks").groupBy("root").agg(F.count("*").alias("kept_tracks"))
    return found.join(kept, "root", "left")


def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = albums.fingerprints(tables.previous_tracks(spark, sf_dir))
    return albums.scan_counters(albums.changed_albums(albums.fingerprints(tables.tracks(spark, sf_dir)), before))


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of the tracks' files with hidden names, other kinds of files and endings in upper case."""
    name = (F.when(F.col("l_partkey") % 13 == 0, F.concat(F.lit("."), "filename")).when(F.col("l_partkey") % 7 == 0, F.concat("filename", F.lit(".txt")))
            .when(F.col("l_partkey") % 3 == 0, F.upper("filename")).otherwise(F.col("filename")))
    return tables.tracks(spark, sf_dir).select(F.concat("root", F.lit("/"), name).alias("path"), "size_bytes", "mtime_us")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.listed_files(file_table(spark, sf_dir))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files with their tags; one track in three has none."""
    return files.with_tags(listed(spark, sf_dir), tag_records(spark, sf_dir)).select("path", "root", "ext", "size_bytes", "title", "artist", "track_number")


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions written as documents of two tracks and read again; those of folders ending in 7 are cut off."""
    docs = files.documents(valid(spark, sf_dir), 2)
    cut = F.when(F.col("root").rlike("7$"), F.substring("doc", 1, 40)).otherwise(F.col("doc"))
    return files.parse_documents(docs.withColumn("doc", cut)).select("path", "part", "class", "pos", "proposed_title", "action", joined("issue_flags"), joined("remaining_flags"), "downgraded_from", joined("validator_notes"), "confidence", "source")


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two tracks, the first of each album spoilt by the last digit of its folder, and what is rejected then:
    all documents of the album."""
    docs = files.documents(valid(spark, sf_dir), 2)
    spoilt = (F.when(F.col("root").endswith("1"), F.regexp_replace("doc", '"action":"[a-z_]+"', '"action":"nonsense"'))
              .when(F.col("root").endswith("2"), F.regexp_replace("doc", '"proposed_artist":"[^"]*"', '"proposed_artist":7'))
              .when(F.col("root").endswith("3"), F.replace("doc", F.lit('"track_path"'), F.lit('"path"')))
              .when(F.col("root").endswith("4"), F.regexp_replace("doc", '"score":[0-9.]+', '"score":"high"'))
              .when(F.col("root").endswith("5"), F.lit("{")).otherwise(F.col("doc")))
    docs = docs.withColumn("doc", F.when(F.col("part") == 0, spoilt).otherwise(F.col("doc")))
    docs = docs.filter(~(F.col("root").endswith("6") & (F.col("part") == 1)))
    return files.rejected_documents(docs).select("root", "part", "reason")


def reloaded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions written as lists and read again, with lists that are none and items that are no decisions."""
    d = tables.decisions(spark, sf_dir).withColumnRenamed("path", "track_path")
    bad = F.lit('{"track_path": null, "action": "skip"}, 7, ')
    item = F.to_json(F.struct("track_path", F.when(F.col("ord") % 3 == 0, "burn").otherwise(F.col("action")).alias("action"), "final_title", "final_artist", "note"))
    doc = F.when(F.col("root").rlike("7$"), F.concat(F.lit("["), item)).otherwise(F.concat(F.lit("["), bad, item, F.lit("]")))
    return files.parse_decisions(d.select("root", doc.alias("doc"))).select("path", "action", "final_title", "note", "ord")


def streamed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions as a stream of four batches, dealt by a hash, so that later decisions may come before earlier ones."""
    folder = new_folder(spark, "stream")
    d = tables.decisions(spark, sf_dir)
    d.repartition(4, "ord").write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    follow_decisions(stream, f"{folder}/last", f"{folder}/checkpoint").awaitTermination()
    return followed(spark, f"{folder}/last")


def audit_of_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit from tables that are stored in buckets of tracks."""
    name, buckets = new_folder(spark, "t").rsplit("-", 1)[1], int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = bucketed.save(valid(spark, sf_dir), f"suggestions_{name}", buckets)
    d = bucketed.save(tables.decisions(spark, sf_dir), f"decisions_{name}", buckets)
    return decisions.apply_audit(s, d, dry_run=False).drop("root")


def written_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit as it is written and read again, after a dry run into the same folder."""
    folder, d = new_folder(spark, "audit"), tables.decisions(spark, sf_dir)
    s = store(valid(spark, sf_dir))
    files.write_audit(decisions.apply_audit(s, d), folder)
    files.write_audit(decisions.apply_audit(s, d, dry_run=False), folder)
    return spark.read.parquet(folder).drop("root")


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.decisions(spark, sf_dir)
    return decisions.decision_log(d, decisions.auto_approve(valid(spark, sf_dir), d, least=0.9)).drop("root")


def title_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return tables.tracks(spark, sf_dir).select("path", is_generic(X.text(t)).alias("generic"), X.is_symbolic(t).alias("symbolic"), is_unreadable(t).alias("unreadable"))


def split_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.tracks(spark, sf_dir).select("path", X.split_artist_title(X.text(F.col("title"))).alias("two"))
    return x.select("path", "two.artist", "two.title")


def artist_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without their artist's name, and without the literal prefix "va - "."""
    t = X.text(F.col("title"))
    return tables.tracks(spark, sf_dir).select("path", X.strip_artist_prefix(t, X.text(F.col("artist")), F.col("album_artist")).alias("value"), X.strip_literal_prefix(t, F.lit("va - ")).alias("literal"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("path", "root", "filename", "ext", albums.album_id(F.col("root")).alias("album_id"))


def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of titles, and whether title and artist share none."""
    return tables.tracks(spark, sf_dir).select("path", F.array_join(X.tokens(F.col("title")), "|").alias("tokens"), X.no_shared_tokens(F.col("title"), F.col("artist")).alias("apart"))


def of_tracks(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(tables.tracks(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "detect_issues": lambda spark, d: issues(spark, d).select("path", joined("flags")),
    "issue_counts_top15": lambda spark, d: decisions.top_issues(issues(spark, d), "flags"),
    "album_sample": lambda spark, d: albums.album_sample(tables.tracks(spark, d)).select("root", "path", "pos", "n"),
    "album_probe_score": probes,
    "album_majority": lambda spark, d: albums.majority(tables.tracks(spark, d), "album_artist"),
    "album_common_prefix": of_tracks(albums.common_prefix),
    "album_split_support": lambda spark, d: albums.support(tables.tracks(spark, d)).select("root", "split_hints"),
    "album_filename_support": lambda spark, d: albums.support(tables.tracks(spark, d)).select("root", "filename_hints", "allow_split"),
    "album_table": lambda spark, d: albums.albums(tables.tracks(spark, d)).drop("fingerprint"),
    "album_fingerprint": of_tracks(albums.fingerprints),
    "changed_albums": lambda spark, d: albums.changed_albums(albums.fingerprints(tables.tracks(spark, d)), albums.fingerprints(tables.previous_tracks(spark, d))).select("root", "status"),
    "filename_parse": parsed_filenames,
    "strip_track_number": on_titles(X.strip_track_number, "value"),
    "normalize_separators": on_titles(lambda t: X.normalize_separators(t)["value"], "value"),
    "strip_tempo": on_titles(X.strip_tempo, "value"),
    "strip_original_mix": on_titles(X.strip_original_mix, "value"),
    "smart_title_case": on_titles(X.smart_title_case, "value"),
    "track_candidates": track_candidates,
    "album_classification": lambda spark, d: suggest.classes(candidates(spark, d)),
    "suggestions": suggestion_rows,
    "validated_suggestions": validated_rows,
    "pending_export": lambda spark, d: decisions.export_rows(valid(spark, d)).drop("root", "pos"),
    "review_queue": queue,
    "review_queue_all": full_queue,
    "selected_albums": named_albums,
    "auto_approve": lambda spark, d: decisions.auto_approve(valid(spark, d), tables.decisions(spark, d), least=0.9).drop("root"),
    "cascade_decisions": cascaded,
    "streamed_decisions": streamed_decisions,
    "latest_decisions": lambda spark, d: decisions.latest(tables.decisions(spark, d)),
    "apply_audit": audit,
    "apply_audit_bucketed": audit_of_buckets,
    "apply_audit_written": written_audit,
    "apply_counters": lambda spark, d: decisions.apply_counters(valid(spark, d), tables.decisions(spark, d), dry_run=False),
    "cleaned_tracks": cleaned,
    "library_report": lambda spark, d: issues_shown(decisions.library_report(valid(spark, d), tables.decisions(spark, d))),
    "tag_flatten": lambda spark, d: tags.flatten_tags(tag_records(spark, d)),
    "model_batches": batches,
    "model_response_check": lambda spark, d: modelio.check_responses(tables.responses(spark, d)).select("root", "chunk", "ok", "reason"),
    "model_merge": merged,
    "model_merge_validated": merged_valid,
    "review_sheet": lambda spark, d: decisions.review_rows(valid(spark, d)).drop("root", "pos"),
    "scan_counters": scan_counters,
    "incremental_suggestions": incremental,
    "incremental_scan": incremental_scan,
    "file_listing": lambda spark, d: listed(spark, d).select("path", "size_bytes", "mtime_us"),
    "path_parts": path_parts,
    "scan_with_tags": scanned,
    "approval_counters": lambda spark, d: decisions.approval_counters(valid(spark, d), tables.decisions(spark, d), least=0.9),
    "decision_log": decision_log,
    "orphan_decisions": lambda spark, d: decisions.orphan_decisions(valid(spark, d), tables.decisions(spark, d)).select("path", "action", "ord"),
    "document_reload": reloaded,
    "document_quarantine": quarantined,
    "decision_reload": reloaded_decisions,
    "routed_suggestions": lambda spark, d: routed(spark, d).select("path", "class", "proposed_title", "action", "confidence", "source", "reason", "used_model"),
    "routed_report": routed_report,
    "title_tests": title_tests,
    "title_tokens": title_tokens,
    "split_artist_title": split_titles,
    "strip_artist_prefix": artist_prefixes,
    "strip_junk_prefix": on_titles(X.strip_junk_prefix, "value"),
    "strip_junk_suffix": on_titles(X.strip_junk_suffix, "value"),
}
