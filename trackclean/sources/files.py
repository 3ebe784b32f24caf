"""What the jobs read and write: file listings, review sheets, nested documents and their reload.

Every sink takes a folder that executors share, and writes as many files as its input has partitions.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.decisions import export_rows, review_rows
from ..operators.tags import EXTENSIONS, flatten_tags, listed_files
from ..options import FLAGS, PENDING
from .folders import FolderSource

#: Tracks of one nested document: a larger album has several, so that no row grows with its album.
DOCUMENT_TRACKS = 1000
TRACK = "struct<pos:long,original_flags:array<string>,remaining_flags:array<string>,downgraded_from:string,validator_notes:array<string>,used_model:boolean,track_path:string,current_title:string,current_artist:string,proposed_title:string,proposed_artist:string,action:string,issue_flags:array<string>,confidence:double,reason:string,source:string>"
DOCUMENT = f"struct<root:string,part:int,class:string,score:double,class_reason:string,suggestions:array<{TRACK}>>"
DECISION = "struct<track_path:string,action:string,final_title:string,final_artist:string,note:string>"
#: What documents may say.
REVIEW_ACTIONS = ("approve", "edit", "skip")
ACTIONS = ("keep", *PENDING)
CLASSES = ("clean", "deterministic", "mixed", "broken")
SOURCES = ("none", "deterministic", "llm")


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Music files below a folder: path, size_bytes, mtime_us, filename, ext, root. Contents are not read.

    A folder that all executors have mounted is listed by them, empty files and names that start with "_" too. In other
    stores (a path with a scheme) Spark lists, and leaves those out.
    """
    if ":" not in folder.split("/", 1)[0]:
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
        spark.dataSource.register(FolderSource)
        return listed_files(spark.read.format("folder").load(folder), extensions)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed_files(found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("mtime_us")), extensions)


def with_tags(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files with the flattened tags of records (path, raw_tags); a file without a record stays, its tags null."""
    return files.join(flatten_tags(records.select("path", "raw_tags")), "path", "left")


def _write_csv(rows: DataFrame, folder: str, order: tuple[str, ...], keep: Column | None = None) -> int:
    """Rows in order as CSV parts with a header and RFC quotes; returns their number, observed while they are written."""
    seen = Observation()
    counted = rows.orderBy(*order).observe(seen, F.count("*").alias("n"))  # behind the sort, which samples its input first
    counted.drop("root", "pos").write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)
    return seen.get["n"]


def write_review_sheet(s: DataFrame, folder: str) -> int:
    return _write_csv(review_rows(s), folder, ("root", "pos"))


def write_pending(s: DataFrame, folder: str) -> int:
    """Pending suggestions; what is decided already is not left out."""
    return _write_csv(export_rows(s), folder, ("root", "pos"))


def documents(s: DataFrame, most: int = DOCUMENT_TRACKS) -> DataFrame:
    """root, part, doc: the suggestions of an album in track order, nested under its header, as JSON. What validation adds
    is there if s has it. A document says how many its album has, so that one that is missing is noticed."""
    more = [c for c in ("original_flags", "remaining_flags", "downgraded_from", "validator_notes", "used_model") if c in s.columns]
    track = F.struct("pos", F.col("path").alias("track_path"), *more, "current_title", "current_artist", "proposed_title", "proposed_artist", "action", "issue_flags", "confidence", "reason", "source")
    part = F.floor(F.col("pos") / most).cast("int")
    x = s.groupBy("root", part.alias("part")).agg(*[F.first(c).alias(c) for c in ("class", "score", "class_reason")], F.array_sort(F.collect_list(track)).alias("tracks"))
    parts = s.groupBy(F.col("root").alias("of")).agg(F.countDistinct(part).cast("int").alias("parts"))
    x = x.join(parts, F.col("root").eqNullSafe(F.col("of")))
    return x.select("root", "part", F.to_json(F.struct("root", "part", "parts", "class", "score", "class_reason", F.col("tracks").alias("suggestions"))).alias("doc"))


def write_documents(docs: DataFrame, folder: str) -> None:
    docs.select("doc").write.mode("overwrite").text(folder)


def _kind(v: Column, path: str = "$") -> Column:
    """STRING, DOUBLE, ARRAY<...> and so on; VOID where there is nothing."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _wrong_suggestion(e: Column) -> Column:
    """The first thing that is wrong with a suggestion of a document, else null. What is missing counts as null."""
    text = lambda name: F.try_variant_get(e, f"$.{name}", "string")
    no_text = lambda name, *more: ~_kind(e, f"$.{name}").isin("STRING", *more)
    no_flags = lambda name: ~F.startswith(_kind(e, f"$.{name}"), F.lit("ARRAY")) & (_kind(e, f"$.{name}") != "VOID") | F.exists(
        F.coalesce(F.try_variant_get(e, f"$.{name}", "array<string>"), F.array()), lambda f: ~F.coalesce(f.isin(*FLAGS), F.lit(False)))
    found = F.when(~F.startswith(_kind(e), F.lit("OBJECT")), "suggestion is not an object").when(no_text("track_path"), "track_path is not a text")
    for name in ("current_title", "current_artist", "proposed_title", "proposed_artist", "reason"):
        found = found.when(no_text(name, "VOID"), f"{name} is not a text")
    found = found.when(no_text("action") | ~text("action").isin(*ACTIONS), "unknown action")
    found = found.when(no_text("source", "VOID") | ~text("source").isin(*SOURCES), "unknown source")
    found = found.when(no_text("downgraded_from", "VOID") | ~text("downgraded_from").isin(*ACTIONS), "unknown downgraded_from")
    for name in ("issue_flags", "original_flags", "remaining_flags"):
        found = found.when(no_flags(name), f"{name} is not a list of flags")
    found = found.when(~_kind(e, "$.validator_notes").isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>"), "validator_notes is not a list of texts")
    return found.when((_kind(e, "$.confidence") != "VOID") & F.try_variant_get(e, "$.confidence", "double").isNull(), "confidence is not a number")


def checked_documents(docs: DataFrame) -> DataFrame:
    """docs (doc, and root and part where they are known) -> root, part, parts, doc, reason: the first thing that is wrong
    with a document, else null."""
    known = lambda name, kind: F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    x = docs.select("doc", known("root", "string").alias("known_root"), known("part", "int").alias("known_part"), F.try_parse_json("doc").alias("v"))
    x = x.withColumn("entries", get("suggestions", "array<variant>"))
    v = F.col("v")
    reason = (F.when(v.isNull(), "not JSON").when(~F.startswith(_kind(v), F.lit("OBJECT")), "not an object").when(_kind(v, "$.root") != "STRING", "root is not a text")
              .when(get("part", "int").isNull() | get("parts", "int").isNull(), "part is not a number")
              .when((_kind(v, "$.class") != "STRING") | ~get("class", "string").isin(*CLASSES), "unknown class").when(get("score", "double").isNull(), "score is not a number")
              .when(~_kind(v, "$.class_reason").isin("STRING", "VOID"), "class_reason is not a text").when(F.col("entries").isNull(), "suggestions is not a list")
              .otherwise(F.get(F.filter(F.transform("entries", _wrong_suggestion), lambda r: r.isNotNull()), F.lit(0))))
    return x.select(F.coalesce("known_root", get("root", "string")).alias("root"), F.coalesce("known_part", get("part", "int")).alias("part"), get("parts", "int").alias("parts"), "doc", reason.alias("reason"))


def _rejected_albums(checked: DataFrame) -> DataFrame:
    """of, why: the albums of which a document is wrong, or missing. All documents of an album are judged together."""
    x = checked.groupBy(F.col("root").alias("of")).agg(
        F.min(F.when(F.col("reason").isNotNull(), F.struct("part", "reason"))).alias("bad"),
        F.countDistinct("part").alias("got"), F.max("parts").alias("parts"), F.min("parts").alias("least"))
    missing = F.coalesce((F.col("got") != F.col("parts")) | (F.col("least") != F.col("parts")), F.lit(True))
    why = F.when(F.col("bad").isNotNull(), F.concat(F.lit("part "), F.coalesce(F.col("bad.part").cast("string"), F.lit("?")), F.lit(": "), F.col("bad.reason"))).when(missing, "parts are missing")
    return x.select("of", why.alias("why")).filter("why is not null")


def rejected_documents(docs: DataFrame) -> DataFrame:
    """root, part, reason (of the album), doc: the documents that parse_documents leaves out, for someone to look at.

    A document of no album that can be told is rejected alone.
    """
    x = checked_documents(docs)
    why = _rejected_albums(x.filter("root is not null"))
    found = x.filter("root is not null").join(why, F.col("root") == F.col("of")).select("root", "part", F.col("why").alias("reason"), "doc")
    return found.unionByName(x.filter("root is null").select("root", "part", F.coalesce("reason", F.lit("root is not a text")).alias("reason"), "doc"))


def parse_documents(docs: DataFrame) -> DataFrame:
    """doc -> suggestion rows of the albums whose documents are all there and in order; others are left out as a whole."""
    x = checked_documents(docs)
    why = _rejected_albums(x.filter("root is not null"))
    x = x.filter("root is not null").join(why, F.col("root") == F.col("of"), "left_anti")
    x = x.dropDuplicates(["root", "part"]).select(F.from_json("doc", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"))
    x = x.select("d.root", "d.part", "d.class", "d.score", "d.class_reason", F.posexplode("d.suggestions").alias("nth", "t"))
    return x.select("root", "part", "nth", "class", "score", "class_reason", F.col("t.track_path").alias("path"), *[f"t.{c}" for c in ("pos", "original_flags", "remaining_flags", "downgraded_from", "validator_notes", "used_model", "current_title", "current_artist", "proposed_title", "proposed_artist", "action", "issue_flags", "confidence", "reason", "source")])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return parse_documents(spark.read.text(folder).withColumnRenamed("value", "doc"))


def parse_decisions(docs: DataFrame) -> DataFrame:
    """root, doc (a JSON list of decisions) -> root, path, action, final_title, final_artist, note, ord.

    A doc that is no list is left out; of a list only the items that are no decisions are.
    """
    x = docs.select("root", F.posexplode(F.try_variant_get(F.try_parse_json("doc"), "$", "array<variant>")).alias("ord", "item"))
    kind = F.schema_of_variant("item")
    x = x.filter(F.startswith(kind, F.lit("OBJECT"))).withColumn("d", F.from_json(F.to_json("item"), DECISION))
    x = x.filter(F.col("d.track_path").isNotNull() & F.col("d.action").isin(*REVIEW_ACTIONS))
    return x.select("root", F.col("d.track_path").alias("path"), "d.action", "d.final_title", "d.final_artist", "d.note", F.col("ord").cast("long").alias("ord"))


def write_audit(audit: DataFrame, folder: str) -> None:
    """The audit of a run, dry or not; a run replaces what an earlier one left in its folder."""
    audit.write.mode("overwrite").parquet(folder)
