"""Track tables derived from the order tables, by one text that Spark and DuckDB read alike (integer arithmetic only)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Java never compiles a method of more than 8,000 bytes, and the rules' whole stages are such methods. With the limit at that,
#: in place of its default, Spark makes many small methods of them. A session that sets another limit keeps its own.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"

_CASED = "upper(substr(split_part(p_name, ' ', {0}), 1, 1)) || substr(split_part(p_name, ' ', {0}), 2)"
_TITLE = f"{_CASED.format(1)} || ' ' || {_CASED.format(2)}"
_NN = "lpad(cast(l_linenumber as string), 2, '0')"
_KEY = "cast(l_orderkey as string)"
_UID = f"{_KEY} || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || cast(cast(floor(l_quantity) as bigint) as string)"

TRACKS_SQL = f"""
SELECT root, root || '/' || filename AS path, filename, ext, l_linenumber AS track_number, cast(NULL as int) AS disc_number,
  CASE WHEN album_kind <= 3 THEN cased WHEN album_kind = 4 THEN s_name || ' - ' || cased
    WHEN album_kind = 5 THEN s_name || ' - ' || album || ' - ' || cased
    WHEN album_kind = 6 THEN replace(p_name, ' ', '_') || '_remix' WHEN album_kind = 7 THEN upper(p_name)
    WHEN album_kind = 8 THEN NULL WHEN album_kind = 9 THEN 'Track ' || nn
    WHEN track_kind = 0 THEN nn || ' - ' || p_name WHEN track_kind = 1 THEN 'va - ' || cased
    WHEN track_kind = 2 THEN '[free] ' || cased WHEN track_kind = 3 THEN cased || ' (original mix)'
    WHEN track_kind = 4 THEN cased || ' - Original Mix' WHEN track_kind = 5 THEN cased || ' (160 bpm)'
    WHEN track_kind = 6 THEN cased || ' [160] 178-200bpm' WHEN track_kind = 7 THEN cased || ' — ' || p_name
    WHEN track_kind = 8 THEN replace(cased, ' ', '  ') WHEN track_kind = 9 THEN cased || ' promo'
    WHEN track_kind = 10 THEN s_name WHEN track_kind = 11 THEN 'iii' WHEN track_kind = 12 THEN '*** !!'
    WHEN track_kind = 13 THEN ' ' WHEN track_kind = 14 THEN upper(p_name) ELSE cased END AS title,
  CASE WHEN album_kind IN (4, 8) THEN NULL WHEN album_kind = 9 AND l_linenumber % 2 = 0 THEN NULL
    WHEN album_kind >= 10 AND track_kind = 7 THEN 'the ' || p_name ELSE s_name END AS artist,
  album, CASE WHEN l_linenumber % 3 < 2 THEN p_brand ELSE NULL END AS album_artist,
  DAYS * cast(86400000000 as bigint) AS mtime_us, cast(floor(l_extendedprice) as bigint) AS size_bytes,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name
FROM (
  SELECT *, CASE WHEN album_kind % 4 = 0 THEN nn || '. ' || s_name || ' - ' || cased || ' (' || uid || ').flac'
      WHEN album_kind % 4 = 1 THEN nn || ' - ' || s_name || ' - ' || cased || ' (' || uid || ').mp3'
      WHEN album_kind % 4 = 2 THEN s_name || '_-_' || nn || '_-_' || replace(cased, ' ', '_') || '_' || uid || '.wav'
      ELSE 'track ' || uid || '.ogg' END AS filename,
    CASE WHEN album_kind % 4 = 0 THEN '.flac' WHEN album_kind % 4 = 1 THEN '.mp3' WHEN album_kind % 4 = 2 THEN '.wav' ELSE '.ogg' END AS ext
  FROM (
    SELECT l.*, p_name, p_brand, s_name, {_TITLE} AS cased, {_NN} AS nn, {_UID} AS uid, 'Order ' || {_KEY} AS album,
      '/lib/' || cast(l_orderkey % 50 as string) || '/' || {_KEY} AS root, l_orderkey % 12 AS album_kind,
      (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 16 AS track_kind
    FROM LINEITEM l JOIN PART p ON l_partkey = p_partkey JOIN SUPPLIER s ON l_suppkey = s_suppkey
  ) a
) b
"""
DUCK_TRACKS = TRACKS_SQL.replace("DAYS", "date_diff('day', date '1970-01-01', cast(l_shipdate as date))").replace("LINEITEM", "lineitem").replace("PART p", "part p").replace("SUPPLIER s", "supplier s")
SPARK_TRACKS = TRACKS_SQL.replace("DAYS", "datediff(cast(l_shipdate as date), date '1970-01-01')").replace("LINEITEM", "{lineitem}").replace("PART p", "{part} p").replace("SUPPLIER s", "{supplier} s")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if spark.conf.get(METHOD_LIMIT) == "65535":
        spark.conf.set(METHOD_LIMIT, "8000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: an album for each order, with twelve kinds of albums and sixteen of dirty titles."""
    return spark.sql(SPARK_TRACKS, **{t: read_table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier")})


#: Decisions: approvals, skips and edits of three in five tracks, some twice, some of tracks that are gone.
DECISIONS_SQL = """
WITH d AS (
  SELECT root, CASE WHEN l_partkey % 97 = 0 THEN path || '.gone' ELSE path END AS path,
    CASE WHEN l_suppkey % 3 = 0 THEN 'approve' WHEN l_suppkey % 3 = 1 THEN 'skip' ELSE 'edit' END AS action,
    CASE WHEN l_suppkey % 3 < 2 OR l_linenumber % 3 = 1 THEN NULL WHEN l_linenumber % 3 = 0 THEN upper(p_name) ELSE '' END AS final_title,
    cast(NULL as string) AS final_artist,
    CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 4 = 0 THEN 'auto-approved' ELSE NULL END AS note,
    l_orderkey * 1000 + l_linenumber * 10 AS ord, l_partkey
  FROM (TRACKS) t WHERE l_partkey % 5 < 3)
SELECT root, path, action, final_title, final_artist, note, ord FROM d
UNION ALL SELECT root, path, 'skip', NULL, NULL, NULL, ord + 5 FROM d WHERE l_partkey % 11 = 0
"""
#: Fingerprints of an earlier scan: albums whose order key divides by nine are not in it, by four have another size.
PREVIOUS_SQL = """
SELECT root, path, mtime_us, CASE WHEN l_orderkey % 4 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes
FROM (TRACKS) t WHERE l_orderkey % 9 <> 0
"""
#: Responses of a model, one for each chunk of two tracks: every fifth track is left out, some chunks are malformed.
RESPONSES_SQL = """
SELECT root, chunk, CASE WHEN l_orderkey % 7 = 1 THEN 'not json' WHEN l_orderkey % 7 = 2 THEN '[1]' WHEN l_orderkey % 7 = 3 THEN '{{"tracks": 5}}'
    ELSE '{{"tracks": [' || entries || ']}}' END AS raw
FROM (
  SELECT root, chunk, min(l_orderkey) AS l_orderkey, JOINED AS entries
  FROM (
    SELECT root, pos, cast(floor(pos / 2) as int) AS chunk, l_orderkey,
      '{{"track_path": "' || path || '", "action": "' || CASE WHEN l_partkey % 31 = 0 THEN 'destroy' ELSE 'propose_fix' END || '", "proposed_title": ' ||
      CASE WHEN l_partkey % 29 = 0 THEN '7' WHEN l_partkey % 4 = 0 THEN 'null' ELSE '"' || p_name || '"' END || ', "proposed_artist": null, "confidence": ' ||
      CASE WHEN l_partkey % 37 = 0 THEN '1.5' WHEN l_partkey % 2 = 0 THEN '"0.75"' ELSE '0.5' END || ', "issue_flags": ["scene_junk", "unheard_of"], "reason": "r"}}' AS entry
    FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY coalesce(disc_number, 0), coalesce(track_number, 0), lower(filename), filename) - 1 AS pos FROM (TRACKS) t) p
    WHERE l_partkey % 5 <> 4) e
  GROUP BY root, chunk) g
"""
DUCK_DECISIONS = DECISIONS_SQL.replace("TRACKS", DUCK_TRACKS)
DUCK_PREVIOUS = PREVIOUS_SQL.replace("TRACKS", DUCK_TRACKS)
DUCK_RESPONSES = RESPONSES_SQL.replace("TRACKS", DUCK_TRACKS).replace("JOINED", "string_agg(entry, ', ' ORDER BY pos)").replace("{{", "{").replace("}}", "}")


def _derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("TRACKS", SPARK_TRACKS), **{t: read_table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier")})


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, DECISIONS_SQL)


def previous_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, PREVIOUS_SQL)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = "array_join(transform(array_sort(collect_list(struct(pos, entry))), x -> x.entry), ', ')"
    return _derived(spark, sf_dir, RESPONSES_SQL.replace("JOINED", joined))
