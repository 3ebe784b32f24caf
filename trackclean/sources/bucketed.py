"""Suggestions and decisions as tables in buckets of (root, path), which join without a shuffle.

A bucket is of the track and not of its folder alone, so that a folder of any share of all tracks is in all buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

KEYS = ("root", "path")
#: At 100 TB some thousand; tables that are to be joined need the same number.
BUCKETS = 200


def save(rows: DataFrame, table: str, buckets: int = BUCKETS) -> DataFrame:
    """rows as a table of the session's catalogue, one sorted file a bucket; an earlier one of that name is replaced."""
    dealt = rows.repartition(buckets, *KEYS)
    dealt.write.bucketBy(buckets, *KEYS).sortBy(*KEYS).mode("overwrite").format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)
