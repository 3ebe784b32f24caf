"""Places in an ordered group, for groups of any size.

A window puts a group into one task. So the rows of a large group are cut into parts by ranges of the order, at bounds from
a sample, and ranked in their parts; what the parts before hold is added. The parts are rows of a small table: as many for a
group as its bounds, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a part, about; groups of no more are one part.
LARGE = 1_000_000
#: Bounds of a group at most, and sampled rows for each of them.
MOST_PARTS = 1024
SAMPLED = 8


def large_groups(rows: DataFrame, group: str, large: int = LARGE) -> DataFrame:
    """of, size: the groups of more than large rows."""
    return rows.groupBy(F.col(group).alias("of")).agg(F.count("*").alias("size")).filter(F.col("size") > large)


def with_parts(rows: DataFrame, sizes: DataFrame, group: str, order: list[Column], large: int = LARGE) -> DataFrame:
    """rows with part: 0, or in the groups of sizes (large_groups) the number of bounds that a row is not before.

    Bounds are of a sample by the hash of the order, so they come out alike when they are worked out again. Rows equal in
    order are of one part.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("size") / large)).cast("int")
    sample = rows.select(F.col(group).alias("of"), key.alias("key")).join(sizes.select("of", "size", parts.alias("parts")), "of")
    sample = sample.filter(F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.floor(F.col("size") / (F.col("parts") * SAMPLED)))) == 0)
    kept = sample.groupBy("of").agg(F.first("parts").alias("parts"), F.array_sort(F.collect_list("key")).alias("keys"))
    every = F.greatest(F.lit(1), F.floor(F.size("keys") / F.col("parts")).cast("int"))
    bounds = kept.select("of", F.filter("keys", lambda k, i: (i > 0) & (i % every == 0)).alias("bounds"))
    x = rows.join(bounds, F.col(group).eqNullSafe(F.col("of")), "left").withColumn("__key", key)
    return x.withColumn("part", F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col("__key"))), F.lit(0))).drop("of", "bounds", "__key")


def ranked(rows: DataFrame, group: str, order: list[Column], large: int = LARGE) -> DataFrame:
    """rows with pos (from 0, in order) and n (rows of the group). Null groups are one group."""
    sizes = large_groups(rows, group, large)
    some = not sizes.isEmpty()
    x = with_parts(rows, sizes, group, order, large) if some else rows.withColumn("part", F.lit(0))
    parts = x
    part = W.partitionBy(group, "part")
    x = x.withColumn("pos", F.row_number().over(part.orderBy(*order)) - 1).withColumn("n", F.count("*").over(part))
    if not some:
        return x.drop("part")
    whole = W.partitionBy("of")
    held = parts.groupBy(F.col(group).alias("of"), F.col("part").alias("of_part")).agg(F.count("*").alias("k"))
    held = held.withColumn("before", F.sum("k").over(whole.orderBy("of_part")) - F.col("k")).withColumn("total", F.sum("k").over(whole))
    held = held.filter(F.col("total") > large).drop("k")
    x = x.join(held, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")), "left")
    x = x.withColumn("pos", (F.col("pos") + F.coalesce("before", F.lit(0))).cast("int")).withColumn("n", F.coalesce("total", "n"))
    return x.drop("part", "of", "of_part", "before", "total")
