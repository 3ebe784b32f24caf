"""What the corpus operators share: white space, scratch space, repartitioning by size."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import own_tables, store
from ..stored import shared_folder as ensure_checkpoint_dir

__all__ = ["WORD", "WORD_BYTES", "cut", "ensure_checkpoint_dir", "join_same", "lower_ascii", "own_tables", "read_table", "shuffle_parts", "store"]

#: A word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Python workers are told where this package is, for where it is not installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Small tables are cut the same way as large ones are stored.
cut = store


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, null equal to null; the left side's columns stay."""
    for k in keys:
        b = b.withColumnRenamed(k, f"__{k}")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(b, on, how).drop(*[f"__{k}" for k in keys])
