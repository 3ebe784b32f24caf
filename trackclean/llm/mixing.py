"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Slot i of the mix is the point frac(i * golden ratio) of the unit interval, which is cut by the sources' cumulative
shares; so in every stretch of slots each source appears as often as its share says, give or take a few. Slots are ranked
within their source, and the r-th slot takes the source's block r (modulo its number of blocks). Blocks are equal
stretches of tokens of the source's documents in a shuffled order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut, join_same

#: Slots of the schedule at least: a power of two, so that a multiple of an odd number visits every cell once. There are
#: twice as many as long as a slot has more than MOST_WORDS words, so that a block's size has a bound.
SLOTS = 1 << 17
MOST_WORDS = 1 << 17
#: Floor of 2**32 divided by the golden ratio: slot i stands at (i * GOLDEN mod 2**32) / 2**32.
GOLDEN = 2654435769
CELLS = 4096
#: Slots are ranked in stretches of so many, so that no task ranks all slots of a source.
STRETCH = 1 << 14
#: A source's documents are dealt into so many buckets by hash, so that a source with most rows is ordered by many tasks.
BUCKETS = 4096
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def row_key(doc_id: Column, source: Column, text: Column) -> Column:
    """A hash of the row's doc_id, source and text."""
    empty = F.lit("")
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), empty), F.lit("|"), F.coalesce(F.md5(source), empty), F.lit("|"), F.coalesce(text, empty)))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, row_key, size (words; null text: 0) and the shuffled place (bucket, key)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    x = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return x.select(
        "doc_id", "source", row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("row_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
    ).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % BUCKETS)


def number_of_slots(words: int) -> int:
    slots = SLOTS
    while words > slots * MOST_WORDS:
        slots *= 2
    return slots


def source_targets(sums: DataFrame) -> DataFrame:
    """(source, source_size) -> weight, share and target of each source.

    All targets together are the words of the corpus. A target that the weights put above MOST_REPEATS times its
    source is held there and the rest shared anew by weight. The fixed point is min(cap, level * weight); the level is
    read off the sources in order of cap / weight, in one pass over this small table.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    whole = W.partitionBy()
    x = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_REPEATS))
    x = x.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("words", F.sum("source_size").over(whole).cast("double"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("left_words", F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.col("left_words") / F.col("left_weight")
    x = x.withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", level.alias("level")))).over(whole)["level"])
    return x.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"), "words")


def schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Slots in order: slot, source, rank (of the slot in its source), take (words), block.

    A source gets the slots whose points fall in its stretch of the cumulative shares. The last slots of a source make
    its words come out at the target: ranks past it are let go, and what is missing is added after the last slot.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    t = targets.filter("source_size > 0").withColumn("share", F.col("target") / F.col("words"))
    t = t.withColumn("hi", F.sum("share").over(order)).withColumn("lo", F.col("hi") - F.col("share"))
    t = t.withColumn("hi", F.when(F.row_number().over(order) == F.count("*").over(whole), F.lit(2.0)).otherwise(F.col("hi")))
    t = t.withColumn("words_long", F.round("target").cast("long"))
    t = t.withColumn("block_size", F.greatest(F.ceil(F.col("words") / slots).cast("long"), F.lit(1)))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_size")).cast("long"))
    t = t.withColumn("full", F.floor(F.col("words_long") / F.col("source_size")).cast("long"))
    t = t.withColumn("rest", F.col("words_long") - F.col("full") * F.col("source_size"))
    t = t.withColumn("ranks", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / F.col("block_size")).cast("long"))
    cells = t.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))).alias("cell"))
    point = (F.col("slot") * F.lit(GOLDEN) % F.lit(1 << 32)) / F.lit(float(1 << 32))
    points = targets.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    got = points.join(cells, "cell").filter("x >= lo and x < hi").select("slot", "source", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    stretches = got.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    ahead = stretches.select("source", "stretch", (F.sum("n").over(W.partitionBy("source").orderBy("stretch")) - F.col("n")).alias("ahead"))
    got = got.withColumn("nth", F.row_number().over(W.partitionBy("source", "stretch").orderBy("slot")) - 1)
    got = join_same(got, ahead, ["source", "stretch"]).select("slot", "source", (F.col("ahead") + F.col("nth")).alias("rank"))
    known = t.select("source", "source_size", "block_size", "blocks", "full", "rest", "ranks")
    had = stretches.groupBy("source").agg(F.sum("n").alias("had"))
    late = join_same(known, had, ["source"], "left").select(
        "source", F.explode(F.sequence(F.coalesce("had", F.lit(0)), F.col("ranks"))).alias("rank")
    ).select((F.lit(slots).cast("long") + F.col("rank")).alias("slot"), "source", "rank")
    both = got.unionByName(late.filter(F.col("rank").isNotNull()))
    placed = join_same(both, known, ["source"]).filter(F.col("rank") < F.col("ranks")).select(
        "slot", "source", "rank", "source_size", "block_size", "blocks", "full", "rest")
    block = F.col("rank") % F.col("blocks")
    size = F.least(F.col("block_size"), F.col("source_size") - block * F.col("block_size"))
    last = F.col("rank") >= F.col("full") * F.col("blocks")
    take = F.when(last, F.least(size, F.col("rest") - block * F.col("block_size"))).otherwise(size)
    return placed.select("slot", "source", "rank", block.alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("turn"), take.alias("take"), "block_size")


def placed_documents(sized: DataFrame) -> DataFrame:
    """Documents with their first word's place in the source's shuffled stream (start) and a row key (bucket, nth).

    Two levels of running sums: over the buckets of a source (a small table), then within a bucket.
    """
    in_order = W.partitionBy("source").orderBy("bucket")
    heads = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    heads = heads.withColumn("head", F.sum("words").over(in_order) - F.col("words")).select("source", "bucket", "head")
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row_key")
    x = sized.withColumn("nth", F.row_number().over(inside)).withColumn("within", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    return join_same(x, heads, ["source", "bucket"]).select("doc_id", "source", "row_key", "size", "bucket", "nth", (F.col("within") + F.col("head")).alias("start"))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents placed in their sources' streams, targets, the mix).

    The mix has a row for each slot and document that it takes words of: slot, source, rank, turn (how often the source
    has been gone through before), bucket, nth (the document's key), row_key, from_word, n_words. Null texts have
    no words and are taken 0 times; null sources are a source of their own, after the others; repeated rows count each;
    other columns are ignored; an empty table gives empty frames. The sources are one small table; their documents are not.
    """
    sized = cut(sized_documents(docs))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sums))
    placed = cut(placed_documents(sized))
    n = number_of_slots(int(targets.select(F.max("words")).first()[0] or 0))
    slots = schedule(targets, n)
    by_block = join_same(placed.filter("size > 0"), targets.select("source", F.greatest(F.ceil(F.col("words") / n).cast("long"), F.lit(1)).alias("b")), ["source"])
    ends = F.col("start") + F.col("size") - 1
    pieces = by_block.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("b")), F.floor(ends / F.col("b")))))
    joined = join_same(pieces, slots, ["source", "block"])
    begin = F.greatest(F.col("start"), F.col("block") * F.col("b"))
    stop = F.least(F.col("start") + F.col("size"), F.col("block") * F.col("b") + F.col("take"))
    out = joined.select("slot", "source", "rank", "turn", "bucket", "nth", "row_key", (begin - F.col("start")).alias("from_word"), (stop - begin).alias("n_words"))
    return placed, targets, out.filter("n_words > 0")


def taken_documents(docs: DataFrame) -> DataFrame:
    """A row for each time that the mix takes a document: row_key, turn, first_slot, words (its first
    ones), bucket, nth. A source's stream is taken from its start on, so that what is left of a document is its end."""
    out = mix(docs)[2]
    keys = ("row_key", "source", "bucket", "nth", "turn")
    return out.groupBy(*keys).agg(F.min("slot").alias("first_slot"), F.sum("n_words").alias("words")).drop("source")


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and n_slots (of the slots that take words of it; null and 0
    where none does) of every document."""
    placed, targets, out = mix(docs)
    taken = out.groupBy("source", "bucket", "nth").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.countDistinct("slot").alias("n_slots"))
    x = join_same(placed, taken, ["source", "bucket", "nth"], "left")
    x = join_same(x, targets.select("source", "source_size", "target"), ["source"])
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.select("doc_id", "size", "source_size", "target", count("taken"), "first_slot", count("n_slots"))
