"""Merkle manifest of documents: a node store of levels on disk, proofs by coordinate, and a check of altered texts.

A language's leaves are numbered in order by a range partitioning and the prefix sums of its parts. Runs of 4,096 leaves are
streamed, each through one task that writes the run's nodes of the next four levels, a folder of Parquet for each level; the
last of these are the leaves of the next pass. Proofs come down the same way: a run's levels are merged by coordinate with
what the levels above the run have found. A task holds one run, whatever the size of a tree.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, lower_ascii, shuffle_parts, store

#: Nodes that become one, and levels of a pass.
ARITY = 8
BITS = 3
LEVELS = 4
#: Documents whose doc_id's CRC-32 this divides are altered.
ALTERED = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "tree string, height int, level int, pos long, hash string"
PAIR = "array<struct<left:string,right:string>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(**instead: Column) -> Column:
    """SHA-256 of a row's fields, each with its length, or those given instead."""
    said = []
    for name in FIELDS:
        c = instead.get(name, F.col(name)).cast("string")
        said.append(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)))
    return F.sha2(F.concat(*said), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (lang), doc_id, hash, tampered (the hash with the text in lower case, of altered documents)."""
    altered = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(ALTERED)) == 0
    docs = docs.select(*[F.col(f) for f in FIELDS])
    return docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash().alias("hash"), F.when(altered, leaf_hash(text=lower_ascii(F.col("text")))).alias("tampered"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree and others) with pos, their place in their tree by order, from 0, and the tree's height.

    Rows are sorted by ranges, so that a tree of any share of all rows is in many tasks. Rows that are equal in order are
    told apart by the place they were read at, so that no range is theirs alone.
    """
    keys = ["tree", *order, "read_at"]
    x = rows.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(shuffle_parts(rows.sparkSession), *keys)
    x = store(x.sortWithinPartitions(*keys).drop("read_at").withColumn("nth", F.monotonically_increasing_id()))
    part = F.shiftright("nth", 33)
    sizes = x.groupBy("tree", part.alias("part")).agg(F.count("*").alias("k"), F.min("nth").alias("first"))
    tree = W.partitionBy("tree")
    sizes = sizes.withColumn("before", F.sum("k").over(tree.orderBy("part")) - F.col("k")).withColumn("n", F.sum("k").over(tree))
    height = F.lit(0)
    for k in range(21):
        height = F.when(F.col("n") > ARITY**k, k + 1).otherwise(height)
    sizes = store(sizes.select(F.col("tree").alias("of"), "part", "first", "before", height.alias("height")))
    x = x.join(sizes, F.col("tree").eqNullSafe(F.col("of")) & (part == F.col("part")))
    return store(x.withColumn("pos", F.col("nth") - F.col("first") + F.col("before")).drop("of", "part", "first", "before", "nth"))


def run_of(levels: int) -> Column:
    return F.shiftright("pos", BITS * levels)


def in_runs(rows: DataFrame) -> DataFrame:
    """rows with run (of the pass), dealt by tree and run, each run's levels from the highest, in the order of pos."""
    dealt = rows.repartition(shuffle_parts(rows.sparkSession), "tree", "run")
    return dealt.sortWithinPartitions("tree", "run", F.desc("level"), "pos")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each run, one run after another."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["run"]) != (held[0]["tree"], held[0]["run"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def built(nodes: DataFrame) -> tuple[str, int]:
    """The node store of numbered nodes (tree, height, pos, hash): its folder, which has level=1 and on, and its height."""
    spark = nodes.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/nodes-{uuid.uuid4().hex}"
    top = nodes.agg(F.max("height")).first()[0] or 0
    schema = pa.schema([("tree", pa.string()), ("height", pa.int32()), ("level", pa.int32()), ("pos", pa.int64()), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            tree, height, level, base = rows[0]["tree"], rows[0]["height"], rows[0]["level"], rows[0]["pos"]
            hashes, out = [r["hash"] for r in rows], []
            for up in range(level + 1, min(level + LEVELS, height) + 1):
                hashes = [digest(hashes[k : k + ARITY]) for k in range(0, len(hashes), ARITY)]
                base //= ARITY
                out += [(tree, height, up, base + k, h) for k, h in enumerate(hashes)]
            yield frame(out, schema)

    at = nodes.withColumn("level", F.lit(0))
    for level in range(0, top, LEVELS):
        rows = at.filter(F.col("height") > level).select("tree", "height", "level", "pos", "hash", run_of(LEVELS).alias("run"))
        in_runs(rows).mapInArrow(run, NODE).write.mode("append").partitionBy("level").parquet(folder)
        at = stored_nodes(spark, folder, level + LEVELS, level + LEVELS)
    return folder, top


def stored_nodes(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """Nodes of the levels from low to high; only their folders are read."""
    return spark.read.schema(NODE).parquet(folder).filter(F.col("level").between(low, high)).select("tree", "height", "level", "pos", "hash")


def tops(nodes: DataFrame, folder: str, height: int) -> DataFrame:
    """tree, hash of each tree's one last node."""
    alone = nodes.filter("height = 0").select("tree", "hash")
    return alone.unionByName(stored_nodes(nodes.sparkSession, folder, 1, height).filter("level = height").select("tree", "hash")) if height else alone


def siblings(rows: list[dict], level: int) -> Iterator[tuple[dict, list[tuple[str, str]]]]:
    """A run's rows -> each row of the level with the hashes to the left and right of its path, from below."""
    above = [(p["left"], p["right"]) for r in rows if r["upper"] is not None for p in r["upper"]]
    by_level: dict[int, list[dict]] = {}
    for r in rows:
        if r["upper"] is None:
            by_level.setdefault(r["level"], []).append(r)
    known: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def path(at: int, place: int) -> list[tuple[str, str]]:
        """place: of a node of level at, among the run's nodes of that level."""
        if at not in by_level or at == by_level[at][0]["height"]:
            return above
        if (at, place) not in known:
            first = place // ARITY * ARITY
            hashes = [x["hash"] for x in by_level[at][first : first + ARITY]]
            mine = "".join(hashes[: place - first]), "".join(hashes[place - first + 1 :])
            known[at, place] = [mine, *path(at + 1, place // ARITY)]
        return known[at, place]

    for k, r in enumerate(by_level.get(level, [])):
        yield r, path(level, k)


def paths(nodes: DataFrame, folder: str, top: int, uppers: DataFrame) -> DataFrame:
    """tree, run, level, upper, subroot, root: what the levels above each run of leaves have found, and rows of the leaves
    and of the nodes between. uppers: tree, upper (beyond the tree), subroot, root."""
    spark = nodes.sparkSession
    found = uppers.sparkSession.createDataFrame([], f"tree string, run long, upper {PAIR}, subroot string, root string")
    schema = pa.schema([("tree", pa.string()), ("run", pa.int64()), ("upper", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.string()), ("root", pa.string())])

    def down(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in grouped(batches):
                ends = next(r for r in rows if r["upper"] is not None)
                out = [(r["tree"], r["pos"], [{"left": a, "right": b} for a, b in path], ends["subroot"], ends["root"]) for r, path in siblings(rows, level)]
                yield frame(out, schema)

        return run

    heights = nodes.filter("pos = 0").select(F.col("tree").alias("of"), "height")
    for level in reversed(range(0, max(top, 1), LEVELS)):
        # trees that end within this pass come in from beyond
        enter = heights.filter((F.col("height") <= level + LEVELS) & ((F.col("height") > level) | F.lit(level == 0)))
        new = uppers.join(enter, F.col("tree").eqNullSafe(F.col("of"))).select("tree", F.lit(0).cast("long").alias("run"), "upper", "subroot", "root")
        found = store(found.unionByName(new))
        inner = stored_nodes(spark, folder, max(level, 1), level + LEVELS - 1) if top else None
        if level == 0:
            own = nodes.withColumn("level", F.lit(0)).withColumn("run", run_of(LEVELS))
        else:
            own = inner.filter(F.col("level") == level).withColumn("run", run_of(LEVELS))
        between = inner.filter(F.col("level") > level).withColumn("run", F.expr(f"shiftright(pos, {BITS} * ({level + LEVELS} - level))")) if top else None
        rows = found.withColumn("level", F.lit(1 << 20)).unionByName(own, allowMissingColumns=True)
        rows = rows.unionByName(between, allowMissingColumns=True) if top else rows
        if level == 0:
            return rows
        # trees of this height or less have no run here
        rows = rows.filter(F.col("height").isNull() | (F.col("height") > level))
        found = in_runs(rows).mapInArrow(down(level), f"tree string, run long, upper {PAIR}, subroot string, root string")
    raise AssertionError


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Nulls are said as "-", empty texts as "0:"; rows that share a doc_id are ordered by their leaves, equal rows are leaves
    each (equal but for their proofs); a null doc_id comes first in its language and counts as an empty one where it is asked
    whether a row is altered; extra columns are ignored; an empty table gives an empty frame.
    """
    spark = docs.sparkSession
    low = numbered(leaves(docs), "doc_id", "hash")
    folder, height = built(low)
    roots = tops(low, folder, height)
    high = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "hash"), "lang")
    high_folder, high_height = built(high)
    root = tops(high, high_folder, high_height).select("tree", F.array().cast(PAIR).alias("upper"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    fields = pa.schema([("tree", pa.string()), ("upper", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.string()), ("root", pa.string())])

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            ends = next(r for r in rows if r["upper"] is not None)
            yield frame([(r["lang"], [{"left": a, "right": b} for a, b in path], r["hash"], ends["root"]) for r, path in siblings(rows, 0)], fields)

    uppers = store(in_runs(paths(high, high_folder, high_height, root)).mapInArrow(beyond, f"tree string, upper {PAIR}, subroot string, root string"))
    out = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            ends, answers = next(r for r in rows if r["upper"] is not None), []
            for r, path in siblings(rows, 0):
                h = r["tampered"] or r["hash"]
                for left, right in path:
                    h = digest([left, h, right])
                answers.append((r["doc_id"], r["hash"], ends["subroot"], ends["root"], digest([x for pair in path for x in pair]), h, h == ends["root"]))
            yield frame(answers, out)

    fields_out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return in_runs(paths(low, folder, height, uppers)).mapInArrow(checked, fields_out)
