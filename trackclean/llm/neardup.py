"""MinHash near-dedup: fast similarity sketches, banding, exact verification, connected components.

Sketches are those of rounds of hashed bins: in round i every element is thrown into a bin, and a bin keeps the least
(round, hash) it has seen; rounds go on until every bin is filled, and from round COORDINATES on round i throws all into
bin i - COORDINATES, so that none stays empty. Coordinates of two sets agree with the probability of their similarity,
with the concentration of independent trials, in time linear in the set for all but small sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import cut, shuffle_parts, store
from .components import components
from .shingles import mix, shingle_sets
from .tokens import balanced

WIDTH = 5
#: At similarity 0.75 a band of 4 rows agrees with probability 0.32, so 32 bands miss a pair once in 190,000.
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Links need 100 * intersection >= SHARE * union.
SHARE = 75
#: Pairs of one pivot that are checked together; shingles of the sets that an index holds; sets streamed past it at once.
CHUNK = 256
INDEXED = 1 << 20
STREAMED = 1024


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of coordinates for each set; the empty set's are all ones."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * coordinates, full, np.uint64)
    left = np.flatnonzero([len(s) > 0 for s in sets])
    for i in range(2 * coordinates):
        if not len(left):
            break
        values = np.concatenate([sets[k] for k in left])
        row = np.repeat(left * coordinates, [len(sets[k]) for k in left])
        h = mix(values + np.uint64((i + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        bins = (h % np.uint64(coordinates)).astype(np.int64) if i < coordinates else np.int64(i - coordinates)
        # the round in the top byte: what an earlier round has put into a bin stays
        np.minimum.at(out, row + bins, (h >> np.uint64(9)) | (np.uint64(i) << np.uint64(55)))
        left = left[(out.reshape(-1, coordinates)[left] == full).any(axis=1)]
    return out.reshape(-1, coordinates)


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    """A row of BANDS hashes for each sketch; the band's number is part of the hash."""
    x = sketch.reshape(len(sketch), BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        out = mix(out ^ x[:, :, r])
    return out


def described(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text and perhaps text_key. doc_id, text_key, text_hash, n_shingles, set_key (a 128-bit hash of the
    set), bands."""
    extra = ["text_hash", *[c for c in docs.columns if c == "text_key"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in balanced(big, "text"):
                sets = shingle_sets(batch.column("text"), WIDTH)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band_hashes(sketches(sets)).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), set_keys(batch.column("text"), sets), bands]
                yield pa.RecordBatch.from_arrays([*columns, *map(batch.column, extra)], ["doc_id", "n_shingles", "set_key", "bands", *extra])

    kinds = ", text_hash long" + ", text_key string" * (len(extra) - 1)
    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>" + kinds)


def set_keys(column: pa.Array, sets: list[np.ndarray]) -> pa.Array:
    """A 128-bit hash of each set; of a set of one shingle by the words themselves, so that short texts differ for sure."""
    few = np.flatnonzero([len(s) == 1 for s in sets])
    other = iter(shingle_sets(column.take(pa.array(few)), WIDTH, 1)) if len(few) else iter(())
    return pa.array([xxh3_128_digest(s.tobytes() + (next(other).tobytes() if len(s) == 1 else b"")) for s in sets], pa.binary())


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose texts' full sets are similar enough. texts: node, text.

    The pairs of one a are dealt in chunks of about CHUNK, each with one copy of a's text, and streamed past it. Sets are
    of the other half of the words' hashes than the bands, so that a link needs 128 bits to agree.
    """
    counts = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks")))
    x = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    members = x.join(texts.withColumnRenamed("node", "b"), "b").select("a", "chunk", F.lit(1).alias("role"), "b", "text")
    pivots = x.select("a", "chunk").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, of = None, None
        for big in batches:
            for batch in balanced(big, "text"):
                found: list[tuple[int, int]] = []
                keys = zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "role", "b")), strict=True)
                for (a, chunk, role, b), s in zip(keys, shingle_sets(batch.column("text"), WIDTH, 1), strict=True):
                    if role == 0:
                        pivot, of = s, (a, chunk)
                        continue
                    assert (a, chunk) == of
                    same = len(np.intersect1d(pivot, s, assume_unique=True))
                    if 100 * same >= SHARE * (len(pivot) + len(s) - same):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    rows = members.unionByName(pivots).repartition(shuffle_parts(pairs.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", "role", "b")
    return rows.mapInArrow(run, "a long, b long")


class Held:
    """Sets held in a task, as an inverted index that tells which of them another set is similar to.

    Of a set of s elements only the s - ceil(SHARE * s / 100) + 1 that the fewest held sets have are looked for: a similar
    set has SHARE hundredths of its elements, so it cannot lack them all. What many sets share, such as a passage, makes no
    candidates then. Candidates are counted on full sets.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        distinct, nth, count = np.unique(values, return_inverse=True, return_counts=True)
        first = np.cumsum(self.sizes) - self.sizes
        order = np.lexsort((nth, count[nth], owners))
        rank = np.arange(len(values)) - first[owners]  # owners are in order, so ranks by place are ranks by rarity
        looked = self.sizes - -(-SHARE * self.sizes // 100) + 1
        rare = order[rank < looked[owners]]
        self.all = self._index(values, owners)
        self.rare = self._index(values[rare], owners[rare])

    @staticmethod
    def _index(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(values, kind="stable")
        return values[order], owners[order]

    def _hits(self, index: tuple[np.ndarray, np.ndarray], s: np.ndarray) -> np.ndarray:
        """How many elements of s each held set has in the index."""
        keys, owners = index
        first, last = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
        count = last - first
        first, count = first[count > 0], count[count > 0]
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(owners[at], minlength=len(self.sizes))

    def candidates(self, s: np.ndarray) -> np.ndarray:
        """Held sets of a fitting size that have one of their rare elements in s: all that s is similar to are among them."""
        fits = 100 * np.minimum(self.sizes, len(s)) >= SHARE * np.maximum(self.sizes, len(s))
        return np.flatnonzero(fits & (self._hits(self.rare, s) > 0))

    def similar(self, s: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Of some held sets those that s is similar to."""
        same = self._hits(self.all, s)[among]
        return among[100 * same >= SHARE * (self.sizes[among] + len(s) - same)]


def linked_across(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows: band, node, n_shingles, component. The links (a, b) between members of one band in different components.

    Members outside their band's largest component are dealt in chunks of about INDEXED shingles, whose full sets become
    one inverted index; all members, dealt in parts of about STREAMED, are streamed past it. Pairs are counted, not
    made: only links come out, of two components one for each task at least.
    """
    sizes = rows.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"))
    home = cut(sizes.groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("home"),
        F.ceil((F.sum("held") - F.max_by("held", F.struct("n", "component"))) / INDEXED).cast("long").alias("chunks"),
        F.ceil(F.sum("n") / STREAMED).cast("long").alias("parts")).filter("chunks > 0"))
    x = rows.join(home, "band").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    few = x.filter("component <> home").select("band", "chunk", each("parts").alias("part"), F.lit(0).alias("role"), "node", "component")
    every = x.select("band", each("chunks").alias("chunk"), "part", F.lit(1).alias("role"), "node", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, places, known = None, [], None, None, set()
        for big in batches:
            for batch in balanced(big, "text"):
                columns = [batch.column(c).to_pylist() for c in ("band", "chunk", "part", "role", "node", "component")]
                found: list[tuple[int, int]] = []
                for band, chunk, part, role, node, component, s in zip(*columns, shingle_sets(batch.column("text"), WIDTH, 1), strict=True):
                    if (band, chunk, part) != at:
                        at, held, index = (band, chunk, part), [], None
                        known.clear()
                    if role == 0:
                        held.append((node, component, s))
                        continue
                    if index is None:
                        index, places = Held([h[2] for h in held]), np.array([h[1] for h in held])
                    maybe = index.candidates(s)
                    linked = [c for c in np.unique(places[maybe]).tolist() if c == component or (min(c, component), max(c, component)) in known]
                    maybe = maybe[~np.isin(places[maybe], linked)]
                    for k in index.similar(s, maybe).tolist() if len(maybe) else ():
                        other, c, _ = held[k]
                        if (both := (min(c, component), max(c, component))) not in known:
                            known.add(both)
                            found.append((min(node, other), max(node, other)))
                    if len(known) > 1_000_000:
                        known.clear()
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    dealt = few.unionByName(every).join(texts, "node")
    dealt = dealt.repartition(shuffle_parts(rows.sparkSession), "band", "chunk", "part").sortWithinPartitions("band", "chunk", "part", "role")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """docs: doc_id, text; nodes: node, doc_id, text_hash. node and text: one text of each node's set.

    Rows are found by doc_id and text, so that rows that share a doc_id, however many, do not meet each other.
    """
    found = docs.withColumn("text_hash", F.xxhash64("text")).join(nodes, ["doc_id", "text_hash"])
    return found.select("node", "text").dropDuplicates(["node"])


def joined_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """node, component when found (node, component) gets more links (a, b): the links of components are settled, which are few."""
    to = lambda end, name: found.select(F.col("node").alias(end), F.col("component").alias(name))
    x = more.join(to("a", "x"), "a", "left").join(to("b", "y"), "b", "left").select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    x = cut(x)
    links = x.select(F.col("x").alias("a"), F.col("y").alias("b"))
    into = components(links).select(F.col("node").alias("of"), F.col("component").alias("into"))
    alone = x.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("component")), F.struct(F.col("b").alias("node"), F.col("y").alias("component")))).alias("e")).select("e.*").distinct()
    every = found.unionByName(alone.join(found, "node", "left_anti"))
    return every.join(into, F.col("component") == F.col("of"), "left").select("node", F.coalesce("into", "component").alias("component"))


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id (long), text (not null) and perhaps text_key. (every row described, set_key with label and component_id).

    Texts of one shingle set are one class, and classes are the nodes, by numbers of their own. Classes that share a band
    are a bucket. Each bucket's pivot, its smallest node, is checked against the others on full sets; where members are
    still in different components, pairs across components are counted too. So no pair within a component is ever made.
    """
    every = store(described(docs))
    some = every.filter("n_shingles > 0 and doc_id is not null")
    sets = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = store(sets.select("set_key", F.col("least.doc_id").alias("least"), "least.text_hash", "n_shingles", "bands", F.monotonically_increasing_id().alias("node")))
    rows = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    buckets = cut(rows.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).filter("pivot < other").select("band", "pivot"))
    held = store(rows.join(buckets, "band").select("band", "node", "n_shingles", "pivot"))
    wanted = classes.join(held.select("node").distinct(), "node", "left_semi").select("node", F.col("least").alias("doc_id"), "text_hash")
    texts = store(texts_of(docs.select("doc_id", "text"), wanted))
    links = cut(verified(held.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), texts))
    found = components(links)
    place = held.filter("node <> pivot").join(found, "node", "left").select("band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    place = cut(place)
    open_bands = cut(place.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("band"))
    more = cut(linked_across(place.join(open_bands, "band"), texts))
    if not more.isEmpty():
        found = joined_components(found, more)
    label = classes.select("node", "set_key", "least").join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
    linked = label.filter("component is not null").groupBy("label").agg(F.min("least").alias("first"))
    label = label.join(linked, "label", "left").select("set_key", "label", F.coalesce("first", "least").alias("component_id"))
    return every, cut(label)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null and empty texts have no set and are linked with nothing (component_id: their own doc_id); texts of fewer than
    WIDTH words have one shingle, the whole; rows of one doc_id are rows of their own, so with different texts they may be
    in different components; null doc_ids make no links and have a null component_id; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every, label = labelled(docs)
    out = every.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(label, "set_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame) -> DataFrame:
    """doc_id and text_key (MD5) of the texts that stay, one of each component: the least doc_id, then the least key.

    Texts without a word all stay. Null doc_ids are not looked at.
    """
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every, label = labelled(docs.withColumn("text_key", F.md5("text")))
    joined = every.filter("n_shingles > 0").select("doc_id", "text_key", "set_key").join(label.select("set_key", "label"), "set_key")
    first = joined.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    return first.unionByName(every.filter("n_shingles = 0").select("doc_id", "text_key").distinct())
