"""Suffix-array dedup: remove every byte of a LENGTH-byte string that also starts earlier in the corpus.

Every window of LENGTH bytes has an anchor: the leftmost of its SEED-byte strings with the least hash. Equal windows
have equal anchors at equal places, so only texts around one seed need to be compared. Windows of one anchor are a run
of starts, and their bytes are the anchor's context. Contexts that are equal are settled by counting: all but the first
lose every window. Different contexts of one seed are a bucket; each bucket's contexts are put into one suffix array
(linear grouping, see lyndon), in which equal windows are neighbours, and the earliest of them stays.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import shuffle_parts, store
from .lyndon import suffix_arrays
from .shingles import BASE, BASE_INVERSE, BYTE, mix, powers, raw
from .tokens import balanced

LENGTH = 100
SEED = 32
SPAN = LENGTH - SEED + 1
HALF = (LENGTH - SEED) // 2
#: Buckets of more contexts are settled window by window, by grouping on a window's hash: exact at any size.
LARGE = 64
#: Symbols sorted at once.
BATCH = 1 << 21
#: Windows in a stretch of a large bucket's context, at first and after that.
WIDTHS = (23, 6)
#: Bytes of text whose 64-bit hashes are worked out at once.
CACHED = 1 << 18
#: What a batch knows of an anchor's row.
ONE, FIRST, AGAIN, SETTLED = range(4)


def rolling(buf: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width (a power of two) bytes from each place on; void within width of the end."""
    h, n, base = BYTE[buf], 1, 0x9E3779B97F4A7C15
    while n < width:
        h[:-n] = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % (1 << 64), 2 * n
    return mix(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the width values from each place on."""
    y, n = x.copy(), 1
    while 2 * n <= width:
        y[:-n] = np.minimum(y[:-n], y[n:])
        n *= 2
    rest = width - n
    if rest:
        y[:-rest] = np.minimum(y[:-rest], y[rest:])
    return y


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * powers(BASE, len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * powers(BASE_INVERSE, len(sums))[a])


def anchors(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: seed and context hash, text number, first and last start, anchor (in the text)."""
    n = len(buf)
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - (LENGTH - 1), 0)
    window = np.repeat(offsets[:-1] - np.cumsum(starts) + starts, starts) + np.arange(starts.sum())
    if not len(window):
        return dict.fromkeys(("seed", "context", "text", "first", "last", "anchor"), np.empty(0, np.int64))
    h = rolling(buf, SEED)
    least = sliding_least(h, SPAN)[window]
    new = np.ones(len(window), bool)
    new[1:] = (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1)
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], len(window)) - 1
    # the anchor of a run's last window may lie behind it; that of another is the next window of the run that starts with the seed
    tail = window[ends]
    wrong = np.flatnonzero(h[tail] != least[ends])
    while len(wrong):
        tail[wrong] += 1
        wrong = wrong[h[tail[wrong]] != least[ends[wrong]]]
    following = np.where(h[window] == least, np.arange(len(window)), len(window))
    following = np.minimum.accumulate(following[::-1])[::-1]
    size = np.diff(np.append(runs, len(window)))
    inside = following <= np.repeat(ends, size)
    where = np.where(inside, window[np.minimum(following, len(window) - 1)], np.repeat(tail, size))
    new[1:] |= where[1:] != where[:-1]
    at = np.flatnonzero(new)
    seed, first, last, anchor = least[at], window[at], window[np.append(at[1:], len(window)) - 1], where[at]
    text = np.searchsorted(offsets, first, "right") - 1
    context = mix(span_hash(prefix_sums(buf), first, last + LENGTH) ^ ((anchor - first).astype(np.uint64) << np.uint64(32)) ^ (last - first).astype(np.uint64))
    base = offsets[text]
    return {"seed": seed.view(np.int64), "context": context.view(np.int64), "text": text, "first": first - base, "last": last - base, "anchor": anchor - base}


def anchors_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """anchors of a batch's texts, worked out in stretches that stay in a processor's cache."""
    found, first = [], 0
    for part in balanced(batch, "text", CACHED):
        x = anchors(*raw(part.column("text")))
        x["text"] = x["text"] + first
        found.append(x)
        first += part.num_rows
    return {k: np.concatenate([x[k] for x in found]) for k in found[0]}


def anchored(docs: DataFrame) -> DataFrame:
    """seed, context, doc_id, at (of the anchor in the text), before and after (first start and last start, from it), kind.

    kind: SETTLED rows are those that an earlier row of the same batch and context already settles; they need no
    comparing. Of the others, rows whose seed another row of the batch has are AGAIN, but the first of them, which stands
    for them where seeds are counted, is FIRST; the rest are ONE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in balanced(big, "text"):
                x = anchors_of(batch)
                doc = batch.column("doc_id").to_numpy()[x["text"]]
                order = np.argsort(x["context"])
                again = np.zeros(len(order), bool)
                again[1:] = x["context"][order[1:]] == x["context"][order[:-1]]
                again[:-1] |= again[1:]
                some = order[again]
                some = some[np.lexsort((x["anchor"][some], doc[some], x["seed"][some], x["context"][some]))]
                kind = np.zeros(len(order), np.int8)
                settled = some[1:][(x["seed"][some[1:]] == x["seed"][some[:-1]]) & (x["context"][some[1:]] == x["context"][some[:-1]])]
                kind[settled] = SETTLED
                left = np.flatnonzero(kind == ONE)
                left = left[np.argsort(x["seed"][left], kind="stable")]
                same = x["seed"][left[1:]] == x["seed"][left[:-1]]
                kind[left[:-1][same]] = FIRST
                kind[left[1:][same]] = AGAIN
                keep, last = joined_settled(x, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[keep]) for c in (x["seed"], x["context"], doc, x["anchor"])] + [pa.array((x["anchor"] - c)[keep], pa.int32()) for c in (x["first"], last)] + [pa.array(kind[keep])],
                    ["seed", "context", "doc_id", "at", "before", "after", "kind"])

    return docs.mapInArrow(run, "seed long, context long, doc_id long, at long, before int, after int, kind byte")


def joined_settled(x: dict[str, np.ndarray], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stay, last starts): SETTLED rows whose starts follow each other are one, so that a text of one byte again
    and again has few rows."""
    order = np.lexsort((x["first"], x["text"]))
    settled, text = kind[order] == SETTLED, x["text"][order]
    follows = np.zeros(len(order), bool)
    follows[1:] = settled[1:] & settled[:-1] & (text[1:] == text[:-1]) & (x["first"][order][1:] == x["last"][order][:-1] + 1)
    heads = np.flatnonzero(~follows)
    last = x["last"].copy()
    last[order[heads]] = x["last"][order[np.append(heads[1:], len(order))[: len(heads)] - 1]]
    return np.sort(order[heads]), last


def contexts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted rows with their context's bytes, sliced from the documents."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("seed", "context", "at", "before", "after", "kinds")).alias("wanted"))
    schema = "seed long, context long, doc_id long, at long, before int, after int, kinds long, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in balanced(big, "text"):
                rows = []
                for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                    for w in spans:
                        rows.append((w["seed"], w["context"], doc, w["at"], w["before"], w["after"], w["kinds"], text[w["at"] - w["before"] : w["at"] - w["after"] + LENGTH]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seed", "context", "doc_id", "at", "before", "after", "kinds", "bytes"])

    return docs.join(lists, "doc_id").select("doc_id", "text", "wanted").mapInArrow(run, schema)


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes from a on are those from b on, eight at a time."""
    eight = np.ndarray(max(len(text) - 7, 0), "<u8", text.tobytes(), strides=(1,))
    same = np.ones(len(a), bool)
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        same &= eight[a + k] == eight[b + k]
    return same


def later_windows(rows: list[tuple], bounds: list[int]) -> Iterator[tuple[int, int, int]]:
    """(doc_id, first start, last start) of the windows of contexts that are also in an earlier context of their bucket.

    rows: (doc_id, at, before, after, bytes), ordered in each bucket by doc_id and at; bounds: the buckets' first rows,
    then the end. One suffix array for each bucket, of its contexts one after another.
    """
    lengths = np.array([len(r[4]) for r in rows]) + 1
    ends = np.cumsum(lengths)
    text = np.frombuffer(b"\0".join(r[4] for r in rows) + b"\0", np.uint8)
    begins = ends - lengths
    symbols = text.astype(np.int64) + 2
    symbols[ends - 1] = 1
    edge = np.asarray(bounds[1:]) - 1
    symbols[ends[edge] - 1] = 0
    order = suffix_arrays(symbols, np.append(begins[np.asarray(bounds[:-1])], ends[-1]))
    row = np.repeat(np.arange(len(rows)), lengths)
    # only starts whose window is whole; equal windows stand together, as their suffixes share LENGTH bytes
    order = order[order + LENGTH < ends[row[order]]]
    hashes = span_hash(prefix_sums(text), order, order + LENGTH)
    bucket = np.searchsorted(np.asarray(bounds), row[order], "right")
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1])
    maybe = np.flatnonzero(~new)
    new[maybe[~same_bytes(text, order[maybe - 1], order[maybe])]] = True
    kind = np.cumsum(new) - 1
    least = np.full(kind[-1] + 1 if len(kind) else 0, len(rows))
    np.minimum.at(least, kind, row[order])
    late = np.zeros(len(text) + 1, bool)
    late[order[least[kind] < row[order]]] = True
    step = np.diff(late.astype(np.int8), prepend=0)
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
        k = row[a]
        start = rows[k][1] - rows[k][2] - int(begins[k])
        yield rows[k][0], start + a, start + b - 1


def comparable(rows: list[tuple]) -> list[tuple]:
    """A bucket's contexts cut to the windows that another context may have.

    Windows that start HALF bytes before the anchor or earlier share the HALF bytes in front of it, all others the HALF
    bytes behind the seed; a side whose bytes no other context has is left out.
    """
    sides: list[tuple[bytes | None, bytes | None]] = []
    for _, _, before, after, data in rows:
        left = data[before - HALF : before] if before >= HALF else None
        right = data[before + SEED : before + SEED + HALF] if after < HALF else None
        sides.append((left, right))
    lefts, rights = Counter(s[0] for s in sides), Counter(s[1] for s in sides)
    out = []
    for (doc, at, before, after, data), (left, right) in zip(rows, sides, strict=True):
        most = before if left is not None and lefts[left] > 1 else min(before, HALF - 1)
        least = after if right is not None and rights[right] > 1 else max(after, HALF)
        if most >= least:
            out.append((doc, at, most, least, data[before - most : before - least + LENGTH]))
    return out


def settled(buckets: DataFrame) -> DataFrame:
    """doc_id, first, last: runs of window starts that come later than an equal window of their bucket."""

    def emit(rows: list, bounds: list) -> pa.RecordBatch:
        found = list(later_windows(rows, [*bounds, len(rows)])) if rows else []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["doc_id", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        bounds: list[int] = []
        bucket: list[tuple] = []
        seed, held = None, 0

        def close() -> None:
            nonlocal held
            some = comparable(list(dict.fromkeys(bucket)))  # rows of one text that is there several times are one
            if len(some) > 1:
                bounds.append(len(rows))
                rows.extend(some)
                held += sum(len(r[4]) + 1 for r in some)
            bucket.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("seed", "doc_id", "at", "before", "after", "bytes")]
            for s, *row in zip(*columns, strict=True):
                if s != seed:
                    close()
                    if held >= BATCH:
                        yield emit(rows, bounds)
                        rows.clear()
                        bounds.clear()
                        held = 0
                    seed = s
                bucket.append(tuple(row))
        close()
        yield emit(rows, bounds)

    dealt = buckets.repartition(shuffle_parts(buckets.sparkSession), "seed").sortWithinPartitions("seed", "doc_id", "at")
    return dealt.mapInArrow(run, "doc_id long, first long, last long")


def settled_by_window(contexts: DataFrame) -> DataFrame:
    """The same for buckets of any size: each window's hash and place, grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, offsets = raw(batch.column("bytes"))
            sizes = np.diff(offsets) - LENGTH + 1
            k = np.repeat(np.arange(len(sizes)), sizes)
            nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            sums = prefix_sums(buf)
            at = offsets[:-1][k] + nth
            start = (batch.column("at").to_numpy() - batch.column("before").to_numpy())[k] + nth
            yield pa.RecordBatch.from_arrays([pa.array(span_hash(sums, at, at + LENGTH).view(np.int64)), pa.array(batch.column("seed").to_numpy()[k]), pa.array(batch.column("doc_id").to_numpy()[k]), pa.array(start)], ["window", "seed", "doc_id", "start"])

    x = contexts.mapInArrow(run, "window long, seed long, doc_id long, start long")
    least = x.groupBy("window", "seed").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = x.join(least, ["window", "seed"]).filter(F.struct("doc_id", "start") != F.col("least"))
    return late.select("doc_id", F.col("start").alias("first"), F.col("start").alias("last"))


def narrowed(contexts: DataFrame, width: int) -> DataFrame:
    """contexts cut into stretches of at most width windows; the new seed is the bytes that all of a stretch share.

    Equal windows are in equal stretches of one seed, as a window's place is told by its anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("seed", "doc_id", "at", "before", "after", "bytes")]
            for seed, doc, at, before, after, data in zip(*columns, strict=True):
                for part in range(after // width, before // width + 1):
                    most, least = min(before, part * width + width - 1), max(after, part * width)
                    cut = data[before - most : before - least + LENGTH]
                    # what windows at all places of the stretch share, whether or not this context has them all
                    shared = data[max(0, before - part * width) : before - (part * width + width - 1) + LENGTH]
                    hashed = [int.from_bytes(hashlib.blake2b(x, digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little", signed=True) for x in (bytes([part]) + shared, bytes([part, most - least, before - most]) + cut)]
                    rows.append((*hashed, doc, at, most, least, cut))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], ["seed", "context", "doc_id", "at", "before", "after", "bytes"])

    return contexts.mapInArrow(run, "seed long, context long, doc_id long, at long, before int, after int, bytes binary")


def later_than(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id, first, last of all rows of a context but its first."""
    several = firsts.filter("n > 1").select("seed", "context", "one")
    again = rows.join(several, ["seed", "context"]).filter((F.col("doc_id") != F.col("one.doc_id")) | (F.col("at") != F.col("one.at")))
    return runs_of(again)


def runs_of(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", (F.col("at") - F.col("before")).alias("first"), (F.col("at") - F.col("after")).alias("last"))


def settled_large(contexts: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The same as settled for buckets of any size: contexts are cut into stretches, which fall into smaller buckets, and
    equal stretches are settled by counting. Buckets still too large are cut into shorter stretches, and in the end
    settled window by window."""
    rows = store(narrowed(contexts.select("seed", "doc_id", "at", "before", "after", "bytes"), widths[0]))
    place = F.struct("doc_id", "at", "before", "after")
    firsts = store(rows.groupBy("seed", "context").agg(F.min(place).alias("one"), F.min_by("bytes", place).alias("bytes"), F.count("*").alias("n")))
    kinds = store(firsts.groupBy("seed").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    left = firsts.join(kinds, "seed").select("seed", "one.*", "bytes", "kinds")
    large = left.filter(F.col("kinds") > 4 * LARGE)
    rest = settled_large(large, widths[1:]) if len(widths) > 1 else settled_by_window(large)
    return later_than(rows, firsts).unionByName(settled(left.filter(F.col("kinds") <= 4 * LARGE))).unionByName(rest)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """docs: doc_id (not null), text (not null). Runs of starts (doc_id, first, last) of windows that also start earlier.

    Of rows that share a doc_id, equal texts are one document. Seeds are counted over all batches by the rows that are ONE
    or FIRST, so that a seed of a great share of the texts has a row for each batch where it is counted.
    """
    counted = F.col("kind") <= FIRST
    apart = F.when(counted, F.col("seed")).otherwise(F.xxhash64("doc_id", "at"))
    found = anchored(docs).withColumn("n", F.count("*").over(W.partitionBy(counted, apart)))
    every = store(found.filter(f"kind > {ONE} or n > 1").drop("n"))
    often = every.filter(F.col("kind") < SETTLED).drop("kind")
    place = F.struct("doc_id", "at", "before", "after")
    firsts = store(often.groupBy("seed", "context").agg(F.min(place).alias("one"), F.count("*").alias("n")))
    whole = runs_of(every.filter(F.col("kind") == SETTLED)).unionByName(later_than(often, firsts))
    kinds = store(firsts.groupBy("seed").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    wanted = firsts.join(kinds, "seed").select("seed", "context", "one.*", "kinds")
    contexts = store(contexts_of(wanted, docs))
    small = settled(contexts.filter(F.col("kinds") <= LARGE))
    large = settled_large(contexts.filter(F.col("kinds") > LARGE))
    return whole.unionByName(small).unionByName(large)


def with_rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, not null, text and others) with row: the doc_id, or where doc_ids have several texts, numbers that
    rise with doc_id and text, one for each text of a doc_id."""
    key = F.xxhash64("text")
    shared = docs.groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).filter("x <> y")
    if shared.isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    keyed = docs.withColumn("key", F.sha2("text", 256))
    rows = keyed.select("doc_id", "key").distinct().repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id", "key").sortWithinPartitions("doc_id", "key")
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()))
    return keyed.join(rows, ["doc_id", "key"]).drop("key")


def remove_repeats(docs: DataFrame, texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs' rows with what is left of their texts.

    doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the text that is left, without what a cut
    leaves of a character; kept_sha256 is of all bytes left) and the columns in carry. Matches are bytewise, lie within
    one text, and overlap. Null and empty texts and
    those shorter than LENGTH lose nothing; of equal texts the one of the smallest doc_id stays; different texts that
    share a doc_id are documents of their own, in the order of their hashes, and equal ones one document (equal rows fare
    alike); null doc_ids are not compared and lose nothing; other columns are ignored.
    """
    carried = docs.select(*carry).schema
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0), *carry).alias("carried"))
    known = with_rows(docs.filter("doc_id is not null"))
    runs = repeated_windows(known.select(F.col("row").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("row")).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts)
    schema = T.StructType([*schema.fields, *carried.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in balanced(big, "text"):
                rows = []
                for doc, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                    gone, spans, kept, at = 0, 0, [], 0
                    end = -1
                    for first, last in sorted((r["first"], min(r["last"] + LENGTH, len(text))) for r in runs or ()):
                        if first > end:
                            if end >= 0:
                                kept.append(text[at:begin])
                                gone, spans, at = gone + end - begin, spans + 1, end
                            begin, end = first, last
                        else:
                            end = max(end, last)
                    if end >= 0:
                        kept.append(text[at:begin])
                        gone, spans, at = gone + end - begin, spans + 1, end
                    kept.append(text[at:])
                    whole = "".join(part.decode("utf-8", "ignore") for part in kept) if texts else None
                    rows.append((doc, len(text), gone, spans, hashlib.sha256(b"".join(kept)).hexdigest(), whole)[: 5 + texts])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                others = batch.column("carried").flatten()[1:]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)] + others
                yield pa.RecordBatch.from_arrays(columns, [*["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts], *carry])

    alone = docs.filter("doc_id is null").withColumn("runs", F.lit(None).cast("array<struct<first:long,last:long>>"))
    return known.join(runs, "row", "left").drop("row").unionByName(alone).select("doc_id", "text", "runs", "carried").mapInArrow(run, schema)
