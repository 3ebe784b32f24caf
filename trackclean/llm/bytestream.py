"""LM scoring of whole texts by context-tree weighting: contexts run on over the space into the words before.

A text is one stream of bytes: each word's, then a space; at the end a line feed. A byte's context is the DEPTH bytes
before it in the stream, whichever words they are in; in front of a text there is a space, and zeros before that. Nodes,
estimates and mixing are those of ctw.

Blocks of documents count their distinct (context, byte) pairs and ask for the pairs' chances; the tree is split by the
last two bytes of context. Asks and answers are sorted arrays, one for each block and branch, so that a pair takes a few
bytes on disk. Every group has a bound: a block its bytes of text, a branch's sums JOINED rows at once and its answers
those of JOINED blocks. What is sent to all tasks is the top of the tree, of 256 * 255 nodes at most. Long texts are coded
in pieces, each of which starts with the last bytes of the stream before it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import shuffle_parts, store
from .ctw import DEPTH, branch_top, log10_chances, top_of_tree
from .shingles import BYTE, LOWER, SPACE, distinct_words, mix, raw, word_spans
from .tokens import balanced

GAP, STOP = 0x20, 0x0A
END = bytes([STOP])
#: About so many bytes of text are a block of documents, so many a row of packed texts.
BLOCK_BYTES = 32 << 20
SLICE_BYTES = 1 << 19
#: A long text is coded in pieces of about so many bytes, cut behind white space; a longer word is a piece of its own.
PIECE_BYTES = 1 << 20
#: What stands in front of a text.
LEAD = bytes(DEPTH - 1) + bytes([GAP])
#: So many bytes' keys are sorted at once; so many pairs or words, or a quarter as many as there are sums, are gathered before
#: equal ones are added up. Sums are arrays of about so many keys, which are added to one after another.
SORTED = 1 << 20
PENDING = 500_000
CHUNK = 1 << 16
#: Words of a block's asks that are handed over at once.
HANDED = 1 << 16
#: Words of so many bytes at most are hashed together.
SHORT = 64
#: Branches of the tree for each partition of a shuffle; blocks whose asks of a branch are taken together.
BRANCHES = 4
JOINED = 512
#: A key's last two bytes of context, by which the tree is split, stand above so many bits.
ABOVE = 8 * (DEPTH - 1)
#: What a block asks for.
ASKS = pa.schema([("block", pa.int64()), ("seed", pa.int32()), ("hash", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("branch", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def is_held_out(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def packed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) as rows of many documents: their lower-cased texts are compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        names = ["doc_id", "held_out", "sizes", "texts"]
        kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())
        for big in batches:
            for batch in balanced(big, "text", SLICE_BYTES):
                buf, offsets = raw(batch.column("text"))
                row = (batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), np.diff(offsets), pack.compress(LOWER[buf].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    return docs.mapInArrow(run, "doc_id array<long>, held_out array<boolean>, sizes array<long>, texts binary")


def unpacked(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, held_out, bytes, offsets) of each row."""
    unpack = zstandard.ZstdDecompressor()
    for i in range(table.num_rows):
        doc, held, sizes, texts = (table.column(c)[i].as_py() for c in ("doc_id", "held_out", "sizes", "texts"))
        buf = np.frombuffer(unpack.decompress(texts, max_output_size=max(sum(sizes), 1)), np.uint8)
        yield doc, np.array(held, bool), buf, np.append(0, np.cumsum(sizes)).astype(np.int64)


def cut_pieces(buf: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(number of the first text, bytes, offsets, whether texts end there): all texts, or each one in pieces of its own."""
    if len(buf) <= most:
        yield 0, buf, offsets, True
        return
    for i, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while True:
            stop = at + most
            while stop < end and not (space := np.flatnonzero(SPACE[buf[stop : min(stop + (1 << 16), end)]])).size:
                stop += 1 << 16
            stop = stop + int(space[0]) + 1 if stop < end else end
            yield i, buf[at:stop], np.array([0, stop - at]), stop == end
            if stop == end:
                break
            at = stop


def coded_pieces(buf: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets, keys, each key's text number) of the texts' pieces, in order."""
    lead = LEAD
    for first, part, within, last in cut_pieces(buf, offsets, most):
        coded = [*stream_keys(part, within, lead, last)]
        lead = LEAD if last else coded[2]
        yield first, part, within, coded.pop(0), coded.pop(0)  # nothing is kept of them here


def stream_keys(buf: np.ndarray, offsets: np.ndarray, lead: bytes = LEAD, last: bool = True) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(key, text number) of each byte of the texts' streams, and the last DEPTH bytes of them. last: the texts end here."""
    starts, ends, text = word_spans(buf, offsets)
    size, texts = ends - starts, len(offsets) - 1
    ahead = np.cumsum(size) - size + np.arange(len(size)) + (DEPTH + last) * text + DEPTH
    words = np.bincount(text, minlength=texts)
    length = np.bincount(text, weights=size, minlength=texts).astype(np.int64) + words + DEPTH + last
    stop = np.cumsum(length)
    stream = np.zeros(int(stop[-1]) if texts else 0, np.uint8)
    stream[(stop - length)[:, None] + np.arange(DEPTH)] = np.frombuffer(lead, np.uint8)
    stream[ahead + size] = GAP
    if last:
        stream[stop - 1] = STOP
    nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    stream[np.repeat(ahead, size) + nth] = buf[np.repeat(starts, size) + nth]
    key = stream.astype(np.uint64)
    for d in range(1, DEPTH + 1):
        key[d:] |= stream[:-d].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - d))
    coded = np.ones(len(stream), bool)
    coded[((stop - length)[:, None] + np.arange(DEPTH)).ravel()] = False
    return key[coded].view(np.int64), np.repeat(np.arange(texts), length - DEPTH), stream[-DEPTH:].tobytes()


def squeezed(x: np.ndarray) -> bytes:
    """An array's bytes, all first ones, then all second ones, and so on, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(x.reshape(size, -1).T).view(kind).ravel()


def squeezed_keys(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=0))


def unsqueezed_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data, np.int64))


def beginnings(x: np.ndarray) -> np.ndarray:
    """Which of a sorted array's values differ from the one before."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys of parts of sorted distinct keys and counts, and the sums of their counts."""
    keys = np.concatenate([k for k, _ in parts])
    keys.sort()
    keys = keys[beginnings(keys)]
    total = np.zeros(len(keys), np.int64)
    for k, n in parts:
        for i in range(0, len(k), 1 << 17):
            total[np.searchsorted(keys, k[i : i + (1 << 17)])] += n[i : i + (1 << 17)]
    return keys, total


def added(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """summed of any number of parts: sums are held in chunks by ascending keys, so that adding to them copies one at a time."""
    held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def collapse() -> None:
        keys, n = summed(pending)
        pending.clear()
        ends = np.searchsorted(keys, [k[0] for k, _ in held[1:]]).tolist()
        grown = []
        for i, (start, end) in enumerate(pairwise([0, *ends, len(keys)])):
            chunk, held[i] = held[i], held[0]
            if end > start:
                chunk = summed([chunk, (keys[start:end], n[start:end])])
            if len(chunk[0]) > 2 * CHUNK:
                grown += [tuple(x[at : at + CHUNK].copy() for x in chunk) for at in range(0, len(chunk[0]), CHUNK)]
            else:
                grown.append(chunk)
        held[:] = grown

    for part in parts:
        pending.append(part)
        if sum(len(k) for k, _ in pending) > max(PENDING, sum(len(k) for k, _ in held) // 4):
            collapse()
    if pending:
        collapse()
    keys = np.concatenate([k for k, _ in held])
    held[:] = [(keys, n) for _, n in held]
    return keys, np.concatenate([n for _, n in held])


class WordCounts:
    """Distinct words and the sums of their counts. Words wait until there are many of them, then equal ones become one."""

    def __init__(self) -> None:
        self.words, self.counts = [pa.array([], pa.large_binary())], [np.empty(0, np.int64)]

    def add(self, words: pa.Array, counts: np.ndarray) -> None:
        self.words.append(words)
        self.counts.append(counts)
        if sum(map(len, self.words[1:])) > max(PENDING, len(self.words[0]) // 4):
            self.collapse()

    def collapse(self) -> tuple[pa.Array, np.ndarray]:
        coded = pa.concat_arrays(self.words).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), weights=np.concatenate(self.counts), minlength=len(coded.dictionary))
        self.words, self.counts = [coded.dictionary], [n.astype(np.int64)]
        del coded
        pa.default_memory_pool().release_unused()
        return self.words[0], self.counts[0]


def counted(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and how often they are in training texts. marked: twice the key, and one more in a training
    text; a key has 56 bits, so there is room. marked is worked on in place."""
    marked.sort()
    keys = marked >> 1
    marked &= 1
    first = np.flatnonzero(beginnings(keys))
    return keys[first], np.add.reduceat(marked, first) if len(first) else first


@lru_cache(maxsize=8)
def multipliers(seed: int) -> np.ndarray:
    """An odd random number for each place in a short word."""
    return np.random.default_rng([20240229, seed]).integers(0, 1 << 63, SHORT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """64-bit hashes of words: the sum of each byte's number times its place's, mixed; of long words XXH3."""
    out = np.empty(len(words), np.uint64)
    short = pc.binary_length(words).to_numpy(zero_copy_only=False) <= SHORT
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxh3_64_intdigest(words[i].as_py(), seed)
    few = words if short.all() else words.filter(pa.array(short))
    sums = [np.empty(0, np.uint64)]
    for k in range(0, len(few), 1 << 14):
        buf, offsets = raw(few.slice(k, 1 << 14))
        nth = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
        total = np.append(np.uint64(0), np.cumsum(BYTE[buf] * multipliers(seed)[nth]))
        sums.append(mix(total[offsets[1:]] - total[offsets[:-1]]))
    out[short] = np.concatenate(sums)
    return out.view(np.int64)


def telling(words: pa.Array) -> tuple[int, np.ndarray]:
    """The first seed that tells all words apart, and their hashes."""
    for seed in count():
        found = hashes(words, seed)
        if beginnings(np.sort(found)).all():
            return seed, found


def branches_of(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(branch, places of its keys) of sorted keys, for each branch of parts that has some."""
    bounds = np.searchsorted(keys, np.arange((1 << 16) + 1) << ABOVE)
    there = np.flatnonzero(np.diff(bounds))
    branch = (mix(there.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
    for one in np.unique(branch).tolist():
        yield one, np.concatenate([np.arange(bounds[c], bounds[c + 1]) for c in there[branch == one].tolist()])


def block_asks(batches: Iterable[pa.RecordBatch], parts: int, most: int) -> Iterator[pa.RecordBatch]:
    """What a block asks for: its distinct words and, by branch, its pairs, with their counts in training rows.

    A word's answer comes under a hash, whose seed is the first that tells all words of the block apart. The end of a text
    counts as a word, the line feed.
    """
    words = WordCounts()
    block = None

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal block
        marked: list[np.ndarray] = []
        for batch in batches:
            block = batch.column("block")[0].as_py()
            for _, held, buf, offsets in unpacked(batch):
                words.add(pa.array([END], pa.large_binary()), np.array([(~held).sum()]))
                for first, part, within, keys, of in coded_pieces(buf, offsets, most):
                    starts, ends, text = word_spans(part, within)
                    found, nth = distinct_words(part, starts, ends)
                    words.add(found, np.bincount(nth, weights=~held[first + text], minlength=len(found)))
                    marked.append(keys << 1 | ~held[first + of])
                    del starts, ends, text, found, nth, keys, of
                    if sum(map(len, marked)) >= SORTED:
                        both = np.concatenate(marked)
                        marked.clear()
                        yield counted(both)
                        del both
        if marked:
            yield counted(np.concatenate(marked))

    def asks(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        columns |= {"block": pa.array(np.full(rows, block, np.int64)), "seed": pa.array(np.full(rows, seed, np.int32))}
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in ASKS], schema=ASKS)

    keys, n = added(pairs())
    rows = [(branch, squeezed_keys(keys[at]), squeezed(n[at])) for branch, at in branches_of(keys, parts)]
    del keys, n
    word, n = words.collapse()
    del words
    seed, found = telling(word)
    for k in range(0, len(word), HANDED):
        some = word.slice(k, HANDED)
        yield asks(len(some), word=some.cast(pa.binary()), hash=pa.array(found[k : k + HANDED]), n=pa.array(n[k : k + HANDED]))
    columns = {f: pa.array(x, ASKS.field(f).type) for f, x in zip(("branch", "keys", "counts"), zip(*rows, strict=True), strict=True)}
    yield asks(len(rows), **columns)


def tree_of(asked: DataFrame, blocks: int) -> DataFrame:
    """asked: branch, block, keys, counts. branch, keys and counts: of each branch all pairs and their sums.

    No more than JOINED rows are added up at once; of more, the sums of some are added up in turn.
    """

    def add(table: pa.Table) -> pa.Table:
        found = ((unsqueezed_keys(table.column("keys")[i].as_py()), unsqueezed(table.column("counts")[i].as_py(), np.int64)) for i in range(table.num_rows))
        keys, n = added(found)
        return pa.table([table.column("branch").slice(0, 1), table.column("block").slice(0, 1), pa.array([squeezed_keys(keys)], pa.binary()), pa.array([squeezed(n)], pa.binary())], ["branch", "block", "keys", "counts"])

    while blocks > JOINED:
        blocks = -(-blocks // JOINED)
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("block"), F.lit(blocks)))
        asked = store(dealt.groupBy("branch", "block").applyInArrow(add, "branch int, block long, keys binary, counts binary"))
    return store(asked.groupBy("branch").applyInArrow(add, "branch int, block long, keys binary, counts binary").drop("block"))


def pair_chances(asked: DataFrame, blocks: int) -> DataFrame:
    """asked: block, branch, keys, counts. block, keys and chances (log10, 32 bits) under the tree fitted on the counts."""

    def pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return unsqueezed_keys(table.column("keys")[0].as_py()), unsqueezed(table.column("counts")[0].as_py(), np.int64)

    def weigh(table: pa.Table) -> pa.Table:
        return pa.table([pa.array(x) for x in branch_top(*pairs(table))], ["node", "zeros", "ones", "below"])

    tree = tree_of(asked, blocks)
    top = tree.groupBy("branch").applyInArrow(weigh, "node long, zeros double, ones double, below double")
    top = top_of_tree(top.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect())

    def weighed(table: pa.Table) -> pa.Table:
        keys, n = pairs(table)
        chances = log10_chances(keys, n, top).astype(np.float32)
        return pa.table([table.column("branch"), table.column("keys"), pa.array([squeezed(chances)], pa.binary())], ["branch", "keys", "chances"])

    def answer(table: pa.Table, wanted: pa.Table) -> pa.Table:
        keys, chances = unsqueezed_keys(table.column("keys")[0].as_py()), unsqueezed(table.column("chances")[0].as_py(), np.float32)
        out = [squeezed(chances[np.searchsorted(keys, unsqueezed_keys(wanted.column("keys")[i].as_py()))]) for i in range(wanted.num_rows)]
        return pa.table([wanted.column("block"), wanted.column("keys"), pa.array(out, pa.binary())], ["block", "keys", "chances"])

    shares = -(-blocks // JOINED)
    fitted = tree.groupBy("branch").applyInArrow(weighed, "branch int, keys binary, chances binary")
    fitted = fitted.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    wanted = asked.select("branch", "block", "keys", F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share"))
    return fitted.groupBy("branch", "share").cogroup(wanted.groupBy("branch", "share")).applyInArrow(answer, "block long, keys binary, chances binary")


def summed_chances(keys: np.ndarray, chance: np.ndarray, wanted: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The sum of each text's chances; keys: sorted, chance: theirs, wanted: keys with their text numbers, which ascend.

    256 texts at a time: a key has 56 bits, so that it is sorted with its text's number, and each distinct one looked for once.
    """
    out = np.zeros(texts)
    for first in range(0, texts, 256):
        part = slice(*np.searchsorted(text, (first, first + 256)))
        both = np.sort(wanted[part].view(np.uint64) << np.uint64(8) | (text[part] - first).astype(np.uint64))
        key = (both >> np.uint64(8)).view(np.int64)
        new = np.flatnonzero(beginnings(key))
        found = np.repeat(chance[np.searchsorted(keys, key[new])], np.diff(np.append(new, len(key))))
        out[first : first + 256] = np.bincount((both & np.uint64(255)).view(np.int64), weights=found, minlength=min(256, texts - first))
    return out


def gathered(pairs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of all rows of pairs (keys, chances), and their chances. A row's keys are sorted, and keys of the same
    two last bytes of context are in one row: so each run of those is put to its place, one row after another."""
    rows = [(pairs.column("keys")[i].as_py(), pairs.column("chances")[i].as_py()) for i in range(pairs.num_rows)]
    size = np.zeros(1 << 16, np.int64)
    for k, _ in rows:
        size += np.bincount(unsqueezed_keys(k) >> ABOVE, minlength=len(size))
    start = np.cumsum(size) - size
    keys, chance = np.empty(int(size.sum()), np.int64), np.empty(int(size.sum()), np.float32)
    for k, c in rows:
        part = unsqueezed_keys(k)
        first = np.flatnonzero(beginnings(part >> ABOVE))
        to = np.arange(len(part)) + np.repeat(start[part[first] >> ABOVE] - first, np.diff(np.append(first, len(part))))
        keys[to], chance[to] = part, unsqueezed(c, np.float32)
    return keys, chance


def document_scores(table: pa.Table, replies: pa.Table, total: int, most: int) -> pa.Table:
    """The block's documents with the sums over their words and over their streams' bytes; total: N + V + 1."""
    word = pc.is_valid(replies.column("hash"))
    known, c, seed = (pc.filter(replies.column(k), word).to_numpy() for k in ("hash", "c", "seed"))
    order = np.argsort(known)
    known, c, seed = known[order], c[order], int(seed[0])
    base = np.log10((c + 1) / total)
    end = int(np.searchsorted(known, hashes(pa.array([END]), seed)[0]))
    del order, word
    keys, chance = gathered(replies.select(["keys", "chances"]).filter(pc.is_valid(replies.column("keys"))))
    parts = []
    for doc, held, buf, offsets in unpacked(table):
        n_words, n_known, summed, score, coded = np.zeros((5, len(doc)))
        for first, part, within, keys_of, of in coded_pieces(buf, offsets, most):
            starts, ends, text = word_spans(part, within)
            found, nth = distinct_words(part, starts, ends)
            at = np.searchsorted(known, hashes(found, seed))[nth]
            texts = len(within) - 1
            here = slice(first, first + texts)
            n_words[here] += np.bincount(text, minlength=texts)
            n_known[here] += np.bincount(text, weights=c[at] > 0, minlength=texts)
            summed[here] += np.bincount(text, weights=base[at], minlength=texts)
            score[here] += summed_chances(keys, chance, keys_of, of, texts)
            coded[here] += np.bincount(of, minlength=texts)
        parts.append(pa.table([
            pa.array(doc, pa.int64()), pa.array(held), pa.array(n_words.astype(np.int64) + 1),
            pa.array(n_known.astype(np.int64) + int(c[end] > 0)), pa.array(summed + base[end]), pa.array(score),
            pa.array(-score / np.log10(2) / coded),
        ], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]))
    return pa.concat_tables(parts)


def score_texts(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row's whole text.

    The tree and the word counts are of the rows that are not held out. bits_per_byte is the code length of a byte of the
    text's stream. Null and empty texts are an end alone; equal texts score alike; null doc_ids count by the empty string;
    with no training rows every chance is even; other columns are ignored. Runs of white space are coded as one space.
    A text of more than piece_bytes is coded in pieces, with the same result; a block still holds whole texts. A word is never cut.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    rows = store(packed(docs).withColumn("piece", F.monotonically_increasing_id()))
    size = rows.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda t, x: t + x))).first()[0] or 0
    blocks = max(1, round(size / BLOCK_BYTES))
    # round robin, from a place of each partition's own: blocks of one size whatever the doc_ids and texts are
    start = F.xxhash64(F.shiftright("piece", 33))
    rows = rows.withColumn("block", F.pmod(F.pmod(start, F.lit(blocks)) + F.col("piece").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(blocks)))
    parts = BRANCHES * shuffle_parts(docs.sparkSession)

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_asks(batches, parts, piece_bytes)

    asked = store(rows.groupBy("block").applyInArrow(asks, "block long, seed int, hash long, word binary, n long, branch int, keys binary, counts binary"))
    by_word = asked.filter("word is not null").select("block", "seed", "hash", "word", "n")
    words = store(by_word.groupBy("word").agg(F.sum("n").alias("c")))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    replies = by_word.select("block", "seed", "hash", "word").join(words, "word").select("block", "seed", "hash", "c")
    chances = pair_chances(asked.filter("keys is not null").select("block", "branch", "keys", "counts"), blocks)
    replies = replies.unionByName(chances, allowMissingColumns=True)
    out = rows.drop("piece").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        lambda texts, answers: document_scores(texts, answers, n + v + 1, piece_bytes),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
