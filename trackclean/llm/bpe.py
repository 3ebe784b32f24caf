"""Byte-level BPE encoding and decoding.

Texts are split into pieces without a regular expression. Each code point has a class; what the pattern looks ahead for is
put into the class, so that a small automaton over classes, read from left to right, tells where pieces start. A class is a
function from states to states, and such functions compose associatively: the functions of blocks of characters are worked
out for all blocks at once, scanned by doubling, and every block is then read from its own first state. Distinct pieces are
merged once and remembered. Each id keeps the byte at which it starts, and decoding puts its bytes back there.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import distinct_words, mix, raw
from .tokens import balanced

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of text that are split at once, and pieces that are remembered.
CHUNK = 2 << 20
REMEMBERED = 150_000
#: Characters of a block of the scan.
BLOCK = 64
#: Widths of the matrices of pieces; pieces of more bytes are merged with a heap.
WIDTHS = (6, 10, 16, 32)
TABLE_BITS = 20

#: Characters that the pattern takes as white space, and its endings behind an apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

#: Classes. INNER is white space in front of white space or of the end; OPEN and CLOSED the last of a run in front of
#: something else, a space or another; ONE and TWO are apostrophes in front of an ending. FIRST is added where a text starts.
LETTER, NUMBER, OTHER, INNER, OPEN, CLOSED, ONE, TWO = range(8)
FIRST = 8
#: Code points' own classes besides the first three.
SPACE, WHITE, APOSTROPHE, UNKNOWN = range(8, 12)
#: States: nothing to go on with, an open space, inside white space, letters, numbers, others, one or two letters to come.
NOTHING, SPACED, BLANKS, LETTERS, NUMBERS, OTHERS, LAST, LAST_TWO = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts) by class * 8 + state."""
    state = np.zeros((16, 8), np.uint8)
    begins = np.ones((16, 8), bool)
    goes_on = {
        LETTER: (LETTERS, {LETTERS: LETTERS, SPACED: LETTERS, LAST: NOTHING, LAST_TWO: LAST}),
        NUMBER: (NUMBERS, {NUMBERS: NUMBERS, SPACED: NUMBERS}),
        OTHER: (OTHERS, {OTHERS: OTHERS, SPACED: OTHERS}),
        INNER: (BLANKS, {BLANKS: BLANKS}),
        OPEN: (SPACED, {}),
        CLOSED: (NOTHING, {}),
        ONE: (LAST, {OTHERS: OTHERS, SPACED: OTHERS}),
        TWO: (LAST_TWO, {OTHERS: OTHERS, SPACED: OTHERS}),
    }
    for k, (new, same) in goes_on.items():
        state[k], state[k + FIRST] = new, new
        for before, after in same.items():
            state[k, before], begins[k, before] = after, False
    return state.ravel(), begins.ravel()


STATE, BEGINS = _automaton()


class Classes:
    """The class of each code point as the library's pattern sees it.

    Python's table of Unicode may be older than the library's: code points that it does not know are put to the library
    when they are met, by a vocabulary in which a letter or digit and the code point are one token.
    """

    def __init__(self) -> None:
        table = np.full(0x110000, OTHER, np.uint8)
        kinds = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8).reshape(-1, 2)
        table[kinds[:, 0] == ord("L")] = LETTER
        table[kinds[:, 0] == ord("N")] = NUMBER
        table[(kinds == (ord("C"), ord("n"))).all(axis=1)] = UNKNOWN
        table[WHITE_SPACE] = WHITE
        table[0x20] = SPACE
        table[0x27] = APOSTROPHE
        self.table = table

    def learn(self, points: np.ndarray) -> None:
        import public_tokenizers
        import tiktoken

        self.table[points] = OTHER
        for kind, front in ((LETTER, "a"), (NUMBER, "1")):
            pairs = [(front + chr(c)).encode() for c in points.tolist()]
            ranks = {bytes([i]): i for i in range(256)} | {p: 256 + i for i, p in enumerate(pairs)}
            library = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            one = [len(library.encode_ordinary(p.decode())) == 1 for p in pairs]
            self.table[points[one]] = kind

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (unknown := found == UNKNOWN).any():
            self.learn(np.unique(points[unknown]))
            found = self.table[points]
        return found


def with_lookahead(own: np.ndarray, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The automaton's classes from code points' own ones; firsts: the places where texts start."""
    n = len(own)
    out = own.copy()
    starts = np.zeros(n + 3, bool)
    starts[firsts] = starts[n:] = True
    white = (own == SPACE) | (own == WHITE)
    at = np.flatnonzero(white)
    ahead = starts[at + 1] | white[np.minimum(at + 1, n - 1)]
    out[at] = np.where(ahead, INNER, np.where(own[at] == SPACE, OPEN, CLOSED))
    at = np.flatnonzero(own == APOSTROPHE)
    out[at] = OTHER
    at = at[~starts[at + 1]]
    one = np.isin(points[at + 1], [ord(e) for e in ENDINGS if len(e) == 1])
    out[at[one]] = ONE
    at = at[~starts[at + 2]]
    two = points[at + 1].astype(np.int64) << 21 | points[at + 2]
    out[at[np.isin(two, [ord(e[0]) << 21 | ord(e[1]) for e in ENDINGS if len(e) == 2])]] = TWO
    out[firsts] += FIRST
    return out


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Where pieces start, by a scan of the classes' functions over blocks."""
    n = len(classes)
    m = -(-n // BLOCK)
    x = np.full(m * BLOCK, OTHER, np.uint8)
    x[:n] = classes
    x = np.ascontiguousarray(x.reshape(m, BLOCK).T) * np.uint8(8)
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], m, axis=1)  # state in front of a block: state behind it
    for row in x:
        whole = STATE[row[None, :] + whole]
    behind, step = whole, 1
    while step < m:  # behind[:, i]: the functions of all blocks up to i, one after another
        later = behind.copy()
        later[:, step:] = np.take_along_axis(behind[:, step:], behind[:, :-step], axis=0)
        behind, step = later, 2 * step
    state = np.append(np.uint8(NOTHING), behind[NOTHING, :-1])
    begins = np.empty((BLOCK, m), bool)
    for k, row in enumerate(x):
        at = row + state
        begins[k], state = BEGINS[at], STATE[at]
    return np.flatnonzero(begins.T.reshape(-1)[:n])


def pair_hash(pair: np.ndarray) -> np.ndarray:
    return (mix(pair.view(np.uint64)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Vocabulary:
    """The ranks of a file, the merging of pieces, and the bytes of ids."""

    def __init__(self, ranks: str = RANKS) -> None:
        import public_tokenizers

        with open(public_tokenizers.path(ranks), "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        width = len(str(len(tokens))) + 1
        self.decimal = np.frombuffer(b"".join(f"{i} ".encode().ljust(width, b"\0") for i in range(len(tokens))), np.uint8).reshape(-1, width)
        self.known: dict[bytes, list[int]] = {}

    @cached_property
    def classes(self) -> Classes:
        return Classes()

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, ids) of an open table: the id of two ids' bytes one after the other, at the pair's hash or behind it."""
        ranks = self.ranks
        found = [(x << 32 | y, k) for t, k in ranks.items() for i in range(1, len(t)) if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None]
        pair, merged = np.array(found, np.int64).T
        keys, ids = np.full(1 << TABLE_BITS, -1, np.int64), np.full(1 << TABLE_BITS, len(self.length), np.int32)
        place = pair_hash(pair)
        while len(pair):
            free = np.flatnonzero(keys[place] == -1)
            free = free[np.unique(place[free], return_index=True)[1]]
            keys[place[free]], ids[place[free]] = pair[free], merged[free]
            pair, merged, place = (np.delete(x, free) for x in (pair, merged, place))
            place = (place + 1) & ((1 << TABLE_BITS) - 1)
        return keys, ids

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each two ids' bytes together, or one more than all ids; ids of -1 join nothing."""
        keys, ids = self.pairs
        pair = a.astype(np.int64) << 32 | b
        place = pair_hash(pair)
        found = keys[place]
        out = np.where(found == pair, ids[place], np.int32(len(self.length)))
        left = np.flatnonzero((found != pair) & (found != -1) & (a >= 0) & (b >= 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << TABLE_BITS) - 1)
            found = keys[place[left]]
            hit = left[found == pair[left]]
            out[hit] = ids[place[hit]]
            left = left[(found != pair[left]) & (found != -1)]
        return out

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece: the pair of least rank, the leftmost of these, is merged until none is left.

        Pieces of about one length are the rows of a matrix, and all rows merge a pair at a time. A rank is its token's id.
        """
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        low = 0
        for width in WIDTHS:
            at = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if not len(at):
                continue
            text = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in at.tolist()), np.uint8).reshape(-1, width)
            ids = np.where(np.arange(width) < sizes[at, None], byte[text], np.int32(-1))
            # one column more, of nothing, is behind the last id and in front of the first
            ids = np.concatenate([ids, np.full((len(at), 1), -1, np.int32)], axis=1)
            wide = width + 1
            rank = self.joined(ids.ravel(), np.roll(ids, -1, axis=1).ravel()).reshape(-1, wide)
            after = np.tile(np.append(np.arange(1, wide), 0), (len(at), 1))
            before = np.tile(np.append(width, np.arange(width)), (len(at), 1))
            flat = [x.reshape(-1) for x in (ids, rank, after, before)]
            row = np.arange(len(at))
            while len(row):
                some = rank[row]
                best = some.argmin(axis=1)
                least = some[np.arange(len(row)), best]
                go_on = least < len(self.length)
                row, best, least = row[go_on], best[go_on], least[go_on]
                self._merge(*flat, row * wide, best, least)
            kept = ids[ids >= 0].tolist()
            ends = np.cumsum((ids >= 0).sum(axis=1)).tolist()
            for i, a, b in zip(at.tolist(), [0, *ends], ends, strict=False):
                out[i] = kept[a:b]
        for i in np.flatnonzero(sizes > low).tolist():
            out[i] = [self.ranks[pieces[i]]] if pieces[i] in self.ranks else self.merged_long(pieces[i])
        return out

    def _merge(self, ids: np.ndarray, rank: np.ndarray, after: np.ndarray, before: np.ndarray, base: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
        """One pair of each row (whose first place is base) becomes the id least, at the place best."""
        at = base + best
        gone = base + after[at]
        new = after[gone]
        back = before[at]
        ids[gone], rank[gone] = -1, len(self.length)
        ids[at], after[at] = least, new
        before[base + new] = best
        rank[at] = self.joined(least, ids[base + new])
        rank[base + back] = self.joined(ids[base + back], least)

    def merged_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        ranks, end, before = self.ranks, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            rank, i = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or ranks.get(piece[i : end[j]]) != rank:
                continue
            alive[j], end[i] = 0, end[j]
            if end[i] < n:
                before[end[i]] = i
                if (r := ranks.get(piece[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (their bytes one after another, and each one's first byte and the end), and the number of each's ids."""
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        points, lead = buf, np.arange(len(buf))
        if buf.max() >= 0x80:
            points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            lead = np.flatnonzero((buf & 0xC0) != 0x80)
        firsts = np.unique(np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0]))
        starts = lead[piece_starts(with_lookahead(self.classes.of(points), points, firsts))]
        words, nth = distinct_words(buf, starts, np.append(starts[1:], len(buf)))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        pieces = words.to_pylist()
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self.merged(new), strict=True))
        found = [self.known[p] for p in pieces]
        many = np.array([len(x) for x in found])
        flat = np.fromiter((i for x in found for i in x), np.int32, int(many.sum()))
        first, count = (np.cumsum(many) - many)[nth], many[nth]
        ends = np.cumsum(count)
        ids = flat[np.repeat(first - ends + count, count) + np.arange(ends[-1])]
        bounds = np.append(0, ends)[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The bytes of ids that follow each other, each put at its offset; the first offset is where the bytes begin."""
        if not len(ids):
            return np.empty(0, np.uint8)
        size = self.length[ids]
        return self.bytes[np.repeat(self.start[ids] - (offsets - offsets[0]), size) + np.arange(size.sum())]

    def said(self, ids: np.ndarray) -> bytes:
        """The ids in decimal digits, a space behind each."""
        digits = self.decimal[ids].ravel()
        return digits[digits != 0].tobytes()


@lru_cache(maxsize=2)
def vocabulary_of(ranks: str) -> Vocabulary:
    """One for all the tasks of a Python worker."""
    return Vocabulary(ranks)


def cuts(buf: np.ndarray, most: int = CHUNK) -> list[int]:
    """Places of a long text where a piece starts whatever is around them, about most bytes apart, then its end.

    A space behind an ASCII character that is none always starts a piece, and nothing in front of it looks past it.
    """
    out, at = [0], most
    while at < len(buf):
        stretch = buf[at - 1 : at + most]
        fit = np.flatnonzero((stretch[1:] == 0x20) & (stretch[:-1] > 0x20) & (stretch[:-1] < 0x7F))
        if len(fit):
            out.append(at + int(fit[0]))
            at = out[-1]
        at += most
    return [*out, len(buf)]


def encoded(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids, offsets (the byte of the text at which each id starts) of every row's whole text.

    Null and empty texts have no ids; equal rows are encoded alike; strings of special tokens are ordinary text; other
    columns are ignored. A long text is split in chunks, so that what is worked on at once is bounded unless it has no
    space; its ids and offsets are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(ranks)
        for whole in batches:
            for batch in balanced(whole, "text", CHUNK):
                buf, offsets = raw(batch.column("text"))
                if batch.num_rows == 1 and len(buf) > CHUNK:
                    at = cuts(buf)
                    parts = [vocabulary.encode(buf[a:b], np.array([0, b - a]))[0] for a, b in zip(at, at[1:], strict=False)]
                    ids, counts = np.concatenate(parts), np.array([sum(map(len, parts))])
                else:
                    ids, counts = vocabulary.encode(buf, offsets)
                size = vocabulary.length[ids]
                begin = np.cumsum(size) - size - np.repeat(offsets[:-1], counts)
                bounds = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (ids, begin)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "offsets"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return x.mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and offsets of each row."""
    columns = [batch.column(c) for c in ("ids", "offsets")]
    bounds = columns[0].offsets.to_numpy()
    ids, offsets = (c.values.to_numpy() for c in columns)
    shift = columns[1].offsets.to_numpy()[0] - bounds[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield ids[a:b], offsets[a + shift : b + shift]


def decoded(encoded_docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, bytes: what the rows of encoded decode to, by their ids and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(ranks)
        for batch in batches:
            texts = [vocabulary.decode(ids, offsets).tobytes() for ids, offsets in _lists(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return encoded_docs.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id long, bytes binary")


def bpe_digest(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256 of every row of encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(ranks)
        for batch in batches:
            rows = []
            for ids, offsets in _lists(batch):
                said, back = hashlib.sha256(), hashlib.sha256()
                for a in range(0, len(ids), CHUNK):
                    part = vocabulary.said(ids[a : a + CHUNK])
                    said.update(part if a + CHUNK < len(ids) else part[:-1])
                    back.update(vocabulary.decode(ids[a : a + CHUNK], offsets[a : a + CHUNK]))
                rows.append((len(ids), said.hexdigest(), back.hexdigest()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded(docs, ranks).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
