"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

A word that differs from another by one code point has all of its first half, or all of its second half, in common with it.
So words are dealt by their halves, and each deal's words become two minimal acyclic automata, of the words and of the words
read backwards, in which every state knows how many words go through it: the path of a word adds up to its number. A word
is followed exactly through one half, then completed with one error in the other, by either automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shuffle_parts, store
from .shingles import distinct_words, raw
from .tokens import balanced

#: Words of fewer code points or occurrences are left out.
MIN_LENGTH = 5
MIN_COUNT = 3
#: One in so many (document, word) pairs loses a code point.
ALTERED = 97
#: A word's form has at least so many times its occurrences.
MORE = 2
#: Words of an automaton, about; a deal of more words is dealt again by more of what its words have in common.
WORDS = 20_000
#: Bytes of text that are split into words at once.
STRETCH = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x.astype(np.uint32)


CRC = _crc_table()


def crc32(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The inner states of CRC-32 behind each slice of buf, from the states in front of it."""
    state, at = state.copy(), starts.copy()
    left = np.flatnonzero(at < ends)
    while len(left):
        s = state[left]
        state[left] = CRC[(s ^ buf[at[left]]) & 0xFF] ^ (s >> np.uint32(8))
        at[left] += 1
        left = left[at[left] < ends[left]]
    return state


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of the runs of A-Z, a-z and U+00C0 to U+00FF, which are two bytes from C3 on."""
    lead = buf == 0xC3
    letter = _LETTER[buf] | lead
    letter[1:] |= lead[:-1]
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    begin[edges] |= letter[edges]
    end = letter.copy()
    end[:-1] &= ~letter[1:]
    end[edges - 1] |= letter[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def altered_counts(buf: np.ndarray, offsets: np.ndarray, doc_ids: list[int | None], altered: int = ALTERED) -> tuple[list[str], np.ndarray]:
    """The words of texts with their occurrences; one in altered (document, word) pairs loses the code point its CRC tells."""
    buf = _LOWER[buf]
    starts, ends, text = letter_runs(buf, offsets)
    if not len(starts):
        return [], np.empty(0, np.int64)
    words, nth = distinct_words(buf, starts, ends)
    pair, count = np.unique(text * len(words) + nth, return_counts=True)
    text, nth = pair // len(words), pair % len(words)
    prefixes = [b"%d:" % d if d is not None else b":" for d in doc_ids]
    size = np.array([len(p) for p in prefixes])
    stop = np.cumsum(size)
    front = crc32(np.frombuffer(b"".join(prefixes), np.uint8), stop - size, stop, np.full(len(size), 0xFFFFFFFF, np.uint32))
    data, bounds = raw(words)
    h = crc32(data, bounds[nth], bounds[nth + 1], front[text]) ^ np.uint32(0xFFFFFFFF)
    hit = h % np.uint32(altered) == 0
    known = [w.decode() for w in words.to_pylist()]
    total = dict(zip(known, np.bincount(nth[~hit], count[~hit], len(known)).astype(np.int64).tolist(), strict=True))
    for k, x, n in zip(nth[hit].tolist(), h[hit].tolist(), count[hit].tolist(), strict=True):
        w = known[k]
        short = w[: x % len(w)] + w[x % len(w) + 1 :]
        total[short] = total.get(short, 0) + n
    return list(total), np.fromiter(total.values(), np.int64, len(total))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[int | None]]]:
    """Texts' bytes, offsets and doc_ids; a long text comes in several stretches, cut where no letter is."""
    for part in balanced(batch, "text", STRETCH):
        buf, offsets = raw(part.column("text"))
        docs = part.column("doc_id").to_pylist()
        if part.num_rows > 1 or len(buf) <= STRETCH:
            yield buf, offsets, docs
            continue
        at = 0
        while at < len(buf):
            end = min(at + STRETCH, len(buf))
            while end < len(buf):
                free = np.flatnonzero(~_LETTER[buf[end : end + STRETCH]] & (buf[end : end + STRETCH] < 0x80))
                if len(free):
                    end += int(free[0])
                    break
                end = min(end + STRETCH, len(buf))
            yield buf[at:end], np.array([0, end - at]), docs
            at = end


def word_counts(docs: DataFrame, altered: int = ALTERED, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of docs (doc_id, text not null), altered as altered_counts says, that are long and frequent enough.

    Each stretch of text gives every word once, and Spark adds up before it shuffles: a word of a third of all occurrences
    is a row for each stretch. Nothing is cut out, a word is counted over all texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _stretches(batch):
                words, n = altered_counts(*part, altered)
                keep = [i for i, w in enumerate(words) if len(w) >= min_length and n[i]]
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in keep], pa.string()), pa.array(n[keep], pa.int64())], ["word", "n"])

    x = docs.mapInArrow(run, "word string, n long")
    return x.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Automaton:
    """The minimal acyclic automaton of sorted words; a word's number is its place among them.

    A state is a dictionary of code points to (state, words in front of this way); states of equal ways are one.
    """

    def __init__(self, words: list[str]) -> None:
        self.ways: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        known: dict[tuple, int] = {}
        # the path of the last word: of each state, whether a word ends there, and its finished ways in order
        path: list[list] = [[False, []]]
        letters: list[str] = []

        def finish(depth: int) -> None:
            while len(path) > depth + 1:
                final, ways = path.pop()
                key = (final, tuple(ways))
                state = known.get(key)
                if state is None:
                    state = known[key] = self._state(final, ways)
                path[-1][1].append((letters.pop(), state))

        last = ""
        for w in words:
            n, most = 0, min(len(last), len(w))
            while n < most and last[n] == w[n]:
                n += 1
            finish(n)
            for c in w[n:]:
                letters.append(c)
                path.append([False, []])
            path[-1][0] = True
            last = w
        finish(0)
        self.root = self._state(*path[0])

    def _state(self, final: bool, ways: list[tuple[str, int]]) -> int:
        at, out = int(final), {}
        for c, s in ways:
            out[c] = (s, at)
            at += self.words[s]
        self.ways.append(out)
        self.final.append(final)
        self.words.append(at)
        return len(self.ways) - 1

    def exact(self, word: str, start: int, state: int, number: int) -> int:
        """The number of the word that goes on from a state with word[start:], or -1."""
        ways = self.ways
        for k in range(start, len(word)):
            found = ways[state].get(word[k])
            if found is None:
                return -1
            state, number = found[0], number + found[1]
        return number if self.final[state] else -1

    def near(self, word: str, half: int) -> list[int]:
        """Numbers of the words that have the first half characters of word, and differ by one replaced or one more after."""
        state, number, out = self.root, 0, []
        for c in word[:half]:
            found = self.ways[state].get(c)
            if found is None:
                return out
            state, number = found[0], number + found[1]
        for k in range(half, len(word) + 1):
            own = word[k] if k < len(word) else None
            for c, (s, skipped) in self.ways[state].items():
                if c == own:  # one more of the same is found behind it
                    continue
                if own is not None and (n := self.exact(word, k + 1, s, number + skipped)) >= 0:
                    out.append(n)
                if (n := self.exact(word, k, s, number + skipped)) >= 0:
                    out.append(n)
            if own is None or (found := self.ways[state].get(own)) is None:
                break
            state, number = found[0], number + found[1]
        return out


def _key(length: Column, front: Column, back: Column) -> Column:
    """Of a word and a query's length: a hash of both, of the word's first characters and of its last ones."""
    return F.xxhash64(length, front, back, F.substring("word", F.lit(1), front), F.substring("word", F.length("word") - back + 1, back))


def dealt(words: DataFrame) -> DataFrame:
    """Each word for queries of its own length and of one less, by their first half (backwards: second half).

    word, n, length (of the queries), front and back (code points at both ends that all of a deal have), backwards, key.
    """
    length = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("length")
    x = words.select("word", "n", length).withColumn("half", F.floor(F.col("length") / 2).cast("int"))
    ends = F.array(F.struct(F.col("half").alias("front"), F.lit(0).alias("back"), F.lit(False).alias("backwards")),
                   F.struct(F.lit(0).alias("front"), (F.col("length") - F.col("half")).alias("back"), F.lit(True).alias("backwards")))
    x = x.withColumn("ends", F.explode(ends)).select("word", "n", "length", "ends.*")
    return x.withColumn("key", _key(F.col("length"), F.col("front"), F.col("back")))


def dealt_again(deals: DataFrame) -> DataFrame:
    """The same for deals that are too large: what a deal's queries do not have in common is halved in turn.

    The error is in one half of it, so all have the other half in common too.
    """
    middle = F.col("length") - F.col("front") - F.col("back")
    half = F.floor(middle / 2).cast("int")
    ends = F.array(F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back"), F.lit(False).alias("backwards")),
                   F.struct(F.col("front").alias("front"), (F.col("back") + middle - half).alias("back"), F.lit(True).alias("backwards")))
    x = deals.withColumn("ends", F.explode(ends)).select("word", "n", "length", "ends.*")
    return x.withColumn("key", _key(F.col("length"), F.col("front"), F.col("back")))


def _pairs(rows: list[tuple[str, int, int, int]], backwards: bool) -> Iterator[tuple[str, int, str, int]]:
    """rows: word, n, length and common (first or last code points) of the queries. (word, n, near word, its n), both ways."""
    counts = {w: n for w, n, _, _ in rows}
    words = sorted(w[::-1] for w in counts) if backwards else sorted(counts)
    found = Automaton(words)
    for w, n, common in {(w, n, common) for w, n, length, common in rows if len(w) == length}:
        for k in found.near(w[::-1] if backwards else w, common):
            other = words[k][::-1] if backwards else words[k]
            yield w, n, other, counts[other]
            yield other, counts[other], w, n


def searched(deals: DataFrame, words: int = WORDS) -> DataFrame:
    """word, near, near_n: the pairs within each deal, some of them twice. Deals are streamed, some to an automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, int]] = []
        key = way = None

        def emit() -> pa.RecordBatch:
            found = list(dict.fromkeys(_pairs(rows, bool(way))))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], t) for k, t in ((0, pa.string()), (2, pa.string()), (3, pa.int64()))], ["word", "near", "near_n"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("backwards", "key", "word", "n", "length", "front", "back")]
            for b, k, word, n, length, front, back in zip(*columns, strict=True):
                if rows and (b != way or k != key and len(rows) >= words):
                    yield emit()
                way, key = b, k
                rows.append((word, n, length, back if b else front))
        if rows:
            yield emit()

    x = deals.repartition(shuffle_parts(deals.sparkSession), "backwards", "key").sortWithinPartitions("backwards", "key")
    return x.mapInArrow(run, "word string, near string, near_n long")


def near_pairs(words: DataFrame, most: int = WORDS) -> DataFrame:
    """word, near, near_n: every pair of words (word, n; distinct) that differ by one code point, once each way.

    Deals of more than most words are dealt again until what their queries do not share is one code point: such a deal
    has as many words as there are pairs of code points at most.
    """
    open_, found = store(dealt(words)), None
    while True:
        size = open_.groupBy("key").agg(F.count("*").alias("k"), F.max(F.col("length") - F.col("front") - F.col("back")).alias("middle"))
        large = cut(size.filter((F.col("k") > most) & (F.col("middle") > 1)).select("key"))
        done = large.isEmpty()
        now = searched(open_ if done else open_.join(large, "key", "left_anti"))
        found = now if found is None else found.unionByName(now)
        if done:
            break
        open_ = store(dealt_again(open_.join(large, "key", "left_semi")))
    return found.repartition(shuffle_parts(words.sparkSession), "word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where each word's forms lead. forms: word, form. A form is twice as frequent, so no path comes back, and
    pointers are doubled: the rounds are the logarithm of the longest path, which is one of the counts."""
    now = store(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        going = now.join(ahead, "root", "left")
        then = store(going.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if then.filter("moved").isEmpty():
            return then.drop("moved")
        now = then.drop("moved")


def spelling_variants(docs: DataFrame, altered: int = ALTERED, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    Null and empty texts have no words; rows are counted each, equal ones too; a null doc_id is an empty one in the pairs'
    CRC; ties of frequency go to the first word in code-point order; an empty table gives an empty frame; other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = store(word_counts(docs, altered, min_length, min_count))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    x = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    fit = F.col("form_n") >= MORE * F.col("n")
    x = x.select("word", F.when(fit, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fit, F.col("form_n")).alias("form_n"))
    x = store(x)
    ends = roots(x.filter("form is not null"))
    return x.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
