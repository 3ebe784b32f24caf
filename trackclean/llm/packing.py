"""Sum-of-squares packing of documents into training sequences.

Documents are encoded in Arrow functions, cut where they are longer than a sequence, and packed by the sum-of-squares
rule: with N(g) open bins of gap g, an item goes where the sum of N(g)**2 comes out smallest. Items are dealt out by hash
into groups of bounded size that pack on their own, longest first; each group leaves few bins open.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import balanced

MODEL = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CAPACITY = 2048
END = 0
#: Pieces that one task packs, on average: more leave fewer bins open, fewer run on more machines.
GROUP_PIECES = 40_000
#: What both libraries' patterns read alike in every version of Unicode: ASCII text and Latin letters.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*")


class Encoder:
    """Ids of whole texts as bytes (little-endian, 32 bits each) under a byte-level BPE file of the tokenizers library.

    The same vocabulary is there as ranks for tiktoken, which gives the same ids four times as fast: plain texts go that
    way. Texts with other characters or with a special token's string go to the tokenizers library.
    """

    def __init__(self, model: str = MODEL, ranks: str = RANKS) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(model))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks), "rb") as f:
            of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=of, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not any(x in text for x in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def pieces_of(docs: DataFrame, model: str = MODEL, ranks: str = RANKS, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row: its ids and END, cut into pieces of capacity ids, the first
    piece taking what is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, ranks)
        end = np.asarray([END], "<u4")
        for whole in batches:
            for batch in balanced(whole, "text"):
                rows: list[tuple] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.concatenate([encoder.encode(text), end])
                    n = len(ids)
                    stops = range(n % capacity or min(n, capacity), n + 1, capacity)
                    rows += [(doc, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())) for k, (start, stop) in enumerate(zip([0, *stops], stops, strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return x.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item, items taken in the order given.

    Putting an item of size s into a bin of gap g changes the sum by 2 * (N(g - s) - N(g)) + 2, a new bin by
    2 * N(capacity - s) + 1, and a bin that comes out full leaves the sum; the smallest change wins, then the smallest
    gap.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(lengths), np.int64)
    bins = 0
    for i, s in enumerate(lengths.tolist()):
        if s >= capacity:
            out[i] = bins
            bins += 1
            continue
        left = capacity - s
        change = 2 * (n[0:left] - n[s:capacity]) + 2
        change[0] = 1 - 2 * n[s]  # it comes out full
        change[n[s:capacity] == 0] = 1 << 40
        k = int(change.argmin())
        if change[k] <= 2 * n[left] + 1:
            b, gap = open_bins[s + k].pop(), k
            n[s + k] -= 1
        else:
            b, gap = bins, left
            bins += 1
        out[i] = b
        if gap:
            open_bins[gap].append(b)
            n[gap] += 1
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces with sequence_id and offset. Equal rows are packed each; an empty table gives an empty frame."""
    pieces = cut(pieces)
    groups = max(1, round(pieces.count() / group_pieces))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        rows["sequence_id"] = sum_of_squares(rows["length"].to_numpy(), capacity) + (int(key[0]) << 40)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.drop(columns="deal")

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("deal").applyInPandas(run, fields)


def pack_documents(docs: DataFrame, model: str = MODEL, ranks: str = RANKS, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the one END id; equal rows are packed each; other columns are ignored.
    """
    return pack(pieces_of(docs, model, ranks, capacity), capacity)
