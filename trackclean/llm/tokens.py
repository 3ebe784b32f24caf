"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at boundaries that no token crosses, so the lengths of its parts add up to the length of the whole; that
bounds what the library is handed at once, however long the text. Parts that recur are encoded once for each batch of
misses. Arrow batches are cut so that each holds about the same number of bytes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Texts are handled in groups of about so many bytes; so many parts' lengths are remembered.
GROUP_BYTES = 4 << 20
REMEMBERED = 400_000
#: Characters of a part without spaces beyond which it is cut on.
LONGEST = 1 << 16
MARK = "▁"
#: A part in the library's own spelling of spaces: marks, then anything up to the next mark.
PART = re.compile(f"{MARK}+[^{MARK}]*")


def balanced(batch: pa.RecordBatch, column: str, most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of the column each (a longer text is a slice of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


class PieceCounter:
    """Lengths of texts under a sentencepiece model of which no piece goes on past a mark that follows another character.

    Parts of more than longest characters are cut on between two characters that stand next to each other in no piece:
    both are pieces of their own that Unicode's compatibility form leaves alone, as is the one behind them.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, longest: int = LONGEST) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.plain = {p for p in pieces if len(p) == 1 and p != MARK and unicodedata.normalize("NFKC", p) == p and not unicodedata.combining(p)}
        self.known: dict[str, int] = {}
        self.remembered = remembered
        self.longest = longest

    def parts(self, text: str) -> list[str]:
        """The text's parts, each without the mark that the library puts in front of what it encodes."""
        if not text:
            return []
        if not self.splits:
            return [text]
        plain = text.split(" ")
        if "" not in plain and MARK not in text:
            return plain
        return [p[1:] for p in PART.findall(MARK + text.replace(" ", MARK))]

    def cut(self, part: str) -> tuple[list[str], list[str]]:
        """(pieces of a long part, characters that they have too much): every piece but the first starts with the character
        in front of it, as the library puts a mark before what it encodes."""
        out, extra, start, i = [], [], 0, self.longest
        while i < len(part) - 1:
            a, b, c = part[i - 1 : i + 2]
            if a in self.plain and b in self.plain and c in self.plain and a + b not in self.joined:
                out.append(part[start:i])
                extra.append(a)
                start, i = i - 1, i + self.longest
            else:
                i += 1
        return [*out, part[start:]], extra

    def counts(self, texts: list[str]) -> list[int]:
        known = self.known
        split = [self.parts(t) for t in texts]
        extra: dict[int, list[str]] = {}
        for k, parts in enumerate(split):
            if len(texts[k]) > self.longest and self.splits and any(len(p) > self.longest for p in parts):
                cuts = [self.cut(p) for p in parts]
                split[k] = [x for c in cuts for x in c[0]]
                extra[k] = [x for c in cuts for x in c[1]]
        if len(known) > self.remembered:
            known.clear()
        new = list({p for parts in [*split, *extra.values()] for p in parts if p not in known})
        # the library encodes an empty text as nothing, but an empty part stands for a lone mark: one piece
        known.update(zip(new, (len(x) if p else 1 for p, x in zip(new, self.model.encode(new, num_threads=1), strict=True)), strict=True))
        return [sum(map(known.__getitem__, parts)) - sum(known[x] for x in extra.get(k, ())) for k, parts in enumerate(split)]


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text, without begin, end or added tokens.

    Null and empty texts have 0 bytes and tokens; equal rows are counted alike; other columns are ignored; an empty
    table gives an empty frame. model: a file of the public tokenizers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = PieceCounter(public_tokenizers.path(model))
        for whole in batches:
            for batch in balanced(whole, "text"):
                sizes = pc.binary_length(batch.column("text")).cast(pa.int64())
                counts = pa.array(counter.counts(batch.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, counts], ["doc_id", "n_bytes", "n_tokens"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return x.withColumn("over_limit", F.col("n_tokens") > limit)
