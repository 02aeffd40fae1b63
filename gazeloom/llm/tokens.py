"""Token counts by a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's tokenizer cuts text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")

STRETCH = 1 << 19
"""Bytes of text that are cut into pieces at once; a longer text is a stretch of its own."""
LETTER, DIGIT, SPACE, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def token_counts(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of each text, all of it; null for null.

    vocabulary is a file that every worker can read.
    """

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        counter = _counter(vocabulary)
        known = texts.notna()
        counts = pd.Series(counter(texts[known].tolist()), index=texts.index[known], dtype="Int64")
        return counts.reindex(texts.index)

    return count.asNondeterministic()(text)


@lru_cache(maxsize=2)
def _counter(vocabulary: str) -> TokenCounter:
    return TokenCounter(vocabulary)


class TokenCounter:
    """Counts tokens of many texts; equal pieces are tokenized once.

    ASCII texts are cut into pieces for a whole stretch of bytes at a time. A piece is known by a
    64-bit hash of its bytes. Other texts go to the tokenizer as they are.
    """

    KNOWN = 1 << 21
    """Pieces remembered."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[int, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        stretch: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text.isascii():
                counts[i] = len(self.encoding.encode_ordinary(text))
            elif text:
                stretch.append(i)
                size += len(text)
                if size >= STRETCH:
                    counts[stretch] = self._count(texts, stretch)
                    stretch, size = [], 0
        if stretch:
            counts[stretch] = self._count(texts, stretch)
        return counts

    def _count(self, texts: list[str], chosen: list[int]) -> np.ndarray:
        data = np.frombuffer("".join(texts[i] for i in chosen).encode("ascii"), np.uint8)
        begins = np.cumsum([0, *[len(texts[i]) for i in chosen[:-1]]])
        starts = piece_starts(data, begins)
        hashes = piece_hashes(data, starts)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.KNOWN:
            self.known.clear()
        ends = np.append(starts[1:], len(data))
        each = np.empty(len(distinct), np.int64)
        for j, (h, f) in enumerate(zip(distinct.tolist(), first.tolist())):
            n = self.known.get(h)
            if n is None:
                piece = data[starts[f] : ends[f]].tobytes().decode("ascii")
                n = self.known[h] = len(self.encoding.encode_ordinary(piece))
            each[j] = n
        return np.add.reduceat(each[which], np.searchsorted(starts, begins))


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where PATTERN's pieces begin in the ASCII texts that begin at begins of data."""
    kind = KIND[data]
    change = np.empty(len(data), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[begins] = True
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], len(data))
    of_text = np.zeros(len(data) + 1, bool)
    of_text[begins] = True
    of_text[-1] = True
    space = kind[runs] == SPACE
    followed = space & ~of_text[ends]
    blank = data[ends - 1] == 32
    starts = np.zeros(len(data), bool)
    starts[runs] = True
    starts[ends[followed] - 1] = True  # the last space of a run stands alone or joins what follows
    starts[ends[followed & blank]] = False
    # contractions begin at an apostrophe that begins a piece
    mark = np.flatnonzero(starts & (data == 39))
    mark = mark[(mark + 1 < len(data))]
    mark = mark[~of_text[mark + 1]]
    after = np.zeros((len(mark), 2), np.uint8)
    after[:, 0] = data[mark + 1]
    two = mark + 2 < len(data)
    two[two] = ~of_text[mark[two] + 2]
    after[two, 1] = data[mark[two] + 2]
    length = np.zeros(len(mark), np.int64)
    for ending in CONTRACTIONS:
        fits = after[:, 0] == ord(ending[0])
        if len(ending) == 2:
            fits &= after[:, 1] == ord(ending[1])
        length[fits & (length == 0)] = len(ending)
    mark, length = mark[length > 0], length[length > 0]
    starts[mark + 1] = False
    rest = mark + 1 + length
    rest = rest[rest < len(data)]
    starts[rest] = True
    return np.flatnonzero(starts)


def piece_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each piece's bytes."""
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    powers = np.ones(lengths.max(), np.uint64)
    powers[1:] = FACTOR
    powers = np.multiply.accumulate(powers)
    return np.add.reduceat((data + np.uint64(1)) * powers[place], starts)
