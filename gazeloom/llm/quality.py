"""Text quality statistics per document, with the lines labelled by a hidden Markov model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ("prose", "code", "list", "table", "junk")
PROSE, CODE, LIST, TABLE, JUNK = range(len(LABELS))

# Common words that connect sentences, of English, German, Spanish, French, Portuguese and
# Italian. Left out are those that programs use as keywords (if, for, in, or, not, from, while, do).
COMMON_WORDS = tuple(
    "the of to and a that is was it with as on be has have had by this which you we they are its at will can but no so than more about"
    " der die das und ist nicht ein eine den dem des mit auf sich auch es wir man wenn aber noch von zu im war"
    " el los las una que de y es con por para se no lo como más pero su cuando al del son está"
    " le les des et est une dans qui pour pas sur il ce au avec plus nous"
    " o os as um uma não com é do da"
    " il di che non per sono una gli della"
    .split()
)

STRETCH = 1 << 20
"""Bytes of text whose statistics are taken at once; a longer text is a stretch of its own."""
SAMPLE = 4_000
"""Documents, as expected, on whose lines the model is fitted."""
PROSE_SHARE = 0.5
SHINGLE = 5
"""Words of a shingle."""
BLOCK = 250
"""Shingles that are compared with each other; so a long text isn't taken for repetition because it is long."""
DISTINCT_SHARE = 0.4
"""A text with fewer distinct shingles in relation to all is repetition."""
PERIODIC_SHARE = 1 - DISTINCT_SHARE
"""A text is repetition, too, if more than this share of its shingles recur at one and the same distance in words."""
SMOOTHING = 2.0
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MARKS = np.frombuffer(b".!?", np.uint8)

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
GENTLE = np.zeros(256, bool)  # marks that prose has too
GENTLE[list(b".,'\"!?-:;()")] = True
HARD = ~(LETTERS | DIGITS | BLANKS | GENTLE)
DELIMITERS = np.zeros(256, bool)
DELIMITERS[list(b",;\t|")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ENDS = np.full(256, 3, np.int64)  # 0 ends a sentence, 1 ends code, 2 goes on, 3 anything else
ENDS[list(b".!?")] = 0
ENDS[list(b"{}()[]<>=\\|+*/&%$")] = 1
ENDS[list(b",:;-")] = 2
SIZES = (5, 6, 5, 4, 4, 6, 2, 3)
"""Number of values of each line feature: common words, words, symbols, digits, end, start, indent, delimiters."""


@dataclass
class Lines:
    """Statistics of the non-blank lines of some texts, in order."""

    text: np.ndarray
    length: np.ndarray
    words: np.ndarray
    common: np.ndarray
    ends_sentence: np.ndarray
    features: np.ndarray
    word_text: np.ndarray
    word_hash: np.ndarray
    letters: np.ndarray
    symbols: np.ndarray
    """letters and symbols are per text."""


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash (case ignored) of each run of letters."""
    mask = LETTERS[data]
    edges = np.diff(mask.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(begins):
        return begins, np.zeros(0, np.uint64)
    lengths = ends - begins
    firsts = np.cumsum(lengths) - lengths
    letters = LOWER[data[mask]]
    powers = np.ones(lengths.max(), np.uint64)
    powers[1:] = FACTOR
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    return begins, np.add.reduceat((letters + np.uint64(1)) * powers[place], firsts)


COMMON_HASHES = np.unique(word_hashes(np.frombuffer(" ".join(COMMON_WORDS).encode(), np.uint8))[1])


def line_statistics(texts: list[bytes]) -> Lines:
    """All lines of the texts at once. Lines end with LF or CR; blank ones are passed over."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)  # a line feed ends each text
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    texts_begin = np.cumsum(sizes) - sizes
    breaks = np.flatnonzero((data == 10) | (data == 13))
    begins = np.append(0, breaks[:-1] + 1)
    ends = breaks
    total = lambda mask: np.append(0, np.cumsum(mask, dtype=np.int64))
    ink = total(~BLANKS[data])
    full = ink[ends] > ink[begins]
    begins, ends = begins[full], ends[full]
    of_text = np.searchsorted(texts_begin, begins, side="right") - 1

    inked = np.flatnonzero(~BLANKS[data])
    first = inked[ink[begins]] if len(begins) else begins
    last = inked[ink[ends] - 1] if len(begins) else ends
    length = ink[ends] - ink[begins]
    span = lambda mask: (lambda s: s[ends] - s[begins])(total(mask))
    letters, digits, hard, delimiters = span(LETTERS[data]), span(DIGITS[data]), span(HARD[data]), span(DELIMITERS[data])
    word_begin, hashes = word_hashes(data)
    is_common = np.isin(hashes, COMMON_HASHES)
    at = np.searchsorted(word_begin, begins), np.searchsorted(word_begin, ends)
    upto = total(is_common)
    words, common = at[1] - at[0], upto[at[1]] - upto[at[0]]

    closing = np.isin(data[last], np.frombuffer(b"\"')*_", np.uint8)) & (last > first)
    ending = data[np.where(closing, last - 1, last)]
    bins = (
        np.digitize(np.divide(common, np.maximum(words, 1)), [1e-9, 0.15, 0.3, 0.45]),
        np.digitize(words, [1, 2, 4, 8, 16]),
        np.digitize(hard / np.maximum(length, 1), [1e-9, 0.03, 0.08, 0.2]),
        np.digitize(digits / np.maximum(length, 1), [1e-9, 0.1, 0.3]),
        ENDS[ending],
        _starts(data, first, ends),
        np.minimum(first - begins, 1),
        np.digitize(delimiters / np.maximum(words + digits / 4, 1), [1e-9, 0.4]),
    )
    n = len(texts)
    word_text = np.searchsorted(texts_begin, word_begin, side="right") - 1
    per_text = lambda v: np.bincount(of_text, v, n).astype(np.int64)
    return Lines(
        of_text, length, words, common, np.isin(ending, MARKS), np.stack(bins, 1).astype(np.int8) if len(begins) else np.zeros((0, len(SIZES)), np.int8),
        word_text, hashes, per_text(letters), per_text(length - letters - digits),
    )


def _starts(data: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How each line starts: 0 a word, 1 a list mark, 2 a comment mark, 3 a table mark, 4 a quotation mark, 5 other."""
    byte = lambda i: np.where(first + i < ends, data[np.minimum(first + i, len(data) - 1)], 32)
    a, b, c = byte(0), byte(1), byte(2)
    kind = np.where(LETTERS[a] | DIGITS[a], 0, 5)
    bullet = ((a == 45) | (a == 42) | (a == 43)) & (b == 32)
    numbered = DIGITS[a] & ((b == 46) | (b == 41) | (DIGITS[b] & ((c == 46) | (c == 41))))
    kind[bullet | numbered | (a == 91)] = 1
    comment = ((a == 47) & ((b == 47) | (b == 42))) | ((a == 42) & (b == 47)) | ((a == 45) & (b == 45)) | ((a == 34) & (b == 34) & (c == 34))
    kind[comment | (a == 35)] = 2
    kind[a == 124] = 3
    kind[(a == 62) | (a == 34) | (a == 39) | (a == 40)] = np.where(comment, 2, 4)[(a == 62) | (a == 34) | (a == 39) | (a == 40)]
    return kind


def seed_labels(lines: Lines) -> np.ndarray:
    """Plain rules that label the clear lines, to fit the model on; -1 for the others."""
    f = lines.features.astype(np.int64)
    common, words, symbols, digits, end, start, indent, delimiters = f.T
    label = np.full(len(f), -1)
    label[(common == 0) & (words >= 4) & (symbols <= 1)] = JUNK
    label[(words == 0) & (digits < 3)] = JUNK
    label[(symbols >= 2) & (common <= 1)] = CODE
    label[(end == 1) & (common <= 1)] = CODE
    label[(indent == 1) & (common == 0)] = CODE
    label[(digits >= 2) & (delimiters >= 1) | (start == 3) | (digits == 3) | ((delimiters == 2) & (common == 0) & (words >= 3))] = TABLE
    label[(start == 1) & (words <= 5) & (end != 0) & (common <= 3)] = LIST
    label[(words <= 2) & (words > 0) & (end == 3) & (common == 0) & (start != 2) & (digits < 2) & (indent == 0) & (symbols <= 1)] = LIST
    label[(common >= 3) & (words >= 4) & (symbols <= 1) & (digits <= 1) & (start != 2)] = PROSE
    label[(start == 2) & ((indent == 1) | (end == 0) | (words >= 8))] = CODE
    return label


@dataclass
class Model:
    """Log probabilities: start[k], step[k, l], and per feature emission[f][value, k]."""

    start: np.ndarray
    step: np.ndarray
    emission: list[np.ndarray]

    def score(self, features: np.ndarray) -> np.ndarray:
        return sum(e[features[:, i]] for i, e in enumerate(self.emission))

    def label(self, lines: Lines) -> np.ndarray:
        """The most likely labels of all texts' lines, all texts in step."""
        n = len(lines.text)
        labels = np.zeros(n, np.int8)
        if not n:
            return labels
        texts, begin, count = np.unique(lines.text, return_index=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        begin, count = begin[order], count[order]
        score = self.score(lines.features)
        came = np.zeros((n, len(LABELS)), np.int8)
        best = self.start + score[begin]
        active = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right")  # texts with at least that many lines
        finals = np.empty_like(best)
        for t in range(1, count[0]):
            k = active[t]
            finals[k : len(best)] = best[k:]
            ways = best[:k, :, None] + self.step
            row = begin[:k] + t
            came[row] = ways.argmax(1)
            best = ways.max(1) + score[row]
        finals[: len(best)] = best
        state = finals.argmax(1)
        for t in range(count[0] - 1, -1, -1):
            k = active[t]
            row = begin[:k] + t
            labels[row] = state[:k]
            state[:k] = came[row, state[:k]]
        return labels


def fit_model(counts: pd.DataFrame) -> Model:
    """The model from counted seed labels (see count_seeds), smoothed."""
    k = len(LABELS)
    start, step, emission = np.full(k, SMOOTHING), np.full((k, k), SMOOTHING), [np.full((n, k), SMOOTHING) for n in SIZES]
    for what, a, b, n in counts[["what", "a", "b", "n"]].itertuples(index=False):
        if what == -2:
            start[a] += n
        elif what == -1:
            step[a, b] += n
        else:
            emission[what][a, b] += n
    return Model(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), [np.log(e / e.sum(0)) for e in emission])


def _stretches(texts: pa.Array, ids: pa.Array) -> Iterator[tuple[list, list[bytes]]]:
    chosen, size = [], 0
    for i in range(len(texts)):
        chosen.append((ids[i], (texts[i].as_py() or "").encode("utf-8", "replace")))
        size += len(chosen[-1][1])
        if size >= STRETCH:
            yield [c[0] for c in chosen], [c[1] for c in chosen]
            chosen, size = [], 0
    if chosen:
        yield [c[0] for c in chosen], [c[1] for c in chosen]


def count_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of seed labels: what -2 first lines, -1 steps between neighbours, else a feature's values."""
    for batch in batches:
        for _, texts in _stretches(batch.column("_text"), batch.column("_id")):
            lines = line_statistics(texts)
            label = seed_labels(lines)
            rows = []
            first = np.diff(lines.text, prepend=-1) > 0
            known = label >= 0
            pairs = [(-2, label[first & known], np.zeros(int((first & known).sum()), int))]
            both = known[1:] & known[:-1] & ~first[1:]
            pairs.append((-1, label[:-1][both], label[1:][both]))
            pairs += [(i, lines.features[known, i].astype(int), label[known]) for i in range(len(SIZES))]
            for what, a, b in pairs:
                cells, n = np.unique(np.stack([a, b], 1), axis=0, return_counts=True)
                rows += [(what, int(x), int(y), int(c)) for (x, y), c in zip(cells, n)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["what", "a", "b", "n"]).astype("int64"), preserve_index=False)


STATISTICS = T.StructType(
    [T.StructField("n_words", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share", "distinct_shingle_share", "periodic_shingle_share")]
    + [T.StructField(f"{n}_share", T.DoubleType()) for n in LABELS]
)


def document_statistics(texts: list[bytes], model: Model) -> pd.DataFrame:
    """One row of STATISTICS per text."""
    lines = line_statistics(texts)
    n = len(texts)
    label = model.label(lines)
    sums = lambda v, m=None: np.bincount(lines.text if m is None else lines.text[m], v if m is None else v[m], n)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    words, length = sums(lines.words), sums(lines.length)
    count = np.bincount(lines.text, minlength=n)
    out = pd.DataFrame(
        {
            "n_words": words.astype(np.int64),
            "mean_word_length": ratio(lines.letters, words),
            "symbol_ratio": ratio(lines.symbols, length),
            "punctuated_line_share": ratio(sums(lines.ends_sentence), count),
            "common_word_share": ratio(sums(lines.common), words),
        }
    )
    for k, name in enumerate(LABELS):
        out[f"{name}_share"] = ratio(sums(lines.length, label == k), length)
    out["distinct_shingle_share"] = 1.0
    likely = np.flatnonzero((out["prose_share"] >= PROSE_SHARE).to_numpy())
    out["periodic_shingle_share"] = 0.0
    shingles = shingle_hashes(lines, likely)
    out.loc[likely, "distinct_shingle_share"] = distinct_shares(*shingles)
    out.loc[likely, "periodic_shingle_share"] = periodic_shares(*shingles)
    return out[STATISTICS.names]


def shingle_hashes(lines: Lines, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the shingles of SHINGLE words of the chosen texts: hash, number among the chosen texts, place in it; and each text's number of shingles."""
    begin, end = np.searchsorted(lines.word_text, texts), np.searchsorted(lines.word_text, texts, side="right")
    n = np.maximum(end - begin - SHINGLE + 1, 0)
    of = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[of] + place
    hashes = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        hashes = hashes * FACTOR + lines.word_hash[at + j]
    return hashes, of, place, n


def distinct_shares(hashes: np.ndarray, of: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distinct shingles in relation to all, within blocks of BLOCK; 1 for texts without shingles."""
    block = (of << 32 | place // BLOCK).astype(np.uint64)
    first = np.unique(hashes ^ (block * FACTOR), return_index=True)[1]
    return np.divide(np.bincount(of[first], minlength=len(n)), n, out=np.ones(len(n)), where=n > 0)


def periodic_shares(hashes: np.ndarray, of: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Share of a text's shingles whose last occurrence is as many words back as it most often is, however long the text and what it repeats."""
    order = np.lexsort((place, hashes, of))
    h, text, at = hashes[order], of[order], place[order]
    again = np.flatnonzero((h[1:] == h[:-1]) & (text[1:] == text[:-1])) + 1
    if not len(again):
        return np.zeros(len(n))
    distance, count = np.unique(np.stack([text[again], at[again] - at[again - 1]]), axis=1, return_counts=True)
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, distance[0], count)
    return np.divide(most, n, out=np.zeros(len(n)), where=n > 0)


def fitted_model(documents: DataFrame, ident: str, text: str, sample: int = SAMPLE) -> Model:
    """The model fitted on the lines of about `sample` documents, drawn by a hash of their id."""
    total = documents.count()
    share = min(1.0, sample / max(total, 1))
    drawn = documents.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text"))
    if share < 1:
        drawn = drawn.where(F.xxhash64("_id") < F.lit(int(share * 2**64) - 2**63))
    counts = drawn.mapInArrow(count_seeds, "what bigint, a bigint, b bigint, n bigint").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    return fit_model(counts.toPandas())  # a row per feature value and label


def quality_statistics(documents: DataFrame, ident: str, text: str, model: Model | None = None) -> DataFrame:
    """Per document: (ident, the columns of STATISTICS, kind).

    Words are runs of letters; the symbol ratio counts what is neither letter, digit nor blank, of
    all that isn't blank (bytes, in UTF-8); punctuated_line_share is of the non-blank lines;
    common words are COMMON_WORDS. Every line gets one of LABELS by the most likely path of a
    hidden Markov model over the lines' statistics; a label's share is of the document's non-blank
    bytes. Unless given, the model is fitted on the lines that plain rules label, of a sample of
    SAMPLE documents; it has as many parameters whatever the input. kind is prose where prose has
    PROSE_SHARE of the text and it is no repetition, repetition where it is: where fewer than
    DISTINCT_SHARE of its shingles are distinct, within blocks, or more than PERIODIC_SHARE recur at
    one distance, over the whole text. Else it is the label with the largest share (the first of equals), or empty for a text without
    ink. distinct_shingle_share and periodic_shingle_share are taken where prose prevails; they are 1
    and 0 elsewhere.

    A null text is empty. Repeated rows give repeated results; null ids are kept. All of each text
    counts. The work is one pass without a shuffle.
    """
    model = model or fitted_model(documents, ident, text)
    schema = T.StructType([T.StructField("_id", documents.schema[ident].dataType), *STATISTICS.fields])

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _stretches(batch.column("_text"), batch.column("_id")):
                rows = pa.RecordBatch.from_pandas(document_statistics(texts, model), preserve_index=False)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], batch.schema.field("_id").type), *rows.columns], names=schema.names)

    rows = documents.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(statistics, schema)
    shares = [F.struct(F.col(f"{n}_share").alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(LABELS)]
    largest = F.array_max(F.array(*shares))
    kind = (
        F.when(largest["s"] == 0, "empty")
        .when(is_prose(), "prose")
        .when(F.col("prose_share") >= PROSE_SHARE, "repetition")
        .otherwise(largest["n"])
    )
    return rows.select(F.col("_id").alias(ident), *STATISTICS.names, kind.alias("kind"))


def is_prose() -> Column:
    new = (F.col("distinct_shingle_share") >= DISTINCT_SHARE) & (F.col("periodic_shingle_share") <= PERIODIC_SHARE)
    return (F.col("prose_share") >= PROSE_SHARE) & new

