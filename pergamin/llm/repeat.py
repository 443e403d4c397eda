"""Problem 8: the share of repeated content of each document.

A text is a row of words without case, punctuation and spacing. A word counts as repeated if it stands in a line, sentence or
paragraph already given earlier (a leading counter aside), in a run of eight or more words given earlier, or in a phrase of up to
seven words that follows itself directly. The shares of these kinds and plain statistics of the text are the features of
gradient-boosted trees with monotonic constraints (more repetition never lowers the score); they are fitted on documents composed
of a bounded number of labelled samples with copies of every kind and amount. The trees decide what they are sure of; where they are
not, the share of the union of all kinds, by characters, does. One pass over the texts, nothing is shuffled.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergamin.llm import boost
from pergamin.llm.arrow_text import code_points, flat_utf8, slices

#: Share of repeated content from which on a document is a case.
SHARE = 0.3
#: The trees are sure of scores below this, and above one less this; the exact share decides between.
UNSURE = 0.1
#: Words of the runs that are compared, and of the longest phrase that may loop.
RUN, LOOP = 8, 7
#: Labelled samples read for the fit at most, and documents composed of them.
SAMPLE_ROWS, COMPOSED = 1_000, 1_500

FEATURES = ("repeated_share", "run_share", "line_share", "sentence_share", "paragraph_share", "loop_share", "distinct_words", "log_words", "number_share")
CONSTRAINT = [1, 1, 1, 1, 1, 1, -1, 0, 0]
GAP, WORD, IGNORED = range(3)


@lru_cache(maxsize=1)
def character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: gap, part of a word or ignored; its compatible lower-case form; whether it opens no sentence."""
    kind = np.full(sys.maxunicode + 1, GAP, np.uint8)
    fold = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    small = np.zeros(sys.maxunicode + 1, bool)
    for point in [*range(0xD800), *range(0xE000, 0x20000)]:
        c = chr(point)
        category = unicodedata.category(c)
        if category[0] in "LNM":
            kind[point] = WORD
            small[point] = category in ("Ll", "Nd")
            plain = unicodedata.normalize("NFKC", c).lower()
            if len(plain) == 1:
                fold[point] = ord(plain)
        elif category == "Cf":
            kind[point] = IGNORED
    return kind, fold, small


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of whole numbers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), 0xD1342543DE82EF95, np.uint64)), dtype=np.uint64)


def seen_before(key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands at an earlier place."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of each text, as in FEATURES; the first is the share of repeated content."""
    texts = len(offsets) - 1
    points, at = code_points(data)
    kind, fold, small = character_tables()
    doc = np.repeat(np.arange(texts), np.diff(np.searchsorted(at, offsets)))
    keep = kind[points] != IGNORED
    points, doc = points[keep], doc[keep]
    n = len(points)
    inside = kind[points] == WORD
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(starts)
    m = len(first)
    if m == 0:
        features = np.zeros((texts, len(FEATURES)))
        features[:, 6] = 1
        return features
    letters = np.append(0, np.cumsum(inside))
    size = np.diff(np.append(letters[first], letters[n]))
    packed = np.ascontiguousarray(fold[points[inside]])
    bounds = np.append(0, np.cumsum(size * 4)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode().indices.to_numpy()
    own = doc[first]
    after = first + size  # the character behind the word; a word has no gaps
    behind = lambda k: np.where(after + k < n, points[np.minimum(after + k, n - 1)], 10)
    other_text = np.append(True, own[1:] != own[:-1])
    lines = np.cumsum(points == 10)[first]
    new_lines = np.append(1, np.diff(lines))
    blank = np.isin(points, (32, 10, 9, 13, 0xA0))
    ender = np.isin(points, [ord(c) for c in ".!?…;:"])
    ends = np.zeros(n, bool)
    ends[:-1] = ender[:-1] & blank[1:]
    sentence = (np.diff(np.append(0, np.cumsum(ends)[first])) > 0) & ~small[points[first]]
    hashed, text_key = mix(words), mix(own)
    number = np.isin(packed[letters[first]], np.arange(48, 58))
    marker = (number & (size <= 3)) | (size == 1)
    marker &= blank_of(behind(0)) | (np.isin(behind(0), [ord(c) for c in ".)]-–:ºª°/"]) & blank_of(behind(1)))
    weight = size + 1

    def units(new: np.ndarray, least: int) -> np.ndarray:
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, m))
        lead = marker[begin] & (length > 1)
        position = np.arange(m) - np.repeat(begin + lead, length)
        content = np.where(position >= 0, hashed * powers(int(length.max()))[np.maximum(position, 0)], np.uint64(0))
        key = np.add.reduceat(content, begin) ^ text_key[begin]
        repeated = seen_before(key) & (length - lead >= least)
        return np.repeat(repeated, length)

    by_line = units(other_text | (new_lines > 0), 2)
    by_sentence = units(other_text | sentence | (new_lines > 1), 3)
    by_paragraph = units(other_text | (new_lines > 1), 2)
    by_run = np.zeros(m, bool)
    if m >= RUN:
        gram = np.zeros(m - RUN + 1, np.uint64)
        for k, p in enumerate(powers(RUN)):
            gram += hashed[k : m - RUN + 1 + k] * p
        whole = own[: m - RUN + 1] == own[RUN - 1 :]
        found = np.flatnonzero(seen_before(gram ^ text_key[: m - RUN + 1]) & whole)
        cover = np.zeros(m + 1, np.int64)
        np.add.at(cover, found, 1)
        np.add.at(cover, found + RUN, -1)
        by_run = np.cumsum(cover)[:m] > 0
    by_loop = np.zeros(m, bool)
    for k in range(1, LOOP + 1):
        if m <= k:
            break
        same = np.zeros(m, bool)
        same[k:] = (words[k:] == words[:-k]) & (own[k:] == own[:-k])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for_run = (edge[1::2] - edge[::2]) >= k
        cover = np.zeros(m + 1, np.int64)
        cover[edge[::2][for_run]] += 1
        cover[edge[1::2][for_run]] -= 1
        by_loop |= np.cumsum(cover)[:m] > 0
    total = np.bincount(own, weight, texts)
    part = lambda mask: np.bincount(own, weight * mask, texts) / np.maximum(total, 1)
    count = np.bincount(own, minlength=texts)
    distinct = np.bincount(own, ~seen_before(hashed ^ text_key), texts)
    return np.stack(
        [part(by_run | by_line | by_sentence | by_paragraph | by_loop), part(by_run), part(by_line), part(by_sentence), part(by_paragraph), part(by_loop), np.where(count > 0, distinct / np.maximum(count, 1), 1), np.log1p(count), np.bincount(own, number, texts) / np.maximum(count, 1)], 1
    )


def blank_of(points: np.ndarray) -> np.ndarray:
    return np.isin(points, (32, 10, 9, 13, 0xA0))


def compose(texts: list[str], documents: int = COMPOSED, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Documents made of pieces of the samples with copies of a known amount, and the share that is copied."""
    rng = np.random.default_rng(seed)
    pool = sorted({line for t in texts for line in (t or "").split("\n") if sum(w.isalpha() for w in line.split()) > 3}) or ["a b c d e f g h i j"]
    long_lines = [line for line in pool if len(line.split()) > RUN + 2] or pool
    out, shares = [], []
    for _ in range(documents):
        target = float(rng.choice([0, 0, 0.05, 0.15, 0.22, 0.27, 0.33, 0.4, 0.55, 0.8]))
        lines = [pool[i] for i in rng.choice(len(pool), min(len(pool), int(np.exp(rng.uniform(0, 4.5)))), replace=False)]
        size, copied, how, run = sum(map(len, lines)), 0, int(rng.integers(4)), None
        parts = list(lines)
        source = lines[int(rng.integers(len(lines)))]
        while copied < target * (size + copied):
            if how == 0:  # lines, some with a counter or in capitals
                copy = lines[int(rng.integers(len(lines)))]
                copy = f"{len(parts)}. {copy}" if rng.random() < 0.3 else copy.upper() if rng.random() < 0.2 else copy
                parts.insert(int(rng.integers(parts.index(copy) + 1 if copy in parts else len(parts), len(parts) + 1)), copy)
            elif how == 1:  # one line again and again
                parts.append(copy := source)
            elif how == 2:  # a phrase that loops
                words = source.split()[: int(rng.integers(1, 6))]
                parts[-1] += " " + (copy := " ".join(words))
            else:  # a run of words within other words
                if run is None:
                    run = " ".join(long_lines[int(rng.integers(len(long_lines)))].split()[: RUN + 4])
                    parts.append(run)
                    size += len(run)
                parts[-1] += f" {rng.integers(1000)} " + (copy := run)
            copied += len(copy)
        out.append(("\n" if rng.random() < 0.6 else "\n\n" if rng.random() < 0.5 else " ").join(parts))
        shares.append(copied / max(size + copied, 1))
    return out, np.array(shares)


def train(samples: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> boost.Forest:
    """The trees, fitted on documents composed of at most ``rows`` of the samples, chosen by a hash of the text."""
    texts = [r[0] for r in samples.select(text).where(F.col(text).isNotNull()).orderBy(F.xxhash64(text), text).limit(rows).collect()]
    documents, _ = compose(texts)
    data, offsets = flat_utf8(pa.array(documents, pa.string()))
    features = np.concatenate([measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)])
    return boost.fit(features, features[:, 0] >= SHARE, CONSTRAINT)


def repeated_content(df: DataFrame, forest: boost.Forest, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every row of ``df``: key, the features and the ``score`` of the trees.

    A null, empty or blank text and one without any word have share 0 and ``distinct_words`` 1. Whole texts are measured,
    whatever their length. Null keys and repeated rows are kept as they are; other columns are not carried.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    names = [key, *FEATURES, "score"]
    schema = T.StructType([T.StructField(key, rows.schema["_key"].dataType), *(T.StructField(c, T.DoubleType()) for c in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_utf8(batch.column(1))
            for a, b in slices(offsets):
                features = measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [*features.T, forest.score(features)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=names)

    return rows.mapInArrow(run, schema)


def found(measured: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the documents that the trees are sure of, and of those they are not sure of whose share reaches SHARE, each once."""
    return measured.where((F.col("score") > 1 - UNSURE) | (F.col("score") >= UNSURE) & (F.col("repeated_share") >= SHARE)).select(key).distinct()
