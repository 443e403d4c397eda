"""Problem 6: token ids of a byte-level BPE vocabulary for a whole corpus.

Texts are cut into words by the vocabulary's public pattern, with array operations over code point classes. The distinct words
of a block of the corpus (all that one task reads, in slices) are then encoded together by *merge replay*: an inverted index
from token pair to the positions where the pair stands is built once, the merges are applied in rank order, each to all its
positions, and only the pairs with the touched neighbours are entered anew. No word is encoded twice in a block and no text
leaves its row, so the corpus is never shuffled.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergamin.llm.arrow_text import code_points, flat_utf8, ranges, slices

#: Where the vocabulary files lie by default; a parameter of every operator.
TOKENIZER_DIR = "/opt/tokenizers"
#: Distinct words kept by a task before it starts a new block; bounds memory only, ids do not depend on it.
BLOCK_WORDS = 400_000

LETTER, NUMBER, SPACE, OTHER = range(4)
# The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(point))[0]
        if category == "L":
            table[point] = LETTER
        elif category == "N":
            table[point] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a word of the pattern begins; words cover the texts without gaps.

    The pattern: contractions ('s 't 're 've 'm 'll 'd), then runs of letters, of numbers or of other signs, each with one
    blank before it, then white space, whose last character stays for what follows.
    """
    points, at = code_points(data)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = character_classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
    opens[n] = True
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = points == 0x20
    inside = ~opens[:n]  # the character before belongs to the same text
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= inside
    space = kind == SPACE
    starts = run.copy()
    # A run of signs takes a blank right before it; the last white space before a run is a word of its own otherwise.
    starts[run & ~space & after_blank] = False
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~opens[1:n]
    starts |= last
    mark = np.flatnonzero((points == 0x27) & run & ~after_blank)
    mark = mark[(mark + 1 < n)]
    mark = mark[(kind[mark + 1] == LETTER) & ~opens[mark + 1]]
    if len(mark):
        first = points[mark + 1]
        second = np.where((mark + 2 < n) & ~opens[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        pair = lambda a, b: (first == ord(a)) & (second == ord(b))
        size = np.where(np.isin(first, [ord(c) for c in "stmd"]), 1, np.where(pair("r", "e") | pair("v", "e") | pair("l", "l"), 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        starts[mark + 1] = False
        rest = mark + 1 + size
        starts[rest[rest < n]] = True
    return at[starts]


class Merges:
    """A byte-level BPE vocabulary: ids of single bytes and, for every pair of ids that merges, its rank and result."""

    def __init__(self, model: str):
        content = json.loads(model)["model"]
        vocabulary, merges = content["vocab"], content["merges"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.byte_id = np.array([vocabulary[letter[b]] for b in range(256)], np.int64)
        made = set(self.byte_id.tolist())
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = vocabulary[left], vocabulary[right]
            if a not in made or b not in made:
                raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
            self.rank.setdefault(a << 20 | b, rank)
            self.result.append(vocabulary[left + right])
            made.add(self.result[-1])
        keys = np.fromiter(self.rank.keys(), np.int64)
        ranks = np.fromiter(self.rank.values(), np.int64)
        first = np.full((256, 256), -1, np.int64)  # ranks of pairs of bytes
        byte_of = {i: b for b, i in enumerate(self.byte_id.tolist())}
        for key, rank in zip(keys.tolist(), ranks.tolist()):
            if key >> 20 in byte_of and key & 0xFFFFF in byte_of:
                first[byte_of[key >> 20], byte_of[key & 0xFFFFF]] = rank
        self.first = first
        self.pairs = {rank: (key >> 20, key & 0xFFFFF) for key, rank in self.rank.items()}

    def replay(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[offsets[k]:offsets[k+1]]`` one after another, and their n+1 offsets."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        opens = np.zeros(n + 1, bool)
        opens[offsets] = True
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = self.first[data[:-1], data[1:]]
        ranks[:-1][opens[1:n]] = -1
        where = np.flatnonzero(ranks >= 0)
        order = where[np.argsort(ranks[where], kind="stable")]
        sorted_ranks = ranks[order]
        cuts = np.flatnonzero(np.diff(sorted_ranks, prepend=-1))
        ends = np.append(cuts[1:], len(order))
        order_list = order.tolist()
        index: dict[int, list[int]] = {r: order_list[a:b] for r, a, b in zip(sorted_ranks[cuts].tolist(), cuts.tolist(), ends.tolist())}
        queue = list(index)  # ascending, hence a heap
        symbol = self.byte_id[data].tolist()
        symbol.append(-1)
        following = np.arange(1, n + 1)
        following[np.flatnonzero(opens[1:])] = n
        following = following.tolist()
        previous = np.arange(-1, n - 1)
        previous[np.flatnonzero(opens[:n])] = -1
        previous = previous.tolist()
        rank_of, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        results, pairs = self.result, self.pairs
        while queue:
            rank = pop(queue)
            left, right = pairs[rank]
            new = results[rank]
            places = index.pop(rank)
            if left == right:
                places.sort()  # of overlapping pairs the first one merges
            for p in places:
                if symbol[p] != left:
                    continue
                q = following[p]
                if symbol[q] != right:
                    continue
                symbol[p] = new
                symbol[q] = -1
                q = following[q]
                following[p] = q
                if q != n:
                    previous[q] = p
                    r = rank_of(new << 20 | symbol[q])
                    if r is not None:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            push(queue, r)
                o = previous[p]
                if o >= 0:
                    r = rank_of(symbol[o] << 20 | new)
                    if r is not None:
                        if r in index:
                            index[r].append(o)
                        else:
                            index[r] = [o]
                            push(queue, r)
        ids = np.array(symbol[:n], np.int32)
        alive = ids >= 0
        return ids[alive], np.append(0, np.cumsum(alive))[offsets]


@lru_cache(maxsize=4)
def merges_of(model: str) -> Merges:
    return Merges(model)


class Block:
    """The distinct words of one block of the corpus with their ids, growing slice by slice."""

    def __init__(self, merges: Merges):
        self.merges, self.row = merges, {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def rows(self, words: pa.Array) -> np.ndarray:
        """Row of each of the distinct ``words`` in this block; unknown ones are encoded together first."""
        listed = words.to_pylist()
        if len(self.row) + len(listed) > BLOCK_WORDS and self.row:
            self.__init__(self.merges)
        fresh = [w for w in listed if w not in self.row]
        if fresh:
            ends = np.append(0, np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh))))
            ids, offsets = self.merges.replay(np.frombuffer(b"".join(fresh), np.uint8), ends)
            known = len(self.row)
            self.row.update(zip(fresh, range(known, known + len(fresh))))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
            self.ids = np.concatenate([self.ids, ids])
        return np.fromiter((self.row[w] for w in listed), np.int64, len(listed))


def encode_slice(block: Block, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: the words' rows in the block, the words' numbers of ids, and the first word of every text (n+1)."""
    starts = word_starts(data, offsets)
    bounds = np.append(starts, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    rows = block.rows(words.dictionary)[words.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
    return rows, np.diff(block.offsets)[rows], np.searchsorted(bounds[:-1], offsets)


def _encoder(model: str, with_ids: bool, types: tuple):
    """The function for ``mapInArrow``: rows (key, text) to (key, ids) or to (key, number of ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(merges_of(model.value))
        for batch in batches:
            data, offsets = flat_utf8(batch.column(1))
            for a, b in slices(offsets):
                part = offsets[a : b + 1] - offsets[a]
                rows, sizes, first = encode_slice(block, data[offsets[a] : offsets[b]], part)
                total = np.append(0, np.cumsum(sizes))[first]
                if with_ids:
                    flat = block.ids[ranges(block.offsets[rows], sizes)]
                    out = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(flat, pa.int32()))
                else:
                    out = pa.array(np.diff(total), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), out], names=list(types))

    return run


def read_model(tokenizer: str, folder: str = TOKENIZER_DIR) -> str:
    """The vocabulary file ``tokenizer``.json of ``folder``, about 1.5 MB whatever the size of the corpus."""
    with open(f"{folder}/{tokenizer}.json", encoding="utf-8") as file:
        return file.read()


def _mapped(df: DataFrame, key: str, text: str, output: str, kind: T.DataType, tokenizer: str, folder: str) -> DataFrame:
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    model = df.sparkSession.sparkContext.broadcast(read_model(tokenizer, folder))
    schema = T.StructType([T.StructField(key, rows.schema["_key"].dataType), T.StructField(output, kind)])
    return rows.mapInArrow(_encoder(model, isinstance(kind, T.ArrayType), (key, output)), schema)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", output: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row (key, ids) for every row of ``df``.

    A null and an empty text give an empty list; strings that look like special tokens are ordinary text; a null key and
    repeated rows are kept as they are; other columns are not carried, so their names cannot clash.
    """
    return _mapped(df, key, text, output, T.ArrayType(T.IntegerType()), tokenizer, folder)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", output: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """As ``token_ids``, but the number of ids only: 0 for a null or empty text."""
    return _mapped(df, key, text, output, T.LongType(), tokenizer, folder)
