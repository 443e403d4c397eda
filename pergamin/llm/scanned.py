"""Problem 3: noise in text from scanned pages.

One pass counts all words and word pairs of the corpus. Words are grouped by the skeleton of their glyphs (glyphs that scanners
confuse are one), and a rare or dominated form is read as the frequent form of its group; joins by skeleton find it among all
words, whatever their number. Lines are dealt to buckets by page, and every bucket reads the entries of its own words first, so
the dictionary is nowhere broadcast and nowhere cut. A corrected word counts if the pair it makes with a neighbouring word
occurs in the corpus, which is a join of the few lines in question. Headers are lines at the edges of pages that recur on other
pages once their page number is masked. Only lines that have some noise, lie at an edge or open a page go on from the one pass
over all lines; paragraphs are made of the others by SQL windows over pages. No document, however long, is one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergamin.functions import catalogue as C
from pergamin.llm import buckets as B
from pergamin.llm.arrow_text import flat_utf8, slices, tokens_of
from pergamin.llm.lookalike import LIGATURES, mapping
from pergamin.operators import skew
from pergamin.session import spread, write_through

#: Occurrences from which on a word or a pair of words is known, whatever the size of the corpus.
COUNT = 5
#: A frequent form is still a misreading if another form of its group is so many times as frequent.
DOMINANCE = 30
#: Lines from the top or bottom of a page that can be a header, a footer or a page number.
EDGE = 3

# Glyphs that scanners take for one another; all of an entry share one skeleton. First single ones, then pairs.
CONFUSED = {"c": "e", "0": "o", "@": "a", "l": "i", "!": "i", "1": "i", "|": "i", "f": "t", "5": "s", "$": "s", "b": "h", "9": "g", "8": "h"}
CONFUSED_PAIRS = (("ii", "u"), ("vv", "w"), ("ri", "n"), ("rn", "m"), ("nt", "m"))
D_LIKE = re.compile("c[l1!|]")
VARIANTS = ((True, CONFUSED_PAIRS), (False, CONFUSED_PAIRS), (True, (("ri", "n"), *CONFUSED_PAIRS)), (False, (("ri", "n"), *CONFUSED_PAIRS)))
# What a 6 may stand for in a word.
SIX = "aoh"
HYPHENS = "-‐‑¬­"
CONFUSED_TABLE = str.maketrans(CONFUSED | {chr(k): None for k in range(0x300, 0x370)})
EDGE_SIGNS = re.compile(r"^[^\w@!|$]+|[^\w@]+$")
CAPITAL_I = re.compile(r"[a-zà-ÿ]I")
AMOUNT = re.compile(r"[\dOoIlSB]{1,3}(?:[.,][\dOoIlSB]{3})*,[\dOoIlSB]{2}")
ADDRESS = re.compile(r"\S@\S+\.\w|://|www\.")
TAIL = re.compile(rf"(?:^|[\s(\"“‘/;]|[^\W\d_][{HYPHENS}])([^\W\d_]{{2,}})[{HYPHENS}]\s*$")
HEAD = re.compile(r"\s*([^\W\d_]+)")
# A page number in any style: arabic or roman, alone or with its word, between dashes or brackets, with the number of pages.
NUMBER = r"(?:\d{1,5}|[IVXLCivxlc]{1,7})"
PAGE_WORD = r"(?:p(?:[áa]gs?|[áa]gina|age|g)?|fl?s?|folhas?|fojas?|hoja|sheet)\b\.?\s*(?:n[.ºo°]*\s*)?"
PAGE_NO = re.compile(rf"[\W_]*(?:{PAGE_WORD})?[\W_]*{NUMBER}(?:\s*(?:/|de|of|-)\s*{NUMBER})?[\W_]*", re.I)
PAGE_END = re.compile(rf"(?:\s*[-–—|•·,:(\[]\s*(?:{PAGE_WORD})?|\s+{PAGE_WORD}|\s{{2,}}){NUMBER}(?:\s*(?:/|de|of)\s*{NUMBER})?[\W_]*$", re.I)
PAGE_START = re.compile(rf"^[\W_]*(?:(?:{PAGE_WORD}){NUMBER}(?:\s*(?:/|de|of)\s*{NUMBER})?\s*[-–—|•·,:)\]]?|{NUMBER}\s*[-–—|•·:)\]])\s+(?=\D)", re.I)

DIGITS = re.compile("[0-9]+")
ODD_SIGNS = "0@!1|5$986"
FRAGMENT = re.compile(r"\s*[^\W\d_]*[aeiouáàâãéêíóôõú][^\W\d_]*[.,;:]?(?:\s[^\W\d_]+[-.,;:]?)?\s*", re.I)
NUMBERED = re.compile(rf"\s[-–—|•·]\s*(?:{PAGE_WORD})?{NUMBER}(?:\s*(?:/|de|of)\s*{NUMBER})?\W*$", re.I)
FOREIGN = re.compile("[^\x00-\x9f\xa1-\xac\xae-\xff–—“”‘’•…]")
_MAP = None


def plain(text: str) -> str:
    """The text in the characters it looks like, accents composed, zero-width characters gone."""
    global _MAP
    if not FOREIGN.search(text):
        return text
    if _MAP is None:
        _MAP = str.maketrans(dict(zip(*mapping())) | LIGATURES | dict.fromkeys([0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF]))
    text = text.translate(_MAP)
    if "\xad" in text:
        text = re.sub(r"\xad(?!\s*$)", "", text)
    return unicodedata.normalize("NFC", text)


def word_of(token: str) -> str:
    """A token without signs around it, in lower case; a capital I within small letters is the l it looks like."""
    return lower_word(EDGE_SIGNS.sub("", plain(token)))


def lower_word(core: str) -> str:
    if "I" in core and not core.isupper():
        core = re.sub(r"(?<=[a-zà-ÿ])I", "l", core)
    return core.lower()


def skeleton(word: str, d_like: bool = True, pairs: tuple = CONFUSED_PAIRS) -> str:
    """The glyphs of a lower-case word with those that are confused made one, accents aside. ``d_like``: cl is read as d;
    ``pairs``: the pairs in the order in which they are tried."""
    letters = word if word.isascii() else unicodedata.normalize("NFD", word)
    if d_like:
        letters = D_LIKE.sub("d", letters)
    letters = letters.translate(CONFUSED_TABLE)
    while True:
        shorter = letters
        for pair, one in pairs:
            shorter = shorter.replace(pair, one)
        if shorter == letters:
            return letters
        letters = shorter


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) ^ (b + np.int64(0x7F4A7C15))


def hash_words(words: list[str]) -> np.ndarray:
    return np.array([pair_hash(w) for w in words], np.int64)


#: Signs of tokens that are seen at once to be no words.
BARE = "0123456789.,;:-/()[]\"'"
BARE_BYTES = BARE.encode()


def pair_hash(word: str) -> int:
    """Of a word as a neighbour of others; whatever has no letter is one word."""
    return int.from_bytes(blake2b(word.encode() if any(map(str.isalpha, word)) else b"0", digest_size=8).digest(), "little", signed=True)


def correctable(word: str) -> bool:
    """Whether a word is made of letters, of signs that scanners take for letters and of hyphens: all others are no words."""
    letters = sum(map(str.isalpha, word))
    return letters >= 2 and letters + sum(map(word.count, ODD_SIGNS)) + word.count("-") == len(word)


class Merged:
    """Whole numbers with their counts, merged now and then, so memory follows the different ones."""

    def __init__(self):
        self.keys, self.counts, self.parts, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > 1_000_000:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        counts = np.concatenate([self.counts, *(n for _, n in self.parts)])
        self.keys, index = np.unique(keys, return_inverse=True)
        self.counts, self.parts, self.size = np.bincount(index, counts, len(self.keys)).astype(np.int64), [], 0


COUNTS = "kind int, bucket int, word string, hash long, n long, small long"


def corpus_counts(texts: DataFrame, form: Callable[[str], str] = str) -> DataFrame:
    """Counts over all rows (bucket, text): (kind, bucket, word, hash, n, small); kind 0 words of each bucket with their occurrences
    in small letters, kind 1 hashes of known pairs of neighbouring words of a line. Counted within every task first; rows of a null
    bucket count, but need no entries. Words are counted in this ``form`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")  # hashes wrap around
        numbers: dict[str, int] = {}  # of words; a cell is bucket, word and whether it is in small letters
        known: dict[bytes, tuple[int, int]] = {}  # token: number of its word and small, or -1; hash of the word
        bare = pair_hash("")
        cells, pairs = Merged(), Merged()
        for batch in batches:
            data, offsets = flat_utf8(batch.column(1))
            own = batch.column(0).fill_null(-1).to_numpy().astype(np.int64) + 1
            for a, b in slices(offsets):
                tokens, first, opens = tokens_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(tokens):
                    continue
                coded = tokens.dictionary_encode()
                entries = []
                for raw in coded.dictionary.to_pylist():
                    entry = known.get(raw)
                    if entry is None:
                        if raw.strip(BARE_BYTES):
                            t = raw.decode("utf-8", "ignore")
                            w = word_of(t)
                            number = numbers.setdefault(form(w), len(numbers)) * 2 + t[:1].islower() if len(w) > 1 and w.isalpha() or correctable(w) else -1
                            entry = number, pair_hash(w)
                        else:
                            entry = -1, bare
                        known[raw] = entry
                    entries.append(entry)
                numbered, hashed = np.array(entries, np.int64).T[:, coded.indices.to_numpy()]
                cell = (np.repeat(own[a:b], np.diff(first)) << 33) + numbered
                cells.add(cell[numbered >= 0])
                pairs.add(pair_key(hashed[:-1], hashed[1:])[~opens[1:]])
            if len(known) > 400_000 or len(cells.keys) > 1_000_000 or len(pairs.keys) > 2_000_000:
                yield from listed(cells, list(numbers))
                yield from paired(pairs)
                numbers, known, cells, pairs = {}, {}, Merged(), Merged()
        yield from listed(cells, list(numbers))
        yield from paired(pairs)

    def listed(cells: Merged, words: list[str]) -> Iterator[pa.RecordBatch]:
        cells.merge()
        keys, index = np.unique(cells.keys >> 1, return_inverse=True)
        n = np.bincount(index, cells.counts, len(keys)).astype(np.int64)
        small = np.bincount(index, cells.counts * (cells.keys & 1), len(keys)).astype(np.int64)
        number = keys & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(keys), np.int32)), pa.array(((keys >> 32) - 1).astype(np.int32)), pa.array(words, pa.string()).take(pa.array(number)), pa.array(np.zeros(len(keys), np.int64)), pa.array(n), pa.array(small)],
            names=["kind", "bucket", "word", "hash", "n", "small"],
        )

    def paired(pairs: Merged) -> Iterator[pa.RecordBatch]:
        pairs.merge()
        n = len(pairs.keys)
        zero = pa.array(np.zeros(n, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.string()), pa.array(pairs.keys), pa.array(pairs.counts), zero], names=["kind", "bucket", "word", "hash", "n", "small"])

    counted = texts.select(F.col("bucket").cast("int"), F.col("text").cast("string")).mapInArrow(run, COUNTS)
    return counted.groupBy("kind", "bucket", "word", "hash").agg(F.sum("n").alias("n"), F.sum("small").alias("small")).where((F.col("kind") == 0) | (F.col("n") >= COUNT))


def totals(counts: DataFrame) -> DataFrame:
    """The words of the corpus: (word, n, small)."""
    return counts.where("kind = 0").groupBy("word").agg(F.sum("n").alias("n"), F.sum("small").alias("small"))


def known_pairs(counts: DataFrame) -> DataFrame:
    return counts.where("kind = 1").select("hash")


def form_skeletons(word: str) -> set[str]:
    """The skeletons under which a known word is found; none for what is not made of letters and hyphens."""
    if not all(p.isalpha() for p in word.split("-")):
        return set()
    return {skeleton(word), skeleton(word, False)}


def variant_skeletons(word: str) -> set[str]:
    """The skeletons of the known words that this one may be a misreading of."""
    if len(word) < 4 or sum(map(word.count, ODD_SIGNS)) * 3 > len(word):
        return set()
    found = set()
    for variant in [word.replace("6", c) for c in SIX] if "6" in word else [word]:
        for d_like, pairs in VARIANTS[: 4 if "r" in variant else 2]:
            if d_like or "c" in variant:  # else the same as with it
                found.add(skeleton(variant, d_like, pairs))
    return found


def _exploded(words: DataFrame, skeletons) -> DataFrame:
    """Rows (skeleton, word, n, small) for every skeleton of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [skeletons(w) for w in batch.column(0).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.string()), *(batch.column(k).take(at) for k in range(3))], names=["skeleton", "word", "n", "small"])

    return words.select("word", "n", "small").mapInArrow(run, "skeleton string, word string, n long, small long")


def word_entries(counts: DataFrame) -> DataFrame:
    """What a reader of a bucket must know of its words: (bucket, word, n, small, form, form_n, form_small), form being the most
    frequent known word that it may be a misreading of. Words that are neither known nor a misreading have no entry."""
    words = totals(counts)
    forms = _exploded(words.where(F.col("n") >= COUNT), form_skeletons).groupBy("skeleton").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("word").alias("form"), F.col("small").alias("small"))).alias("_f"))
    variants = _exploded(words, variant_skeletons).select("skeleton", "word").join(forms, "skeleton").where(F.col("_f.form") != F.col("word"))
    best = variants.groupBy("word").agg(F.min("_f").alias("_f"))
    resolved = words.join(best, "word", "left").where((F.col("n") >= COUNT) | F.col("_f").isNotNull())
    resolved = resolved.select("word", "n", "small", F.col("_f.form").alias("form"), (-F.col("_f.n")).alias("form_n"), F.col("_f.small").alias("form_small"))
    return counts.where("kind = 0 and bucket >= 0").select("bucket", "word").join(resolved, "word")


class Dictionary(dict):
    """Of a bucket: word to (n, small, form, form_n, form_small)."""

    def add(self, batch: pa.RecordBatch) -> None:
        columns = [batch.column(c).to_pylist() for c in ("word", "n", "small", "form", "form_n", "form_small")]
        self.update(zip(columns[0], zip(*columns[1:])))

    def known(self, word: str) -> bool:
        return word in self and self[word][0] >= COUNT

    def correction(self, token: str, core: str, word: str) -> str | None:
        """The known form that the token may be a misreading of, if it is none itself. ``core``: the token without signs around
        it; ``word``: the same in lower case."""
        if word[:1].isdigit() and any(map(word.__contains__, ODD_SIGNS)) and AMOUNT.fullmatch(core):
            if core.replace(".", "").replace(",", "").isdigit():
                return None
            return core.translate(str.maketrans("OoIlSB", "001158"))
        if word not in self:
            return None
        count, _, form, n, small = self[word]
        odd = 0 if word.isalpha() else sum(map(word.count, ODD_SIGNS))
        known = count >= COUNT
        if known and CAPITAL_I.search(core):
            return word
        if form is None or known and n < DOMINANCE * count or len(word) < 4 or odd * 3 > len(word) or (odd and ADDRESS.search(token)):
            return None
        if core[:1].isupper() and not core.isupper() and small < 0.2 * n:
            return None  # perhaps a name
        if core.isupper() and odd == 0 and small < 0.5 * n:
            return None
        return form


def mask_of(word: str) -> str:
    """The skeleton of a word, or the word itself if it holds digits: those of a header are not what runs on."""
    word = re.sub(r"[\W_]+", "", word)
    return word if any(c.isdigit() for c in word) else skeleton(word)


def unaccented(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not "\u0300" <= c <= "\u036f")


BASE, FULL = 0xD1342543DE82EF95, (1 << 64) - 1


def rolled(text: str, start: int = 0) -> int:
    """A hash of which that of two texts one after the other is the first's times BASE to the length of the second, plus the second's."""
    for c in text:
        start = (start * BASE + ord(c)) & FULL
    return start


class Token:
    """What is known of a token wherever it stands in a bucket."""

    __slots__ = ("shown", "word", "correction", "alphabetic", "known")

    def __init__(self, token: str, words: Dictionary):
        if not token.strip(BARE):
            self.shown = self.word = token
            self.correction, self.alphabetic, self.known = None, False, False
            return
        self.shown = plain(token)
        core = EDGE_SIGNS.sub("", self.shown)
        self.word = word = lower_word(core)
        self.correction = fixed = words.correction(token, core, word)
        self.alphabetic = len(word) > 1 and (fixed is not None or word.isalpha())
        self.known = self.alphabetic and (fixed is not None or words.known(word))

    @property
    def skeleton(self) -> str:
        return mask_of(self.correction or self.word)

    @property
    def numeric(self) -> bool:
        bare = self.shown.strip(".,:;()[]|-–—/")
        return bare.isdigit() or bool(bare) and (bare.strip("IVXLCivxlc") == "" or any(map(str.isdigit, bare)))

    @property
    def certain(self) -> bool:
        """A sign among letters or a capital I within small ones is no spelling of its own."""
        fixed, word = self.correction, self.word
        return fixed is not None and (fixed == word or any(c in ODD_SIGNS for c in word) or len(word) > 5 and unaccented(word) != unaccented(fixed))


#: The tables that lines are of, by number.
RECORDS = ("page_lines", "readings")
PAGE_LINES, READINGS = range(2)

#: What a line sums up over its tokens, in this order; the latter ones only at the edges of pages.
ALPHABETIC, KNOWN, WRONG = range(3)
LENGTH, FORM_LENGTH, SOLID, NUMERIC = range(4)


class Tokens:
    """The tokens of a bucket looked at so far, and the numbers that lines sum up of them."""

    def __init__(self, words: Dictionary):
        self.words, self.row, self.entries = words, {}, []
        self.numbers, self.masks, self.hashes = np.zeros((1024, 3), np.int32), np.full((1024, 4), -1, np.int32), np.zeros((1024, 2), np.uint64)

    def __getitem__(self, token: str) -> Token:
        return self.entries[self.rows([token])[0]]

    def rows(self, tokens: list[str]) -> list[int]:
        out, numbers = [], []
        for token in tokens:
            k = self.row.get(token)
            if k is None:
                k = self.row[token] = len(self.entries)
                e = Token(token, self.words)
                self.entries.append(e)
                numbers.append((e.alphabetic, e.known, e.correction is not None))
            out.append(k)
        n = len(self.entries)
        while n > len(self.numbers):
            self.numbers, self.masks, self.hashes = (np.concatenate([x, more]) for x, more in ((self.numbers, np.zeros_like(self.numbers)), (self.masks, np.full_like(self.masks, -1)), (self.hashes, np.zeros_like(self.hashes))))
        if numbers:
            self.numbers[n - len(numbers) : n] = numbers
        return out

    def look(self, rows: np.ndarray) -> None:
        """Sees to it that the masks of these tokens are known."""
        for k in np.unique(rows[self.masks[rows, LENGTH] < 0]).tolist():
            mask = self.entries[k].skeleton
            form = DIGITS.sub("#", mask)
            self.masks[k] = len(mask), len(form), len(form) - form.count("#"), self.entries[k].numeric
            self.hashes[k, 0] = rolled(mask)
            self.hashes[k, 1] = self.hashes[k, 0] if form == mask else rolled(form)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, BASE, np.uint64)), dtype=np.uint64)


def match_case(token: str, word: str, correction: str) -> str:
    core = EDGE_SIGNS.sub("", plain(token))
    fixed = correction.upper() if core.isupper() and len(core) > 1 else correction[0].upper() + correction[1:] if core[:1].isupper() else correction
    at = plain(token).find(core)
    return plain(token)[:at] + fixed + plain(token)[at + len(core) :]


def head_of(text: str) -> str:
    """The first word of a line in lower case if it goes on with a sentence, else empty."""
    tokens = text.split(None, 1)
    head = HEAD.match(plain(tokens[0])) if tokens else None
    return head.group(1).lower() if head and (head.group(1)[0].islower() or text.isupper()) else ""


@dataclass
class Found:
    """What ``LineReader.features`` finds of some lines; of ``special`` lines by their number."""

    readable: np.ndarray
    page_no: np.ndarray
    numbered: np.ndarray
    masked: np.ndarray
    mask: np.ndarray
    form: np.ndarray
    fixes: dict[int, list[tuple[int, str, list[int]]]]
    tail: dict[int, str]


#: Of what goes on of a bucket: lines with some noise, those that only may be a header, those that are only text, and what
#: the first line of every page that goes on begins with.
NOISY, EDGES, TEXTS, OPENINGS = "noisy", "edge", "text", "opening"
LINES = (
    "part string, record byte, row_id long, unit long, page int, pos long, readable boolean, page_no boolean, numbered boolean, mask long, form long, "
    "fixes array<struct<at:int,word:string,pairs:array<long>>>, tail string, ahead array<struct<pos:long,head:string>>, next string, head string, text string"
)
_FIX = pa.struct([("at", pa.int32()), ("word", pa.string()), ("pairs", pa.list_(pa.int64()))])
_AHEAD = pa.struct([("pos", pa.int64()), ("head", pa.string())])
_SCHEMA = pa.schema(
    [("part", pa.string()), ("record", pa.int8()), ("row_id", pa.int64()), ("unit", pa.int64()), ("page", pa.int32()), ("pos", pa.int64()), *((c, pa.bool_()) for c in ("readable", "page_no", "numbered")), ("mask", pa.int64()), ("form", pa.int64()),
     ("fixes", pa.list_(_FIX)), ("tail", pa.string()), ("ahead", pa.list_(_AHEAD)), ("next", pa.string()), ("head", pa.string()), ("text", pa.string())]
)


class LineReader:
    """Reads the lines of buckets, page by page in order, however long a page is: of a page that goes on in the next batch the
    last EDGE lines wait for it, as do lines whose following line is not yet there."""

    def __init__(self, whole: bool):
        self.whole = whole  # all readable lines go on, with their texts
        self.restart()

    def restart(self) -> None:
        self.words = Dictionary()
        self.tokens = Tokens(self.words)
        self.close()

    def close(self) -> None:
        """Behind the last line of a bucket."""
        self.held: pa.Table | None = None
        self.page, self.pos, self.last = None, 0, None
        self.waiting: list[dict] = []
        self.opening: dict | None = None

    def __call__(self, parts: Iterator[tuple[int, bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        bucket = None
        for own, entries, batch in parts:
            if own != bucket:
                yield from self.lines(None)
                self.restart()
                bucket = own
            if entries:
                self.words.add(batch)
            else:
                yield from self.lines(pa.Table.from_batches([batch.select(["record", "row_id", "unit", "page", "line_no", "text"])]))
        yield from self.lines(None)

    def lines(self, more: pa.Table | None) -> Iterator[pa.RecordBatch]:
        """The next lines of a bucket, or its end."""
        rows = [t for t in (self.held, more) if t is not None]
        if rows:
            yield from self.chunk(pa.concat_tables(rows).combine_chunks(), more is None)
        if more is None:
            if self.waiting or self.opening:
                yield self.rows([*self.waiting, *[self.opening] * bool(self.opening)])
            self.close()

    def chunk(self, table: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
        unit, page, line_no = (table.column(c).to_numpy() for c in ("unit", "page", "line_no"))
        ids = table.column("row_id").combine_chunks()
        row_id = ids.fill_null(-(1 << 62)).to_numpy()
        held = self.held.num_rows if self.held is not None else 0
        fresh = np.append(True, (unit[1:] != unit[:-1]) | (page[1:] != page[:-1]))
        again = np.append(False, ~fresh[1:] & (row_id[1:] == row_id[:-1]) & (line_no[1:] == line_no[:-1]))
        if held == 0 and self.page == (unit[0], page[0]):
            again[0] = self.last == (row_id[0], line_no[0])
        if again.any():
            table = table.filter(pa.array(~again))
            unit, page, row_id, line_no, fresh = (x[~again] for x in (unit, page, row_id, line_no, np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))))
            fresh = np.append(True, fresh[1:] != fresh[:-1]) if len(fresh) else fresh
        n = table.num_rows
        if n == 0:
            return
        self.last = (row_id[-1], line_no[-1])
        goes_on = self.page == (unit[0], page[0])
        started = goes_on and self.pos > 0
        begin = np.flatnonzero(fresh)
        page_of = np.cumsum(fresh) - 1
        pos = np.arange(n) - begin[page_of]
        if goes_on:
            pos[page_of == 0] += self.pos
        if not started:
            yield from self.page_ends()
        end = np.append(begin[1:], n)[page_of]
        below = end - np.arange(n)  # 1 for the last line
        done = n
        if not final:
            done = max(int(begin[-1]), n - EDGE)
            below[page_of == page_of[-1]] = 1 << 40
        edge = np.minimum(pos + 1, below)
        self.held = table.slice(done) if done < n else None
        if done:
            yield from self.emit(table.slice(0, done).combine_chunks(), edge[:done], pos[:done], page_of[:done], begin, started, not final and done > begin[-1])
        if final:
            return
        self.page = (unit[-1], page[-1])
        self.pos = int(pos[done]) if done < n else int(pos[-1]) + 1

    def page_ends(self) -> Iterator[pa.RecordBatch]:
        rows = [*self.waiting, *[self.opening] * bool(self.opening)]
        self.waiting, self.opening = [], None
        if rows:
            yield self.rows(rows)

    @staticmethod
    def rows(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, _SCHEMA)

    def features(self, data: np.ndarray, offsets: np.ndarray, edge: np.ndarray) -> Found:
        n = len(offsets) - 1
        tokens, first, _ = tokens_of(data, offsets)
        coded = tokens.dictionary_encode()
        if len(self.tokens.entries) > 300_000:
            self.tokens = Tokens(self.words)  # bounds memory; a token is looked at alike each time
        raw = [t.decode("utf-8", "ignore") for t in coded.dictionary.to_pylist()]
        index = np.array(self.tokens.rows(raw), np.int64)[coded.indices.to_numpy()] if len(tokens) else np.zeros(0, np.int64)
        numbers = self.tokens.numbers[index]
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(numbers, 0, dtype=np.int64)])
        own = sums[first[1:]] - sums[first[:-1]]
        size = np.diff(first)
        readable = (own[:, KNOWN] * 2 >= own[:, ALPHABETIC]) & (own[:, ALPHABETIC] > 0)
        text_of = lambda i: data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        for i in np.flatnonzero(~readable & (own[:, ALPHABETIC] > 0) & (own[:, ALPHABETIC] <= 2)).tolist():
            readable[i] = FRAGMENT.fullmatch(plain(text_of(i))) is not None  # the rest of a divided word may stand alone
        found = Found(readable, *(np.zeros(n, bool) for _ in range(3)), *(np.zeros(n, np.int64) for _ in range(2)), {}, {})
        self.edges(found, edge, index, first, size, text_of)
        for i in np.flatnonzero(readable & (own[:, WRONG] > 0)).tolist():
            found.fixes[i] = self.fixes([self.tokens.entries[k] for k in index[first[i] : first[i + 1]].tolist()], text_of(i).split())
        if len(tokens):
            last = np.array([t[-1:] in HYPHENS for t in raw])
            ends = np.zeros(n, bool)
            ends[size > 0] = last[coded.indices.to_numpy()[first[1:][size > 0] - 1]]
            for i in np.flatnonzero(readable & ends).tolist():
                tail = TAIL.search(plain(text_of(i)))
                if tail:
                    found.tail[i] = tail.group(1).lower()
        return found

    def edges(self, found: Found, edge: np.ndarray, index: np.ndarray, first: np.ndarray, size: np.ndarray, text_of) -> None:
        """Page numbers and masks of the lines at the edges of pages: hashes of the skeletons of a line without its page number,
        and of the same with all digits masked."""
        lines = np.flatnonzero((edge <= EDGE) & (size > 0))
        if not len(lines):
            return
        count = size[lines]
        at = np.repeat(first[lines] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        ends = np.cumsum(count)
        self.tokens.look(index[at])
        numbers = self.tokens.masks[index[at]]
        own = np.add.reduceat(numbers, np.append(0, ends[:-1]), dtype=np.int64)
        for column, width, into in ((0, LENGTH, found.mask), (1, FORM_LENGTH, found.form)):
            length = numbers[:, width].astype(np.int64)
            through = np.cumsum(length)
            behind = np.repeat(through[ends - 1], count) - through
            parts = self.tokens.hashes[index[at], column] * powers(int(behind.max(initial=0)))[behind]
            into[lines] = np.add.reduceat(parts, np.append(0, ends[:-1])).view(np.int64)
        found.masked[lines] = own[:, SOLID] >= 4
        some = (numbers[ends - count, NUMERIC] > 0) | (numbers[ends - 1, NUMERIC] > 0) | (count < 5) & (own[:, NUMERIC] > 0)
        for i in lines[some].tolist():
            shown = plain(text_of(i))
            number = bool(PAGE_NO.fullmatch(shown)) and any(c.isalnum() for c in shown)
            found.page_no[i] = number
            masked = PAGE_START.sub("", PAGE_END.sub("", shown))
            if masked != shown:
                found.numbered[i] = edge[i] == 1 and bool(NUMBERED.search(shown)) and shown.count("|") < 2 and shown.lstrip()[:1].isupper()
                mask = "".join(mask_of(t.lower()) for t in masked.split())
                form = DIGITS.sub("#", mask)
                found.mask[i], found.form[i] = np.array([rolled(mask), rolled(form)], np.uint64).view(np.int64)
                found.masked[i] = len(form) - form.count("#") >= 4
            if number:
                found.masked[i] = False

    @staticmethod
    def fixes(entries: list[Token], tokens: list[str]) -> list[tuple[int, str, list[int]]]:
        """The misread tokens of a line: place, the token restored, and the pairs of words of which one must be known; none if
        the token is a misreading by itself."""
        out = []
        for k, entry in enumerate(entries):
            if entry.correction is None:
                continue
            pairs = []
            if not entry.certain:
                around = hash_words([e.word for e in entries[max(k - 1, 0) : k]] + [entry.correction] + [e.word for e in entries[k + 1 : k + 2]])
                pairs = pair_key(around[:-1], around[1:]).tolist()
                if not pairs:
                    continue
            out.append((k, match_case(tokens[k], entry.word, entry.correction), pairs))
        return out

    def emit(self, table: pa.Table, edge: np.ndarray, pos: np.ndarray, page_of: np.ndarray, begin: np.ndarray, goes_on: bool, unended: bool) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        data, offsets = flat_utf8(table.column("text").combine_chunks())
        found = self.features(data, offsets, edge)
        text_of = lambda i: data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        may = found.readable & ~found.page_no & ~found.numbered
        last_page = page_of[-1] if unended else -1

        def ahead(i: int, own: int) -> tuple[list, str | None, bool]:
            """Lines from i on that go on if they are no headers, the first word of the first that certainly goes on, and
            whether that is still to come."""
            some = []
            while i < n and page_of[i] == own:
                if may[i]:
                    if not found.masked[i]:
                        return some, head_of(text_of(i)), False
                    some.append({"pos": int(pos[i]), "head": head_of(text_of(i))})
                i += 1
            return some, None, own == last_page

        columns = {c: table.column(c).combine_chunks() for c in ("record", "row_id", "unit", "page")}
        late = []
        if goes_on:
            some, following, open_ = ahead(0, 0) if self.waiting or self.opening else ([], None, False)
            for row in [*self.waiting, *[self.opening] * bool(self.opening)]:
                row["ahead"], row["next"] = row["ahead"] + some, following
                if not open_:
                    late.append(row)
            if not open_:
                self.waiting, self.opening = [], None
        openings = []
        for p in range(int(goes_on), int(page_of[-1]) + 1):
            i = int(begin[p])
            some, following, open_ = ahead(i, p)
            row = {"part": OPENINGS, "unit": columns["unit"][i].as_py(), "page": columns["page"][i].as_py(), "ahead": some, "next": following}
            if open_:
                self.opening = row
            else:
                openings.append(row)
        follow: dict[int, tuple[list, str | None]] = {}
        wait = []
        for i in found.tail:
            if may[i]:
                some, following, open_ = ahead(i + 1, int(page_of[i]))
                follow[i] = some, following
                if open_:
                    wait.append(i)
        noisy = found.page_no | found.numbered
        noisy[[*found.tail, *found.fixes]] = True
        keep = noisy | found.masked
        if self.whole:
            keep |= may
        index = np.flatnonzero(keep)
        chosen = index.tolist()
        take = pa.array(index)
        part = pa.DictionaryArray.from_arrays(pa.array(np.where(noisy[index], 0, np.where(found.masked[index], 1, 2)), pa.int8()), pa.array([NOISY, EDGES, TEXTS])).cast(pa.string())
        masked = ~found.masked[index]
        fixes = [[{"at": a, "word": w, "pairs": p} for a, w, p in found.fixes[i]] if i in found.fixes else None for i in chosen]
        rows = pa.RecordBatch.from_arrays(
            [
                part, *(columns[c].take(take) for c in ("record", "row_id", "unit", "page")), pa.array(pos[index]), *(pa.array(x[index]) for x in (found.readable, found.page_no, found.numbered)),
                pa.array(found.mask[index], mask=masked), pa.array(found.form[index], mask=masked), pa.array(fixes, pa.list_(_FIX)), pa.array([found.tail.get(i) for i in chosen], pa.string()),
                pa.array([follow[i][0] if i in follow else None for i in chosen], pa.list_(_AHEAD)), pa.array([follow[i][1] if i in follow else None for i in chosen], pa.string()),
                pa.array([head_of(text_of(i)) for i in chosen] if self.whole else [None] * len(chosen), pa.string()), table.column("text").combine_chunks().take(take) if self.whole else pa.nulls(len(chosen), pa.string()),
            ], schema=_SCHEMA,
        )
        if wait:
            waits = np.isin(index, wait)
            self.waiting.extend(rows.filter(pa.array(waits)).to_pylist())
            rows = rows.filter(pa.array(~waits))
        yield rows
        if late or openings:
            yield self.rows([*late, *openings])


def page_lines(lines: DataFrame) -> DataFrame:
    """Lines (record, row_id, unit, page, line_no, text, deal) of the table of page lines; a unit is a document as read by one step.

    A line without a document or page is a page of its own; a null or blank text is no line. Lines of one ``deal`` are read in
    one task: those of a page."""
    lost = F.col("doc_id").isNull() | F.col("page_no").isNull()
    unit = F.when(lost, F.xxhash64(F.lit("line"), "line_id", "text")).otherwise(F.xxhash64(F.lit("page_lines"), "doc_id", "step"))
    kept = lines.where(F.trim("text") != "").withColumn("_unit", unit).withColumn("_page", F.coalesce(F.col("page_no").cast("int"), F.lit(0)))
    return kept.select(
        F.lit(PAGE_LINES).cast("byte").alias("record"), F.col("line_id").cast("long").alias("row_id"), F.col("_unit").alias("unit"), F.col("_page").alias("page"), F.coalesce(F.col("line_no").cast("int"), F.lit(0)).alias("line_no"),
        F.col("text").cast("string").alias("text"), F.xxhash64("_unit", "_page").alias("deal"),
    )


def reading_texts(readings: DataFrame) -> DataFrame:
    """Whole texts (row_id, unit, deal, text) of readings; a unit is a reading, and read in one task."""
    return readings.select(F.col("reading_id").cast("long").alias("row_id"), F.xxhash64(F.lit("readings"), "reading_id", "text").alias("unit"), F.col("text").cast("string").alias("text")).withColumn("deal", F.col("unit"))


def reading_lines(texts: DataFrame) -> DataFrame:
    """The lines of ``reading_texts``, as those of ``page_lines``; pages are parted by an empty line."""
    pages = texts.select("row_id", "unit", "deal", F.posexplode(F.split("text", "\n\n")).alias("page", "_page"))
    lines = pages.select("row_id", "unit", "deal", "page", F.posexplode(F.filter(F.split("_page", "\n"), lambda x: F.trim(x) != "")).alias("line_no", "text"))
    return lines.select(F.lit(READINGS).cast("byte").alias("record"), "row_id", "unit", "page", "line_no", "text", "deal")


def read_lines(lines: DataFrame, texts: DataFrame, others: DataFrame, rows: int, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """What goes on of all lines, as in LINES, and the counts of the corpus.

    ``lines``: of ``page_lines``; ``texts``: of ``reading_texts``; ``others``: texts that only count. ``rows``: about the number of
    lines, for the number of buckets only. ``whole``: readable lines go on with their texts."""
    buckets = B.number_of(rows, lines.sparkSession.sparkContext.defaultParallelism)
    bucket = F.pmod("deal", F.lit(buckets)).cast("int").alias("bucket")
    counted = lines.select(bucket, "text").unionByName(texts.select(bucket, "text")).unionByName(others.select(F.lit(None).cast("int").alias("bucket"), "text"))
    counts = write_through(corpus_counts(spread(counted)), "counts")
    dealt = lines.unionByName(reading_lines(texts)).select(bucket, "record", "row_id", "unit", "page", "line_no", "text")
    found = B.read(word_entries(counts), dealt, buckets, ["unit", "page"], ["line_no", "row_id", "text"], LineReader(whole), LINES)
    return write_through(found, "lines", "part"), counts


SPOT = ["unit", "page", "pos"]
PLACE = ["record", "row_id", *SPOT]


def headers(found: DataFrame, total: int) -> DataFrame:
    """The lines (PLACE, some twice) that are a header or footer: they run over pages of their unit, or are of a form that runs elsewhere,
    or stand outermost with the page's number."""
    edges = found.where(F.col("part").isin(NOISY, EDGES, TEXTS) & F.col("mask").isNotNull()).select(*PLACE, "mask", "form")
    running = edges.groupBy("unit", "mask", "form").agg(F.min("page").alias("_first"), F.max("page").alias("_last")).where("_first < _last").select("form").distinct()
    known = write_through(running, "forms")
    return skew.join(edges, known, ["form"], "left_semi", total).select(PLACE).unionByName(found.where((F.col("part") == NOISY) & F.col("numbered")).select(PLACE))


def supported(found: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """The misread tokens (PLACE, at, word; some twice): those that are so by themselves, and those whose restored word makes a known pair."""
    fixes = found.where((F.col("part") == NOISY) & F.col("readable") & F.col("fixes").isNotNull()).select(*PLACE, F.inline("fixes"))
    asked = fixes.where(F.size("pairs") > 0).select(*PLACE, "at", "word", F.explode("pairs").alias("hash"))
    backed = skew.join(asked, known_pairs(counts), ["hash"], "left_semi", total)
    return fixes.where(F.size("pairs") == 0).select(*PLACE, "at", "word").unionByName(backed.select(*PLACE, "at", "word"))


def divided(found: DataFrame, counts: DataFrame, heads: DataFrame, total: int) -> DataFrame:
    """The lines (PLACE) whose last word is divided for the end of the line.

    Not so if what follows, on the page or at the top of the next, opens a sentence, or the word is known with its hyphen and
    not without, or, where neither is known, its first part is known to begin words with a hyphen."""
    each = found.where(F.col("part").isin(NOISY, OPENINGS) & (F.size("ahead") > 0)).select("part", F.col("pos").alias("_of"), "unit", "page", F.posexplode("ahead").alias("_k", "_a")).select("part", "_of", "unit", "page", "_k", "_a.pos", "_a.head")
    first = each.join(heads.select(SPOT), SPOT, "left_anti").groupBy("part", "unit", "page", F.col("_of").alias("pos")).agg(F.min_by("head", "_k").alias("_first"))
    ends = found.where((F.col("part") == NOISY) & F.col("readable") & F.col("tail").isNotNull() & ~F.col("page_no") & ~F.col("numbered")).select(*PLACE, "tail", "next").join(heads.select(SPOT), SPOT, "left_anti")
    ends = ends.join(first.where(F.col("part") == NOISY).select(*SPOT, "_first"), SPOT, "left")
    over = found.where(F.col("part") == OPENINGS).select("unit", "page", "next").distinct().join(first.where(F.col("part") == OPENINGS).select("unit", "page", "_first"), ["unit", "page"], "left")
    over = over.select("unit", (F.col("page") - 1).alias("page"), F.coalesce("_first", "next").alias("_over")).where("_over is not null")
    ends = ends.join(over, ["unit", "page"], "left").withColumn("next", F.coalesce("_first", "next", "_over")).where(F.coalesce("next", F.lit("?")) != "")
    ends = write_through(ends.select(*PLACE, "tail", F.coalesce(F.concat("tail", "next"), "tail").alias("whole"), F.coalesce(F.concat_ws("-", "tail", "next"), "tail").alias("compound")), "ends")
    known = totals(counts).where(F.col("n") >= COUNT).select("word")
    compounds = known.where(F.col("word").rlike("^\\p{L}+(?:-\\p{L}+)+$"))
    facts = known.where(F.col("word").rlike("^\\p{L}+$")).select(F.lit("whole").alias("fact"), "word")
    facts = facts.unionByName(compounds.select(F.lit("compound").alias("fact"), "word")).unionByName(compounds.select(F.lit("tail").alias("fact"), F.split("word", "-")[0].alias("word")).distinct())
    asked = ends.select(*SPOT, F.explode(F.array(*(F.struct(F.lit(c).alias("fact"), F.col(c).alias("word")) for c in ("whole", "compound", "tail")))).alias("_f")).select(*SPOT, "_f.*")
    so = lambda c: F.bool_or(F.col("fact") == c).alias(f"is_{c}")
    known = skew.join(asked, facts, ["fact", "word"], "left_semi", total).groupBy(SPOT).agg(*map(so, ("whole", "compound", "tail")))
    judged = ends.join(known, SPOT, "left")
    return judged.where(F.when(F.col("is_whole"), True).when(F.col("is_compound"), False).otherwise(~F.coalesce("is_tail", F.lit(False)))).select(PLACE)


def noises(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (PLACE, noise) for every noise of every line, some given twice."""
    total = found.count()
    heads = write_through(headers(found, total), "headers")
    parts = {"misread": supported(found, counts, total).select(PLACE), "header": heads, "page_no": found.where((F.col("part") == NOISY) & F.col("page_no")).select(PLACE), "hyphen": divided(found, counts, heads, total)}
    out = None
    for noise, rows in parts.items():
        rows = rows.withColumn("noise", F.lit(noise))
        out = rows if out is None else out.unionByName(rows)
    return out


def paragraphs(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Continuous paragraphs (record, row_id, unit, page, paragraph, continues, text) of lines that carry ``text``.

    Headers, footers, page numbers and unreadable lines are left out, misread words restored, divided words joined.
    ``continues``: the paragraph goes on from the page before; ``row_id`` is of its first line.
    """
    total = found.count()
    heads = write_through(headers(found, total), "headers")
    hyphen = divided(found, counts, heads, total).distinct().withColumn("_hyphen", F.lit(True))
    fixed = supported(found, counts, total).distinct().groupBy(SPOT).agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("_fixed"))
    body = found.where((F.col("part") != OPENINGS) & F.col("readable") & ~F.col("page_no") & ~F.col("numbered")).select(*PLACE, "head", "tail", "text")
    body = body.join(heads.select(SPOT), SPOT, "left_anti").join(fixed, SPOT, "left").join(hyphen.select(*SPOT, "_hyphen"), SPOT, "left")
    restored = F.array_join(F.transform(F.split(F.trim(F.regexp_replace("text", f"{C.SPACE}+", " ")), " "), lambda t, k: F.coalesce(F.try_element_at("_fixed", k), t)), " ")
    body = body.withColumn("_shown", F.when(F.col("_fixed").isNotNull(), restored).otherwise(F.trim("text")))
    page = ["unit", "page"]
    order = Window.partitionBy(*page).orderBy("pos")
    before = F.lag("_shown").over(order)
    short = F.length(before) < 0.75 * F.max(F.length("_shown")).over(Window.partitionBy(*page))
    ends = before.rlike("[.!?:;…][\"”')]*$")
    item, row = F.col("_shown").rlike("^([-*•–]|\\(?\\w{1,4}[.)])\\s"), F.col("_shown").rlike("\\t| {3,}|;.*;|\\|.*\\|")
    opens = (ends & (short | (F.col("head") == ""))) | item | row
    body = body.withColumn("_start", F.when(before.isNull(), 0).otherwise(opens.cast("int"))).withColumn("paragraph", F.sum("_start").over(order))
    joined = F.when(F.col("_hyphen"), F.regexp_replace("_shown", f"[{HYPHENS}]\\s*$", "")).when(F.col("tail").isNotNull(), F.col("_shown")).otherwise(F.concat("_shown", F.lit(" ")))
    lines = F.array_sort(F.collect_list(F.struct("pos", joined.alias("t"), "head")))
    grouped = body.groupBy(*page, "paragraph").agg(lines.alias("_lines"), F.min_by(F.struct("record", "row_id"), "pos").alias("key"))
    continues = (F.col("paragraph") == 0) & (F.col("page") > 0) & (F.col("_lines")[0]["head"] != "")
    return grouped.select("key.record", "key.row_id", *page, "paragraph", continues.alias("continues"), F.trim(F.array_join(F.transform("_lines", lambda x: x["t"]), "")).alias("text"))
