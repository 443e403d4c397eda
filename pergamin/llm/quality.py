"""Problem 1: statistics of text quality and the form a text has: prose, list, table or junk.

Lines are joined to items (a line goes on if the next word would not have fitted). Every item is described by a few
distributions: classes of characters, shapes of tokens, how it opens, ends, is divided and how long it is. Labelled samples give
structural profiles, means of clusters of such distributions, and an item takes the form of the profile of the least
Jensen-Shannon divergence. Whole texts also get their divergence from each language's prose profile of function words, and the
share of characters that each form holds. The samples and word lists do not grow; all texts are measured whole, in one pass.
"""

from __future__ import annotations

import re
import textwrap
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergamin.llm.scanned import PAGE_NO, plain

FORMS = ("prose", "list", "table", "junk")
#: Profiles of each form, labelled samples read at most, and tokens a task keeps.
CLUSTERS, SAMPLE_ROWS, MEMORY = 8, 2_000, 300_000

# Marks that open an item of an enumeration.
MARK = re.compile(
    r"\s*(?:[-*•–—·▪◦‣]\s+(?=\w)"
    r"|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlcIVXLC]{1,6})\)-?\s*(?=[^\W\d])|(?:\d{1,3}|[a-z]|[ivxlc]{2,6}|[IVXLC]{2,6})\.-?\s+(?=[^\W\d])"
    r"|\d{1,2}(?:\.\d{1,2}){1,3}\.?\s+(?=[^\W\d])|\d{1,3}\s*[-–º]\s+(?=[^\W\d]))"
)
SENTENCES = re.compile(r"[a-zà-ÿ]{3}\. \w")
NO_WORD = re.compile(r"[\W_]+")
PUNCTUATED = re.compile(r"[^\W_]{2}[.,](?:\s|$)")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
SHAPES = ("function", "word", "unreadable", "number", "date", "amount", "code", "sign", "letter", "mixed", "capital", "foreign")
DATE = re.compile(r"\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}")
AMOUNT = re.compile(r"-?(?:R\$|\$|€)?\d{1,3}(?:\.\d{3})*,\d{2}|R\$|\$")
CLASSES = {"lower": 0, "upper": 1, "digit": 2, "blank": 3, "stop": 4, "link": 5, "money": 6, "column": 7, "sign": 8, "glyph": 9}
OPEN = ("mark", "lower", "upper", "digit", "sign")
END = ("stop", "comma", "semicolon", "hyphen", "letter", "digit", "sign")
DIVIDED = ("none", "tab", "bar", "semicolon", "blanks", "dots")
LENGTH = (1, 2, 3, 5, 8, 11, 15, 20, 30)
INNER = ("none", "comma", "stop", "both")
PARTS = (len(CLASSES), len(SHAPES), len(OPEN), len(END), len(DIVIDED), len(LENGTH) + 1, len(INNER))
WEIGHTS = (1.5, 3.0, 1.0, 0.7, 1.5, 0.7, 0.7)


def class_of(c: str) -> int:
    if c.isalpha():
        return CLASSES["upper" if c.isupper() else "lower"]
    if c.isdigit():
        return CLASSES["digit"]
    if c in " \xa0":
        return CLASSES["blank"]
    if c in ".,;:!?":
        return CLASSES["stop"]
    if c in "-/()\"'“”‘’–—[]ºª°§…":
        return CLASSES["link"]
    if c in "$€%":
        return CLASSES["money"]
    if c in "\t|":
        return CLASSES["column"]
    return CLASSES["sign" if c <= "\x7f" else "glyph"]


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, to base 2, between the rows of p (n x d) and of q (m x d): n x m."""
    m = (p[:, None, :] + q[None, :, :]) / 2

    def entropy(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(np.maximum(x, 1e-12))).sum(-1)

    return np.maximum(entropy(m) - (entropy(p)[:, None] + entropy(q)[None, :]) / 2, 0)


@dataclass
class Profiles:
    """What is learned from the labelled samples and the word lists; of a fixed size."""

    common: dict[str, tuple[str, ...]]  # word: languages
    readable: dict[str, float] = field(default_factory=dict)  # letter pair: log ratio of readable to unreadable text
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, sum(PARTS))))
    forms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    words: list[str] = field(default_factory=list)
    languages: dict[str, np.ndarray] = field(default_factory=dict)  # distribution over words in the prose of a language

    def distance(self, x: np.ndarray, parts: tuple[int, ...] = PARTS, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
        total, at = np.zeros((len(x), len(self.centres))), 0
        for width, weight in zip(parts, weights):
            total += weight * divergence(x[:, at : at + width], self.centres[:, at : at + width])
            at += width
        return total

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Index into FORMS for every row."""
        out = np.zeros(len(x), np.int64)
        for k in range(0, len(x), 4096):
            out[k : k + 4096] = self.forms[self.distance(x[k : k + 4096]).argmin(1)]
        return out


class Describer:
    """Turns items into rows of distributions; tokens are looked at once per task."""

    def __init__(self, profiles: Profiles):
        self.profiles = profiles
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(CLASSES) + len(SHAPES)), np.float32)

    def token(self, token: str) -> int:
        k = self.row.get(token)
        if k is None:
            k = self.row[token] = len(self.row)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            counts = [0] * self.table.shape[1]
            shown = plain(token)
            for c in shown:
                counts[class_of(c)] += 1
            counts[len(CLASSES) + SHAPES.index(self.shape(shown))] += 1
            self.table[k] = counts
        return k

    def shape(self, token: str) -> str:
        core = token.strip(".,;:!?()[]\"'“”‘’-–—…")
        if not core:
            return "sign"
        if core.lower() in self.profiles.common:
            return "function"
        if len(core) == 1:
            return "number" if core.isdigit() else "letter" if core.isalpha() else "sign"
        if DATE.fullmatch(core):
            return "date"
        if AMOUNT.fullmatch(core):
            return "amount"
        letters, digits = sum(c.isalpha() for c in core), sum(c.isdigit() for c in core)
        if not letters and not digits:
            return "sign"
        if letters == 0:
            return "number" if digits * 2 > len(core) else "sign"
        if digits:
            run = len(re.findall(r"g\d{1,4}", core)) >= 3
            return "unreadable" if run else "code"
        if any(c > "ɏ" and c.isalpha() for c in core) and sum(c > "ɏ" and c.isalpha() for c in core) * 2 > letters:
            return "foreign"
        if letters < 0.6 * len(core):
            return "unreadable"
        if self.score(core.lower()) < 0:
            return "unreadable"
        return "capital" if core.isupper() else "word"

    def score(self, word: str) -> float:
        """Log ratio of a readable to an unreadable word by its letter pairs."""
        ratio, padded = self.profiles.readable, f" {word} "
        return sum(ratio.get(padded[k : k + 2], -0.5 if padded[k : k + 2].isalpha() else 0.0) for k in range(len(padded) - 1))

    def rows(self, items: list[str]) -> np.ndarray:
        """Rows of all PARTS, each a distribution."""
        if not items:
            return np.zeros((0, sum(PARTS)))
        if len(self.row) > MEMORY:
            self.__init__(self.profiles)  # bounds memory; a token is described alike each time
        ids, starts, edges = [], [], []
        known = self.row
        for item in items:
            starts.append(len(ids))
            mark = MARK.match(item)
            body = item[mark.end() :].split() if mark else item.split() or ["."]
            for token in body or ["."]:
                k = known.get(token)
                ids.append(self.token(token) if k is None else k)
            edges.append(self.edges(item, mark is not None, len(body)))
        rest, at = np.zeros((len(items), sum(PARTS[2:]))), 0
        for width, k in zip(PARTS[2:], np.array(edges).T):
            rest[:, at : at + width] = 0.1 / width
            rest[np.arange(len(items)), at + k] += 0.9
            at += width
        counts = np.add.reduceat(self.table[ids].astype(float), starts)
        counts[:, CLASSES["blank"]] += [item.count(" ") for item in items]
        counts[:, CLASSES["column"]] += [item.count("\t") + item.count("|") + item.count(";") * (item.count(";") > 1) for item in items]
        a = len(CLASSES)
        counts[:, :a] = smooth(counts[:, :a])
        counts[:, a:] = smooth(counts[:, a:])
        return np.concatenate([counts, rest], 1)

    @staticmethod
    def edges(item: str, mark: bool, words: int) -> tuple[int, int, int, int, int]:
        """Of an item: how it opens, ends, is divided, how long it is, and what it has within."""
        shown = item.strip()
        first, last = shown[:1] or ".", shown[-1:] or "."
        opening = 0 if mark else 1 if first.islower() else 2 if first.isupper() else 3 if first.isdigit() else 4
        ending = 0 if last in ".!?" else 1 if last == "," else 2 if last in ";:" else 3 if last in "-‐‑¬\xad" else 4 if last.isalpha() else 5 if last.isdigit() else 6
        divided = 1 if "\t" in shown else 2 if shown.count("|") > 1 and any(c.isalnum() for c in shown) else 3 if shown.count(";") > 1 else 5 if "....." in shown else 4 if "   " in shown else 0
        inner = (1 if ", " in shown[:-1] else 0) + (2 if ". " in shown and SENTENCES.search(shown) else 0)
        return opening, ending, divided, bisect_left(LENGTH, words), inner


def smooth(x: np.ndarray, prior: float = 0.3) -> np.ndarray:
    x = x + prior / x.shape[1]
    return x / x.sum(1, keepdims=True)


def items_of(text: str) -> list[str]:
    """The lines of a text, those joined that were only broken because the next word did not fit or that run on."""
    lines = [line.rstrip() for line in text.split("\n")]
    shown = [line for line in lines if line]
    if not shown:
        return []
    # The last line of a paragraph may be longer than the others, as may be a line of noise; rows of columns have no such width.
    running = sorted(len(line) for line in shown if line[-1] not in ".;:!?" and not columns(line))
    width = running[int(0.85 * (len(running) - 1))] if running else max(map(len, shown))
    # Where a third of the lines have signs of sentences, small letters at the start of a line go on with the line before.
    loose = [line for line in shown if not columns(line) and not MARK.match(line)]
    flows = sum(PUNCTUATED.search(line) is not None for line in loose) * 3 >= len(loose)
    items = []
    for k, line in enumerate(shown):
        first = line.split(None, 1)[0] if line.split() else ""
        full = len(shown[k - 1]) + 1 + len(first) > width or flows and first[:1].islower() and shown[k - 1][-1] not in ".;:!?"
        goes_on = k > 0 and full and not MARK.match(line) and not columns(shown[k - 1]) and not columns(line)
        if goes_on:
            before = items[-1]
            items[-1] = before[:-1] + line.lstrip() if before[-1] in "-‐‑¬\xad" and first[:1].islower() else f"{before} {line.lstrip()}"
        else:
            items.append(line)
    return items


def columns(line: str) -> bool:
    return "\t" in line or "   " in line or line.count("|") > 1 or line.count(";") > 1 or "....." in line


def train(samples: DataFrame, common: DataFrame, lines: bool = False) -> Profiles:
    """Profiles from at most SAMPLE_ROWS labelled samples and the lists of common words, neither of which grows."""
    words: dict[str, tuple[str, ...]] = {}
    for row in sorted((r.word, r.lang) for r in common.select("word", "lang").where("word is not null and lang is not null").distinct().collect()):
        words[row[0]] = (*words.get(row[0], ()), row[1])
    labelled = samples.select("text", "form").where(F.col("text").isNotNull() & F.col("form").isin(*FORMS)).distinct()
    rows = [(r.text, r.form) for r in labelled.orderBy(F.xxhash64("text"), "text", "form").limit(SAMPLE_ROWS).collect()]
    return learn(rows, words, lines)


def learn(rows: list[tuple[str, str]], words: dict[str, tuple[str, ...]], lines: bool = False) -> Profiles:
    """``lines``: of prose also what a line of it looks like, for texts that are single lines."""
    profiles = Profiles(words)
    pairs: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for text, form in rows:
        for word in WORD.findall(plain(text).lower()):
            if len(word) > 1:
                pairs[form != "junk"].update(f" {word} "[k : k + 2] for k in range(len(word) + 1))
    total = {k: sum(c.values()) + 500 for k, c in pairs.items()}
    for pair in pairs[True].keys() | pairs[False].keys():
        profiles.readable[pair] = float(np.log((pairs[True][pair] + 0.5) / total[True]) - np.log((pairs[False][pair] + 0.5) / total[False]))
    describer = Describer(profiles)
    centres, forms = [], []
    for k, form in enumerate(FORMS):
        items = [i for text, f in rows if f == form for i in items_of(text)]
        if lines and form == "prose":
            items += [line for i in items for width in (28, 48, 70) for line in textwrap.wrap(i, width)]
        x = np.unique(describer.rows(items), axis=0)
        for centre in cluster(x, profiles):
            centres.append(centre)
            forms.append(k)
    profiles.centres, profiles.forms = np.array(centres).reshape(-1, sum(PARTS)), np.array(forms, np.int64)
    profiles.words = sorted(words)
    index = {w: k for k, w in enumerate(profiles.words)}
    for language in sorted({x for v in words.values() for x in v}):
        counts = np.full(len(index), 0.01)
        for text, form in rows:
            found = [w for w in re.findall(r"\w+", text.lower()) if w in index]
            own = sum(language in words[w] for w in found)
            if form == "prose" and found and own > 0.8 * len(found):
                np.add.at(counts, [index[w] for w in found], 1)
        profiles.languages[language] = counts / counts.sum()
    return profiles


def cluster(x: np.ndarray, profiles: Profiles) -> np.ndarray:
    """Means of CLUSTERS clusters by divergence; deterministic: each start is the row farthest from the others."""
    if not len(x):
        return x
    probe = Profiles(profiles.common)
    probe.centres = x.mean(0, keepdims=True)
    chosen = [x[probe.distance(x)[:, 0].argmin()]]
    while len(chosen) < min(CLUSTERS, len(x)):
        probe.centres = np.array(chosen)
        chosen.append(x[probe.distance(x).min(1).argmax()])
    probe.centres = np.array(chosen)
    for _ in range(10):
        nearest = probe.distance(x).argmin(1)
        probe.centres = np.array([x[nearest == k].mean(0) if (nearest == k).any() else c for k, c in enumerate(probe.centres)])
    return probe.centres


def item_forms(items: list[str], describer: Describer) -> tuple[np.ndarray, np.ndarray]:
    """Form of every item (index into FORMS) and the rows it was decided by."""
    rows = describer.rows(items)
    return describer.profiles.nearest(rows), rows


def statistics(text: str, profiles: Profiles, index: dict[str, int]) -> list:
    words = WORD.findall(text)
    solid = "".join(text.split())
    lines = [line.rstrip() for line in text.split("\n") if line.strip()]
    lowered = [w.lower() for w in words]
    common = [w for w in lowered if w in index]
    language, least = None, 1.0
    if common:
        counts = np.bincount([index[w] for w in common], minlength=len(index)) / len(common)
        names = list(profiles.languages)
        found = divergence(counts[None, :], np.array([profiles.languages[n] for n in names]))[0]
        language, least = names[int(found.argmin())], float(found.min())
    return [
        len(words),
        sum(map(len, words)) / len(words) if words else 0.0,
        1 - len(NO_WORD.sub("", solid)) / len(solid) if solid else 0.0,
        sum(line[-1] in ".!?;:," for line in lines) / len(lines) if lines else 0.0,
        len(common) / len(words) if words else 0.0,
        language,
        least,
    ]


STATISTICS = "words int, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, language string, prose_divergence double"


def text_quality(df: DataFrame, profiles: Profiles, key: str = "row_id", text: str = "text") -> DataFrame:
    """One row for every row of ``df``: key, STATISTICS, ``form``, and the share of characters of each form.

    ``form`` is the one that holds more than half of the characters, else prose. A null, empty or blank text has counts and
    shares 0, ``prose_divergence`` 1 and no form. Whole texts are measured. Null keys and repeated rows are kept; other
    columns are not carried.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    extra = T._parse_datatype_string(f"{STATISTICS}, form string, {', '.join(f'{f}_share double' for f in FORMS)}").fields
    schema = T.StructType([T.StructField(key, rows.schema["_key"].dataType), *extra])
    kinds = [pa.int32(), *[pa.float64()] * 4, pa.string(), pa.float64(), pa.string(), *[pa.float64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(shared.value)
        index = {w: k for k, w in enumerate(shared.value.words)}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [statistics(t, shared.value, index) for t in texts]
                items = [items_of(t) for t in texts]
                forms, _ = item_forms([i for own in items for i in own], describer)
                at = 0
                for row, own in zip(found, items):
                    size = np.array([len(i) - i.count(" ") for i in own], float)
                    held = np.bincount(forms[at : at + len(own)], size, len(FORMS)) if own else np.zeros(len(FORMS))
                    at += len(own)
                    share = held / held.sum() if held.sum() else held
                    row.append(None if not held.sum() else FORMS[int(share.argmax())] if share.max() > 0.5 else "prose")
                    row.extend(share.tolist())
                columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def line_form(line: str, form: int, row: np.ndarray) -> str:
    """The form of a single line: a list item must open with a mark, a table row hold columns or values, and junk nothing that
    can be read; a page's number is prose."""
    shapes = dict(zip(SHAPES, row[len(CLASSES) :]))
    values = shapes["date"] + shapes["amount"] + shapes["number"]
    name = FORMS[form]
    if name == "list" and not MARK.match(line):
        return "prose"
    if name == "table" and not columns(line) and (values < 0.3 or shapes["function"] > 0.1 or len(line.split()) < 3):
        return "prose"
    if name == "junk" and (shapes["unreadable"] + shapes["sign"] + shapes["letter"] < 0.5 or PAGE_NO.fullmatch(plain(line))):
        return "prose"
    return name


def line_forms(lines: DataFrame, profiles: Profiles, key: str = "line_id", place: tuple[str, ...] = ("doc_id", "step", "page_no"), order: str = "i", text: str = "text") -> DataFrame:
    """One row (key, form) for every line: a line that opens with an item mark is a list if its item is, a line of columns or
    column heads a table, one without readable content junk, any other prose. A blank or null line has no form.

    The item of a line is what it opens, joined over the two next lines of its page as far as the page's width shows that
    they belong to it. Rows given again under the same key follow one another and do no harm; null keys are kept.
    """
    page = Window.partitionBy(*place)
    ordered = page.orderBy(order, key)
    rows = lines.select(*place, F.col(key).alias("_key"), F.col(order), F.col(text).cast("string").alias("_text")).dropDuplicates(["_key", "_text", *place])
    ordered = page.orderBy(order, "_key")
    rows = rows.withColumn("_width", F.max(F.length("_text")).over(page)).withColumn("_next", F.lead("_text", 1).over(ordered)).withColumn("_third", F.lead("_text", 2).over(ordered))
    rows = rows.select("_key", "_text", "_next", "_third", "_width")
    shared = lines.sparkSession.sparkContext.broadcast(profiles)
    schema = T.StructType([T.StructField(key, rows.schema["_key"].dataType), T.StructField("form", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(shared.value)
        for batch in batches:
            texts, following, third, width = (batch.column(k).to_pylist() for k in range(1, 5))
            items = []
            for own, two, three, w in zip(texts, following, third, width):
                item = own or ""
                if MARK.match(item) and w:
                    for before, more in ((own, two), (two, three)):
                        first = (more or "").split(None, 1)[:1]
                        if not first or MARK.match(more) or len(before.rstrip()) + 1 + len(first[0]) <= w:
                            break
                        item = f"{item.rstrip()} {more.strip()}"
                items.append(item)
            forms, rows = item_forms(items, describer)
            out = [line_form(own, form, row) if own and own.strip() else None for own, form, row in zip(texts, forms.tolist(), rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
