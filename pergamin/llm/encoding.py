"""Problem 5: text that was decoded with a wrong character encoding.

A hidden Markov model labels the characters of every word that holds something other than plain letters: one clean state, one
state for each pair (true encoding, encoding it was read with), and one for characters that were lost to a substitute. A pair's
state emits the characters that stand for one true character under that pair, with the probability of the true character in its
place; probabilities come from letter trigrams counted over the whole corpus. The best path's spans are restored by the inverse
transform of their state. A second labelling of a garbled text favours the pairs found in it.

Words are labelled once per task: the number of different odd words is small against the text, and the statistics have a fixed
size given by the alphabet, whatever the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergamin.llm.arrow_text import code_points, flat_utf8, slices

# The letters of Portuguese, Spanish and English.
ALPHABET = "abcdefghijklmnopqrstuvwxyzáàâãäéêíóôõöúüçñ"
# Signs common in such texts that a wrong encoding changes.
SIGNS = "ºª§°–—“”‘’•…€"
QUOTES = "«»‹›¿¡"
# Fixed values: (true encoding, encoding it was read with).
PAIRS = (
    *(("utf-8", wrong) for wrong in ("cp1252", "cp1251", "mac_roman", "cp850", "cp437", "iso8859_15")),
    *(("utf-8 twice", wrong) for wrong in ("cp1252", "cp1251", "mac_roman", "cp850")),
    *(("cp1252", wrong) for wrong in ("cp850", "cp437", "mac_roman")),
    *(("cp850", wrong) for wrong in ("cp1252", "mac_roman")),
    *(("cp437", wrong) for wrong in ("cp1252", "mac_roman")),
    *(("mac_roman", wrong) for wrong in ("cp1252", "cp850", "cp437")),
    ("utf-7", "ascii"),
)
LOST = ("any", "substitute")
STATES = ("clean", *(f"{a} as {b}" for a, b in PAIRS), f"{LOST[0]} as {LOST[1]}")

# Log probabilities of the model that are not counted: moving to a garbled state, where the text is known to hold it or not,
# staying in it, leaving it; a foreign character within a word and elsewhere; a blank that does not break; a restored sign, the
# same within a word; a foreign letter, a letter of the wrong case.
ENTER, ENTER_KNOWN, STAY, LEAVE = -7.5, -2.5, -1.5, -0.3
ODD_WITHIN, ODD_ELSEWHERE, BLANK, SIGN, SIGN_WITHIN, FOREIGN, WRONG_CASE = -18.0, -7.5, -4.0, -4.5, -14.0, -7.0, -15.0
# A question mark that is one: before a word, inside or behind one, behind another.
MARK_BEFORE, MARK_WITHIN, MARK_BEHIND, MARK_AGAIN = -18.0, -12.0, -6.0, -1.0
#: Characters from which on a word is labelled in pieces, each of which ends between plain letters that no sequence joins.
PIECE = 200
SAFE = re.compile(r"(?<=[A-Za-z])(?=[A-Za-z])")

INDEX = {c: k + 1 for k, c in enumerate(ALPHABET)} | {c.upper(): k + 1 for k, c in enumerate(ALPHABET)}
N = len(ALPHABET) + 1
LETTERS = ALPHABET + ALPHABET.upper()
# A word with a character that is neither ASCII nor a letter of the alphabet, with a capital behind a small accented or plain
# letter, with a substitute beside a letter, or with an escape of UTF-7.
ODD = re.compile(
    rf"[^\x00-\x7f{LETTERS}]|[a-z{ALPHABET[26:]}][{ALPHABET[26:].upper()}]|[{LETTERS}]\?|\?[{LETTERS}]|\+[A-Za-z0-9/]{{3,}}-",
)
# Words in which a question mark is none of the text's letters: addresses of pages, assignments.
QUERY = re.compile(r"://|www\.|\?[^?]*=|\.(?:php|html?|aspx?|jsp)\?")
# Symbols of the letters that a reader without them loses.
LOSABLE = range(27, N)
TOKEN = re.compile(r"[^ \t\r\n]+")
UTF7 = re.compile(r"\+[A-Za-z0-9/]{3,}-")


def read_as(raw: bytes, wrong: str) -> str | None:
    """``raw`` as a lenient reader shows it: bytes that the encoding leaves open become control characters."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=1)
def inverse() -> dict[str, list[tuple[int, str, str]]]:
    """By first character: (state, what is read, the true character)."""
    common = [*ALPHABET[26:], *ALPHABET[26:].upper(), *SIGNS]
    foreign = [*(chr(k) for k in (*range(0x391, 0x3D0), *range(0x3AC, 0x3D0), *range(0x410, 0x450)))]
    foreign = [c for c in dict.fromkeys(foreign) if unicodedata.category(c) != "Cn"]
    table: dict[str, list[tuple[int, str, str]]] = {}
    for state, (a, b) in enumerate(PAIRS, 1):
        if a == "utf-7":
            continue
        for c in common + foreign * a.startswith("utf-8"):
            try:
                seen = {read_as(c.encode("utf-8" if a == "utf-8 twice" else a), b)}
                if b == "cp1252":
                    seen.add(c.encode("utf-8" if a == "utf-8 twice" else a).decode("latin-1"))
                if a == "utf-8 twice":
                    seen = {read_as(s.encode(), b) for s in seen} | ({s.encode().decode("latin-1") for s in seen} if b == "cp1252" else set())
            except UnicodeEncodeError:
                continue
            for s in seen - {c}:
                for form in {s, unicodedata.normalize("NFC", s)}:
                    if form[0] > "\x7f":
                        table.setdefault(form[0], []).append((state, form, c))
    return table


def trigram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of letter trigrams, case aside; everything that is no letter of the alphabet is one symbol, 0."""
    points, _ = code_points(data)
    table = np.zeros(0x180, np.int64)
    for c, k in INDEX.items():
        table[ord(c)] = k
    symbol = np.where(points < 0x180, table[np.minimum(points, 0x17F)], 0)
    symbol = np.concatenate([[0, 0], symbol, [0]])
    return np.bincount(symbol[:-2] * N * N + symbol[1:-1] * N + symbol[2:], minlength=N**3)


def letter_statistics(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of a symbol after two others, from all rows of ``texts``; N x N x N whatever the size of the corpus."""
    schema = "trigram int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(N**3, np.int64)
        for batch in batches:
            data, offsets = flat_utf8(batch.column(0))
            for a, b in slices(offsets):
                counts += trigram_counts(data[offsets[a] : offsets[b]])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["trigram", "n"])

    summed = texts.select(F.col(text).cast("string")).mapInArrow(run, schema).groupBy("trigram").agg(F.sum("n").alias("n"))
    return log_probabilities(summed.collect())


def log_probabilities(rows: list) -> np.ndarray:
    counts = np.zeros(N**3)
    for trigram, n in rows:
        counts[trigram] = n
    three = counts.reshape(N, N, N)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + N)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


class Labeller:
    """The hidden Markov model over words, with the words it has labelled."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.seen: dict[tuple[str, frozenset], tuple[tuple[tuple[int, str, str], ...], ...]] = {}

    def true_character(self, c: str, a: int, b: int, before: str, after: str) -> tuple[float, int]:
        """Log probability of the true character ``c`` behind the symbols a, b; and its symbol."""
        k = INDEX.get(c)
        if k is None:
            if c in SIGNS:
                return (SIGN_WITHIN if before.isalpha() and after.isalpha() else SIGN), 0
            return (FOREIGN if c.isalpha() else ODD_ELSEWHERE), 0
        upper = c.isupper()
        if b and ((upper and before.islower()) or (not upper and before.isupper() and after.isupper())):
            return WRONG_CASE, k
        if not b and not upper and after.isupper() and INDEX.get(after):
            return WRONG_CASE, k
        return self.model[a][b][k], k

    def label(self, word: str, known: frozenset) -> tuple[tuple[int, str, str], ...]:
        """Segments (state, as read, restored) of the word along the best path."""
        cached = self.seen.get((word, known))
        if cached is None:
            if len(self.seen) > 200_000:  # bounds memory; a word is labelled alike each time
                self.seen.clear()
            cached = self.seen[word, known] = self._label(word, known)
        return cached

    def _label(self, word: str, known: frozenset) -> tuple[tuple[int, str, str], ...]:
        n, table = len(word), inverse()
        # best[t]: state -> (score, previous t, previous state, restored, symbol before last, last symbol)
        best: list[dict[int, tuple]] = [{} for _ in range(n + 1)]
        best[0][0] = (0.0, -1, -1, "", 0, 0)
        lost = len(STATES) - 1  # lost + k: a question mark in place of the letter with the symbol k
        marks = "?" in word and not QUERY.search(word)
        for t in range(n):
            c = word[t]
            options = [(s, read, true) for s, read, true in table.get(c, ()) if word.startswith(read, t)]
            if c == "+" and (m := UTF7.match(word, t)):
                try:
                    options.append((len(PAIRS), m.group(), m.group().encode().decode("utf-7")))
                except UnicodeDecodeError:
                    pass
            after = word[t + 1] if t + 1 < n else " "
            if c == "�":
                options.append((lost, c, c))
            elif c == "?" and marks:  # one for each letter, or one for each of its two bytes
                options += [(lost + k, read, read) for read in ("?", "??") if word.startswith(read, t) for k in LOSABLE]
            for state, (score, _, _, _, a, b) in best[t].items():
                before = word[t - 1] if t else " "
                k = INDEX.get(c, 0)
                if c == "�":
                    cost, k = -40.0, 0
                elif k:
                    cost = WRONG_CASE if c.isupper() and before.islower() and c > "\x7f" else self.model[a][b][k]
                elif c in "\xa0\u2007\u202f":
                    cost = self.model[a][b][0] + BLANK
                elif c <= "\x7f":
                    cost = self.model[a][b][0]
                    if c == "?" and marks:
                        cost += MARK_AGAIN if before == "?" else (MARK_WITHIN if before.isalpha() else MARK_BEFORE) if word[t:].lstrip("?-")[:1].isalpha() else MARK_BEHIND if before.isalpha() else 0.0
                else:
                    within = before.isalpha() and after.isalpha() and INDEX.get(before) and INDEX.get(after)
                    other = c.isalpha() and c > "ɏ"
                    cost = -9.0 if other else ODD_WITHIN if within else ODD_ELSEWHERE
                step = cost + (LEAVE if state else 0.0)
                self._keep(best[t + 1], 0, (score + step, t, state, c, b, k))
                for s, read, true in options:
                    x, y, cost, end = a, b, 0.0, t + len(read)
                    if s > lost:
                        x, y, cost = b, s - lost, self.model[a][b][s - lost]
                        cost += self.model[x][y][0] if end == n else 0.0
                    for one in true if s <= lost else "":
                        p, y2 = (-6.0, 0) if s == lost else self.true_character(one, x, y, before, word[end] if end < n else " ")
                        x, y, cost = y, y2, cost + p
                    move = STAY if min(s, lost) == min(state, lost) else ENTER_KNOWN if min(s, lost) in known else ENTER
                    self._keep(best[t + len(read)], s, (score + cost + move, t, state, true, x, y))
        state = max(best[n], key=lambda s: best[n][s][0])
        t, out = n, []
        while t > 0:
            _, before, previous, restored, _, _ = best[t][state]
            out.append((min(state, lost), word[before:t], restored))
            t, state = before, previous
        inner = out[bool(out[0][1] in QUOTES) : len(out) - (out[-1][1] in QUOTES)]  # a quoted word is a word
        if any(not s and c > "\x7f" and c not in SIGNS and unicodedata.category(c)[0] in "SP" for s, c, _ in inner):
            return tuple((0, c, c) for c in word)  # a heap of signs, not a word
        return tuple(reversed(out))

    @staticmethod
    def _keep(cell: dict[int, tuple], state: int, entry: tuple) -> None:
        if state not in cell or cell[state][0] < entry[0]:
            cell[state] = entry

    def repair(self, text: str) -> tuple[str, list[str], int]:
        """The restored text, the names of the garbled states in it, and the number of garbled spans."""
        if not ODD.search(text):
            return text, [], 0
        composed = unicodedata.normalize("NFC", text) if re.search("[̀-ͯ]", text) else text
        words = {w for w in TOKEN.findall(composed) if ODD.search(w)}
        known = self._states(words, frozenset())
        if not known:
            return text, [], 0
        known = frozenset(self._states(words, frozenset(known)) | known)
        spans, states = 0, set()

        def restored(match: re.Match) -> str:
            nonlocal spans
            if not ODD.search(match.group()):
                return match.group()
            out, last = [], 0
            for state, _, true in self._segments(match.group(), known):
                spans += bool(state) and state != last
                last = state
                if state:
                    states.add(state)
                out.append(true)
            return "".join(out)

        fixed = TOKEN.sub(restored, composed)
        return (fixed, sorted(STATES[s] for s in states), spans) if spans else (text, [], 0)

    def _segments(self, word: str, known: frozenset) -> list[tuple[int, str, str]]:
        if len(word) <= PIECE:
            return list(self.label(word, known))
        escapes = [m.span() for m in UTF7.finditer(word)] if "+" in word else []
        out, begin = [], 0
        while begin < len(word):
            end = len(word)
            if end - begin > PIECE:
                place = next((m.start() for m in SAFE.finditer(word, begin + PIECE) if not any(a < m.start() < b for a, b in escapes)), end)
                end = place
            out.extend(self.label(word[begin:end], known))
            begin = end
        return out

    def _states(self, words: set[str], known: frozenset) -> set[int]:
        return {state for w in words for state, _, _ in self._segments(w, known) if state}


def repair_encoding(df: DataFrame, model: np.ndarray, key: str = "row_id", text: str = "text") -> DataFrame:
    """One row for every row of ``df``: key, ``garbled``, ``states`` (the pairs found), ``spans``, ``restored``.

    ``restored`` is the text with every garbled span replaced by what its state's inverse transform gives; lost characters stay
    as their substitutes. A clean text is returned as it is. A null text is not garbled and stays null, an empty one stays
    empty. Whole texts are labelled. Null keys and repeated rows are kept; other columns are not carried.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [
            T.StructField(key, rows.schema["_key"].dataType),
            T.StructField("garbled", T.BooleanType()),
            T.StructField("states", T.ArrayType(T.StringType())),
            T.StructField("spans", T.IntegerType()),
            T.StructField("restored", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = [(None, [], 0) if t is None else labeller.repair(t) for t in part.column(1).to_pylist()]
                restored, states, spans = zip(*found) if found else ((), (), ())
                columns = [pa.array([n > 0 for n in spans], pa.bool_()), pa.array(states, pa.list_(pa.string())), pa.array(spans, pa.int32()), pa.array(restored, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)
