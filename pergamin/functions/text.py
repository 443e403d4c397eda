"""Text metrics, scores, tokens, stamps, markers and identifiers as column expressions.

Everything is built in and stays in the JVM. Metrics are meant to be added as columns of their own (``with_metrics``), so that
no pattern runs twice. A null text gives null; what an empty one gives is said at each function.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C


def strip(text: Column) -> Column:
    """Without white space at its ends, as Python has it."""
    return F.btrim(text, F.lit(C.SPACES))


def removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def share_of(text: Column, pattern: str, empty: float) -> Column:
    """Share of the characters that the pattern takes away; ``empty`` for an empty text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(empty)).otherwise((n - F.length(removed(text, pattern))) / n)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.WORD), F.lit(0))


def latin_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(C.LATIN_WORD), F.lit(0)), F.lower)


def share(items: Column, test, empty: float) -> Column:
    return F.when(F.size(items) == 0, F.lit(empty)).otherwise(F.size(F.filter(items, test)) / F.size(items))


def normalize(text: Column) -> Column:
    """Native text: no-break space as a space, no soft hyphens, single blanks, at most one empty line, stripped."""
    plain = F.translate(text, " ­", " ")
    return strip(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def odd_char_ratio(text: Column) -> Column:
    """Share of the characters that no document of the corpus prints; 1 for an empty text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.length(F.translate(text, C.USUAL, "")) / n)


def control_char_ratio(text: Column) -> Column:
    return share_of(text, C.CONTROL_CHARACTER, 0.0)


def glyph_index_ratio(text: Column) -> Column:
    return share_of(text, C.GLYPH_INDEX, 0.0)


def short_line_ratio(text: Column) -> Column:
    """Share of lines under 20 characters among those that are not blank; 1 if there are none."""
    lines = F.filter(F.transform(F.split(text, C.LINE_BREAK), strip), lambda x: x != "")
    return share(lines, lambda x: F.length(x) < 20, 1.0)


def single_char_word_ratio(text: Column) -> Column:
    return share(words(text), lambda w: F.length(w) == 1, 1.0)


def domain_hits(text: Column) -> Column:
    """How many of the patterns of the domain occur as words. Each begins with its letters, which are looked for fast, and looks
    behind them last."""
    low, inner = F.lower(text), r"[\p{L}\p{N}_]"
    return sum((low.rlike(f"{p}(?<!{inner}{p})(?!{inner})").cast("int") for p in C.DOMAIN), F.lit(0))


METRICS = ("odd_chars", "short_lines", "single_chars", "glyph_index", "control_chars", "stopwords", "latin_words", "domain")


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds METRICS, ratios rounded to four decimals: decisions compare the rounded ones."""
    t = F.col(text)
    found = df.withColumn("_latin", latin_words(t))
    stop = F.filter("_latin", lambda w: w.isin(C.STOPWORDS))
    n = F.size("_latin")
    ratio = F.when(n == 0, F.lit(0.0)).otherwise(F.size(stop) / n)
    columns = {
        "odd_chars": odd_char_ratio(t), "short_lines": short_line_ratio(t), "single_chars": single_char_word_ratio(t), "glyph_index": glyph_index_ratio(t),
        "control_chars": control_char_ratio(t), "stopwords": F.when(t.isNotNull(), ratio), "domain": domain_hits(t) / F.lit(len(C.DOMAIN)),
    }
    rounded = {k: F.round(v, 4) for k, v in columns.items()}
    return found.withColumns(rounded).withColumn("latin_words", F.when(t.isNotNull(), n)).drop("_latin")


def _steps(value: Column, *limits: tuple[float, float], below: bool = False) -> Column:
    """The first delta whose limit is passed, else 0."""
    chosen = F.lit(0.0)
    for limit, delta in reversed(limits):
        chosen = F.when(value < limit if below else value > limit, F.lit(delta)).otherwise(chosen)
    return chosen


def form_delta() -> list[Column]:
    c = F.col
    return [_steps(c("odd_chars"), (0.15, -0.30), (0.05, -0.15)), _steps(c("short_lines"), (0.60, -0.20), (0.40, -0.10)), _steps(c("single_chars"), (0.20, -0.20), (0.10, -0.10))]


def plausibility_delta() -> list[Column]:
    c = F.col
    plausible = F.when(c("latin_words") >= 15, _steps(c("stopwords"), (0.02, -0.45), (0.08, -0.25), below=True)).otherwise(F.lit(0.0))
    return [_steps(c("glyph_index"), (0.30, -0.60), (0.10, -0.30)), _steps(c("control_chars"), (0.05, -0.40)), plausible]


def domain_delta() -> Column:
    return F.when(F.col("domain") < 0.03, F.lit(-0.15)).when(F.col("domain") > 0.10, F.lit(0.05)).otherwise(F.lit(0.0))


def _clamped(deltas: list[Column]) -> Column:
    total = F.lit(1.0)
    for delta in deltas:
        total = total + delta
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def label(score: Column) -> Column:
    return F.when(score >= 0.75, "good").when(score >= 0.50, "fair").otherwise("poor")


def with_score(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``score`` and ``label`` to a frame with METRICS. A blank text scores 0."""
    raw = F.when(strip(F.col(text)) == "", F.lit(0.0)).otherwise(_clamped([*form_delta(), *plausibility_delta(), domain_delta()]))
    raw = F.when(F.col(text).isNotNull(), raw)
    return df.withColumn("_raw", raw).withColumn("score", F.round("_raw", 4)).withColumn("label", F.when(F.col("_raw").isNotNull(), label(F.col("_raw")))).drop("_raw")


#: What each step of the score means, in the order of the deltas.
FORM_REASONS = (("odd_chars", (0.15, "many odd characters"), (0.05, "some odd characters")), ("short_lines", (0.60, "mostly short lines"), (0.40, "many short lines")), ("single_chars", (0.20, "many words of one character"), (0.10, "some words of one character")))
READING_REASONS = (("glyph_index", (0.30, "glyph indices instead of text"), (0.10, "passages of glyph indices")), ("control_chars", (0.05, "control characters")))


def score_reasons(text: Column, structure: bool = False) -> Column:
    """Why a frame with METRICS scores as it does: one phrase for every step taken, in order. ``structure``: of the structure
    score, which looks at chars_per_page, empty_pages and fragmentation as well."""
    c = F.col

    def above(name: str, *steps: tuple[float, str]) -> Column:
        chosen = F.lit(None).cast("string")
        for limit, why in reversed(steps):
            chosen = F.when(c(name) > limit, F.lit(why)).otherwise(chosen)
        return chosen

    few = F.when(c("latin_words") >= 15, F.when(c("stopwords") < 0.02, "no function words").when(c("stopwords") < 0.08, "few function words"))
    reasons = [*(above(n, *s) for n, *s in FORM_REASONS), *(above(n, *s) for n, *s in READING_REASONS), few]
    domain = F.when(c("domain") < 0.03, "no words of the domain")
    if structure:
        dense = F.when(c("chars_per_page") < 50, "hardly any text on a page").when(c("chars_per_page") < 300, "little text on a page")
        empty = F.when(c("empty_pages") > 0.30, "many empty pages").when(c("empty_pages") > 0.10, "some empty pages")
        return F.array_compact(F.array(dense, *reasons, empty, domain, F.when(c("fragmentation") > 0.08, "text in many blocks")))
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).when(strip(text) == "", F.array(F.lit("no text"))).otherwise(F.array_compact(F.array(*reasons, domain)))


def with_structure_score(df: DataFrame) -> DataFrame:
    """Adds ``structure_score`` to a frame with METRICS, chars_per_page, empty_pages and fragmentation."""
    c = F.col
    deltas = [_steps(c("chars_per_page"), (50, -0.45), (300, -0.25), below=True), *form_delta(), *plausibility_delta(), _steps(c("empty_pages"), (0.30, -0.30), (0.10, -0.15)), domain_delta(), _steps(c("fragmentation"), (0.08, -0.10))]
    return df.withColumn("structure_score", F.round(_clamped(deltas), 4))


def strip_stamp(text: Column, patterns: tuple[str, ...] | None = None) -> Column:
    """The text without the conformity stamp, blanks collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(text, f"(?ius){'|'.join(patterns or C.STAMP)}", " "), f"{C.SPACE}{{2,}}", " "))


def useful_words(text: Column, patterns: tuple[str, ...] | None = None) -> Column:
    return F.size(F.regexp_extract_all(strip_stamp(text, patterns), F.lit(C.LATIN_WORD), F.lit(0)))


def vocabulary(text: Column, patterns: tuple[str, ...] | None = None) -> Column:
    return F.array_distinct(latin_words(strip_stamp(text, patterns)))


def real_content(text: Column) -> Column:
    """What is left beside the marks of unread passages."""
    return strip(F.regexp_replace(F.regexp_replace(text, f"(?iu){C.UNREAD}", " "), f"{C.SPACE}+", " "))


def marker_fraction(text: Column) -> Column:
    whole = F.length(strip(text))
    return F.when(whole == 0, F.lit(0.0)).otherwise(1 - F.length(real_content(text)) / whole)


def anchors(text: Column) -> Column:
    """Identifiers that a better reading must not lose, sorted: codes of letters and digits, punctuated ones, runs of digits."""
    codes = F.filter(words(F.upper(text)), lambda w: w.rlike(r"\A[A-Z0-9]{8,}\z") & w.rlike("[A-Z]") & (F.length(removed(w, "[^0-9]")) >= 4))
    punctuated = F.filter(F.transform(F.regexp_extract_all(text, F.lit(C.PUNCTUATED), F.lit(0)), lambda x: removed(x, "[^0-9]")), lambda x: F.length(x) >= 8)
    runs = F.regexp_extract_all(text, F.lit(C.DIGIT_RUN), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(codes, punctuated, runs)))


def lost_anchors(previous: Column, new: Column) -> Column:
    """Those of ``previous`` that no anchor of ``new`` contains."""
    return F.filter(previous, lambda a: ~F.exists(new, lambda b: F.contains(b, a)))


def compatible_forms() -> tuple[str, str]:
    """Characters with a compatible form of one letter or digit without accents, by rule, for ``translate``."""
    source, target = [], []
    for point in [*range(0x80, 0x2000), *range(0x2100, 0x2200), *range(0xFF00, 0xFFF0)]:
        c = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and plain.isascii() and plain.isalnum():
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


def card_text(text: Column) -> Column:
    """Upper-case letters and digits without accents, single blanks: the form in which card labels are compared."""
    plain = F.regexp_replace(F.translate(text, *compatible_forms()), r"\p{Mn}+", "")
    return F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9 ]", " "), " +", " "), r"\A | \z", ""))


def card_marks(card: Column) -> Column:
    found = sum((F.contains(card, F.lit(m)).cast("int") for m in C.IDENTITY_MARKS), F.lit(0))
    return found + card.rlike(C.TRAFFIC_OFFICE).cast("int")
