"""Problem 4: texts that look the same but differ in their characters.

Characters are mapped to what they look like (full-width and font variants, blanks of any kind, letters of other scripts that
print like Latin ones, ligatures); texts are then grouped in SQL under Spark's accent-sensitive, case-sensitive Unicode collation,
for which composed and decomposed accents are equal and zero-width characters count for nothing. Each class gets one of its
members as its canonical form, the same whatever the order of the rows, and it is joined back. As grouping under a collation
sorts, it is applied to those texts alone whose skeleton of plain letters and digits occurs in a text of odd characters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergamin.session import write_through

# Letters of other scripts and the Latin letters they print like.
LOOK_ALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Լ": "L",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ƨ": "s",
    "‐": "-", "‑": "-", "˗": "-", "՚": "’", "ʼ": "’", "‚": ",", "٫": ",", "۔": "-", "։": ":", "ː": ":", "∶": ":", "․": ".", "ǃ": "!", "；": ";", ";": ";", "·": "·", "∕": "/", "⁄": "/", "¸": "¸",
}
# Ligatures and the letters they print like.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Characters that map to themselves and have one form only; a text of these alone is its own canonical form.
PLAIN = r"[\x20-\x7e\t\nÀ-ÖØ-öø-ÿªº§°–—“”‘’•€]*"
# Characters without width that a collation may not ignore.
NO_WIDTH = "".join(map(chr, (*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, 0x034F, 0x061C, 0x180E, 0xAD, *range(0xFE00, 0xFE10))))
#: Letters and digits at the start of a text that make its first block.
START = 24


@lru_cache(maxsize=1)
def mapping() -> tuple[str, str]:
    """Characters and, in the same order, the single characters they look like: the fixed ones, and by rule those that Unicode
    calls width, font or no-break variants, blanks, characters that are another one by definition (the sign of Kelvin is a K), and
    accented forms of the fixed ones."""
    table = {}
    for point in [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(point)
        decomposition, composed = unicodedata.decomposition(c), unicodedata.normalize("NFC", c)
        if unicodedata.category(c) == "Zs":
            table[c] = " "
        elif composed != c and len(composed) == 1:
            table[c] = LOOK_ALIKE.get(composed, composed)
        elif decomposition.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1:
                table[c] = LOOK_ALIKE.get(plain, plain)
        elif decomposition and not decomposition.startswith("<"):
            letters = unicodedata.normalize("NFD", c)
            mapped = unicodedata.normalize("NFC", "".join(LOOK_ALIKE.get(x, x) for x in letters))
            if letters[0] in LOOK_ALIKE and len(mapped) == 1 and mapped != c:
                table[c] = mapped
    table |= {c: x for c, x in LOOK_ALIKE.items() if c != x}
    table = {c: table.get(x, x) for c, x in table.items()}  # of what a character is by definition, what that looks like
    return "".join(table), "".join(table.values())


def is_odd(text: Column) -> Column:
    """Whether a text holds a character that may have another form, or blanks at the end of a line, which do not show."""
    return ~text.rlike("\\A" + PLAIN + "\\z") | ends_blank(text)


def mapped(text: Column) -> Column:
    """The text with every character replaced by what it looks like, those without width left out.

    A soft hyphen shows at the end of a line and nowhere else; blanks at the end of a line do not show.
    """
    hyphens = F.when(F.contains(text, F.lit("\xad")), F.regexp_replace(text, "\\x{00ad}(?=[ \\t]*(\\n|\\z))", "-")).otherwise(text)
    source, target = mapping()
    seen = F.translate(hyphens, source + NO_WIDTH, target)  # characters without a counterpart are left out
    for ligature, letters in LIGATURES.items():
        seen = F.replace(seen, F.lit(ligature), F.lit(letters))
    return F.regexp_replace(seen, "[ \\t\\r]+(?=\\n|\\z)", "")


def ends_blank(text: Column) -> Column:
    return text.endswith(" ") | text.endswith("\t") | text.endswith("\r") | text.contains(" \n") | text.contains("\t\n") | text.contains("\r\n")


def with_look(rows: DataFrame, text: str = "_text") -> DataFrame:
    """Adds ``_odd`` and ``_seen``: an odd text as it looks, any other as it is. As columns of their own they are evaluated once."""
    return rows.withColumn("_odd", is_odd(F.col(text))).withColumn("_seen", F.when(F.col("_odd"), mapped(F.col(text))).otherwise(F.col(text)))


def _bare(seen: Column, odd: Column) -> Column:
    """The text without the letters that carry a combining mark: composed, they are none of the plain letters either."""
    return F.when(odd & seen.rlike("\\p{M}"), F.regexp_replace(seen, "[A-Za-z]\\p{M}+", "")).otherwise(seen)


def _blocked(df: DataFrame, key: str, text: str, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the block of their place and first plain letters and digits, and the blocks that hold an odd text: plain texts
    that look the same are the same, so no other block has anything to compare. Accented letters do not count, however they
    are composed."""
    rows = with_look(df.select(*place, F.col(key).alias("_id"), F.col(text).cast("string").alias("_text")))
    start = F.regexp_extract(_bare(F.col("_seen"), F.col("_odd")), "\\A(?:[^A-Za-z0-9]*+[A-Za-z0-9]){0,%d}" % START, 0)
    rows = rows.withColumn("_block", F.xxhash64(*place, F.regexp_replace(start, "[^A-Za-z0-9]+", "")))
    return rows.select(*place, "_id", "_text", "_block"), rows.where("_odd").select("_block").distinct()


def _narrowed(rows: DataFrame, place: list[str]) -> DataFrame:
    """Candidates whose block, now of all their plain letters and digits, still holds more than one text."""
    seen = with_look(_mixed(rows))
    whole = F.xxhash64(*place, F.regexp_replace(_bare(F.col("_seen"), F.col("_odd")), "[^A-Za-z0-9]+", ""))
    return _mixed(write_through(seen.withColumn("_block", whole).drop("_seen", "_odd"), "look"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Those rows whose block holds more than one text."""
    mixed = rows.groupBy("_block").agg(F.min("_variant").alias("_low"), F.max("_variant").alias("_high")).where("_low <> _high")
    return rows.join(mixed.select("_block"), "_block", "left_semi")


def _classes(variants: DataFrame, place: list[str]) -> DataFrame:
    """Rows (place, _block, _variant, _canonical) for the different texts of mixed blocks.

    Grouped by the collation, and by the digits, which it does not tell apart between scripts.
    """
    seen = with_look(variants)
    seen = seen.withColumn("_digits", F.regexp_replace("_seen", "[^\\p{Nd}]+", "")).withColumn("_look", F.collate("_seen", "UNICODE"))
    odd = F.length(F.regexp_replace("_text", PLAIN.removesuffix("*"), ""))
    group = [*place, "_block", "_digits", "_look"]
    best = seen.groupBy(*group).agg(F.min(F.struct(odd.alias("odd"), F.col("_text").alias("text"))).alias("_best"))
    return seen.join(best, group).select(*place, "_block", "_variant", F.col("_best.text").alias("_canonical"))


def canonical_forms(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for every row of ``df``: key, ``canonical`` (of the texts that look like its own the one with the fewest
    characters outside the plain ones, then the first by code points) and ``look`` (a digest that names the class).

    A null text has null in both; empty and blank texts that show the same are a class like any other. Null keys and repeated
    rows are kept; other columns are not carried. Only texts whose skeleton occurs with another text are compared, each
    different text once, so a class of a third of all rows costs one row of every task.
    """
    rows, mixed = _blocked(df, key, text, [])
    rows = rows.withColumn("_variant", F.md5("_text"))
    variants = rows.where(F.col("_text").isNotNull()).join(mixed, "_block", "left_semi").groupBy("_block", "_variant").agg(F.min("_text").alias("_text"))
    forms = _classes(_narrowed(write_through(variants, "look"), []), []).select("_variant", "_canonical")
    none = rows.where(F.col("_text").isNull()).withColumn("_canonical", F.col("_text"))  # would be one key
    joined = rows.where(F.col("_text").isNotNull()).join(forms, "_variant", "left").unionByName(none).withColumn("canonical", F.coalesce("_canonical", "_text"))
    return joined.select(F.col("_id").alias(key), "canonical", F.md5("canonical").alias("look"))


def same_look_pairs(df: DataFrame, place: list[str], row_id: str, text: str = "text", keep: str | None = None) -> DataFrame:
    """Rows (low_id, high_id), with the column ``keep`` of the place before them if named: rows of the same ``place`` that look the same and whose stored texts differ.

    Rows given again under the same id count once for each of their texts. Null and blank texts, null ids and null places have
    no pair. Pairs are formed between the few different texts of a class and then between their rows, never between rows of
    the same text, so the work follows the result and not the square of a group of copies.
    """
    rows, mixed = _blocked(df.dropna(subset=[*place, row_id, text]), row_id, text, place)
    few = rows.join(mixed, "_block", "left_semi").withColumn("_variant", F.md5("_text"))
    few = _narrowed(write_through(few, "look"), place)
    variants = few.groupBy(*place, "_block", "_variant").agg(F.min("_text").alias("_text"))
    classes = _classes(variants, place).where(F.trim(mapped(F.col("_canonical"))) != "").select(*place, "_block", "_variant", F.md5("_canonical").alias("_look"))
    ids = few.select(*place, "_block", "_variant", "_id").distinct().join(classes, [*place, "_block", "_variant"])
    ids = ids.select(F.xxhash64("_look", *place).alias("_class"), "_look", *place, "_variant", "_id")
    kinds = ids.select("_class", "_look", *place, "_variant").distinct()
    pairs = kinds.join(kinds.withColumnRenamed("_variant", "_other"), ["_class", "_look", *place]).where("_variant < _other")
    left = ids.join(pairs, ["_class", "_look", *place, "_variant"]).select("_class", "_look", *place, F.col("_other").alias("_variant"), F.col("_id").alias("_left"))
    both = left.join(ids, ["_class", "_look", *place, "_variant"]).where("_left <> _id")
    return both.select(*[keep] * bool(keep), F.least("_left", "_id").alias("low_id"), F.greatest("_left", "_id").alias("high_id")).distinct()
