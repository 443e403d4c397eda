"""Running text out of broken lines, and the repair of amounts, as expressions over the lines of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C
from pergamin.functions import text as X

# Letters of other scripts that print like Latin ones; what keeps its break; what ends or opens a sentence.
HOMOGLYPHS = ("АВЕКМНОРСТУХаеорсухİıăĂșț", "ABEKMHOPCTYXaeopcyxIiaAst")
STRUCTURE = rf"\A{C.SPACE}*(?:#{{1,6}}{C.SPACE}|\||[-*+]{C.SPACE}|[0-9]+[.)]{C.SPACE}|>{C.SPACE}|```)"
BARE_MARK = rf"\A{C.SPACE}*(?:#{{1,6}}|[-*+]|[0-9]+[.)]|>)\z"
SENTENCE_END = rf"[.:;!?»\"']{C.SPACE}*\z"
TITLE = rf"\A(?:[A-ZÀ-Þ0-9][A-ZÀ-Þ0-9{C.SPACE_SET}.ºª°/-]{{6,}}\z|[A-ZÀ-Þ][\p{{L}}\p{{N}}_{C.SPACE_SET}]{{2,30}}:{C.SPACE}*\z)"
STAMP_FOOTER = "[digital conformity stamp]"


def join(previous: Column, following: Column) -> Column:
    """How a line goes on in the next one: keep (the break), glue, unhyphen or space. The first rule that applies decides."""
    a, b = F.regexp_replace(previous, rf"{C.SPACE}+\z", ""), F.regexp_replace(following, rf"\A{C.SPACE}+", "")
    hyphen = a.rlike(r"[\p{L}\p{N}_]-\z") & b.rlike(r"\A\p{Ll}")
    abbreviated = F.right(a, F.lit(12)).rlike(C.ABBREVIATION)
    return (
        F.when(previous.isNull() | following.isNull() | (a == "") | (b == ""), "keep")
        .when(previous.rlike(STRUCTURE) | following.rlike(STRUCTURE), "keep")
        .when(a.rlike(r"[0-9][-/]\z") & b.rlike(r"\A[0-9]"), "glue")
        .when(hyphen & b.rlike(C.ENCLITIC), "glue")
        .when(hyphen, "unhyphen")
        .when(a.rlike(SENTENCE_END) & ~abbreviated, "keep")
        .when(abbreviated & b.rlike(r"\A[0-9]"), "space")
        .when(b.rlike(TITLE), "keep")
        .otherwise("space")
    )


def rebuild(text: Column) -> Column:
    """Lines joined to paragraphs; a line that is only a page number goes without leaving a break.

    A break is decided by the two lines at it, and not by what stands before them in the paragraph, but for one case: a mark that
    stands alone ("1)") is structure as soon as a line is joined to it, so the next break is kept. Lines are written as letters
    for that, one each, and a pattern goes over them once. The work is in proportion to the text, however long a paragraph gets.
    """
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, rf"{C.SPACE}+\z", "")), lambda x: ~x.rlike(C.PAGE_NUMBER_ONLY))

    def build(lines: Column) -> Column:
        nothing = F.lit(None).cast("string")
        n = F.size(lines)
        before = F.array_prepend(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0))), nothing)
        behind = F.array_append(F.slice(lines, F.lit(2), F.greatest(n - 1, F.lit(0))), nothing)
        how = F.zip_with(before, lines, join)
        code = lambda x, j: F.when(j == "keep", F.when(x.rlike(BARE_MARK), "M").otherwise("P")).when(j == "space", F.when(x.rlike(BARE_MARK), "m").otherwise("s")).otherwise("g")
        codes = F.regexp_extract_all(F.regexp_replace(F.array_join(F.zip_with(lines, how, code), ""), "(?:M|\\Gm)[sm](?=[smg])", "$0/"), F.lit("[MPsmg]/?"), F.lit(0))
        after = F.zip_with(codes, F.array_append(F.slice(how, F.lit(2), F.greatest(n - 1, F.lit(0))), F.lit("keep")), lambda c, j: F.when(F.length(c) > 1, "keep").otherwise(j))
        opened = F.array_prepend(F.slice(after, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit("keep"))
        decided = F.zip_with(F.zip_with(lines, behind, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.zip_with(opened, after, lambda b, a: F.struct(b.alias("b"), a.alias("a"))), lambda z, j: F.struct(z["x"].alias("x"), z["y"].alias("y"), j["b"].alias("before"), j["a"].alias("after")))

        def piece(r: Column) -> Column:
            line = F.when(r["before"] == "keep", r["x"]).otherwise(F.regexp_replace(r["x"], rf"\A{C.SPACE}+", ""))
            line = F.when(r["after"] == "unhyphen", F.regexp_replace(line, r"-\z", "")).otherwise(line)
            gap = F.when(r["y"].isNull(), "").when(r["after"] == "keep", "\n").when(r["after"] == "space", " ").otherwise("")
            return F.concat(line, gap)

        return F.array_join(F.transform(decided, piece), "")

    return F.element_at(F.transform(F.array(kept), build), 1)  # the lines are computed once, as a lambda's variable


def fix_thousands(text: Column) -> Column:
    """9,159.70 and 5,000,00 as 9.159,70 and 5.000,00."""

    def repaired(t: Column) -> Column:
        parts, found = F.split(t, C.ENGLISH_THOUSANDS), F.regexp_extract_all(t, F.lit(C.ENGLISH_THOUSANDS), F.lit(0))
        fixed = F.transform(found, lambda x: F.concat(F.translate(F.substring(x, F.lit(1), F.length(x) - 3), ",", "."), F.lit(","), F.right(x, F.lit(2))))
        return F.array_join(F.flatten(F.zip_with(parts, F.array_append(fixed, F.lit("")), lambda p, f: F.array(p, F.coalesce(f, F.lit(""))))), "")

    return F.element_at(F.transform(F.array(text), repaired), 1)  # the text is computed once, as a lambda's variable


def normalize(text: Column) -> Column:
    """The final text; null for null, empty for empty: Latin letters, stamp lines moved to the end and each given once, broken lines rebuilt, amounts repaired."""
    plain = F.translate(text, *HOMOGLYPHS)
    lines = F.split(plain, "\n")
    stamped = lambda x: x.rlike(f"(?iu){C.STAMP_LINE}")
    some = stamped(plain)  # few texts have a stamp: the others are not parted for it
    stamps = F.when(some, F.array_distinct(F.transform(F.filter(lines, stamped), lambda x: X.strip(F.regexp_replace(x, f"{C.SPACE}+", " "))))).otherwise(F.array().cast("array<string>"))
    body = F.when(some, F.array_join(F.filter(lines, lambda x: ~stamped(x)), "\n")).otherwise(plain)
    body = F.regexp_replace(body, rf"R\${C.SPACE}*\n{C.SPACE}*(?=[0-9])", "R\\$ ")
    body = F.regexp_replace(rebuild(body), r"R\$(?=[0-9])", "R\\$ ")
    body = fix_thousands(F.regexp_replace(body, C.WRONG_CURRENCY, "R\\$ "))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"§\$", "§§"), "[ \t]{2,}", " "), "\n{3,}", "\n\n")
    return F.when(F.size(stamps) > 0, F.concat(X.strip(body), F.lit(f"\n\n{STAMP_FOOTER}\n"), F.array_join(stamps, "\n"))).otherwise(X.strip(body))


def _blocks(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(C.DELIMITED), F.lit(1)), X.strip), lambda x: x != "")


def clean_response(text: Column) -> Column:
    """A model's answer without its fence, its thoughts and its preamble; delimited pages are joined."""
    bare = F.regexp_replace(X.strip(text), C.MD_FENCE, "")
    blocks = _blocks(bare)
    rest = F.regexp_replace(bare, C.AFTER_THINK, "")
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).otherwise(X.strip(F.regexp_replace(rest, C.LEADING_META, "")))


def response_blocks(text: Column) -> Column:
    """The delimited pages of an answer; one without any is a page as a whole, and an empty or null one has none."""
    blocks, cleaned = _blocks(F.regexp_replace(X.strip(text), C.MD_FENCE, "")), clean_response(text)
    return F.when(F.coalesce(cleaned, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(blocks) > 0, blocks).otherwise(F.array(cleaned))


def without_images(text: Column) -> Column:
    """Converted text without the marks of its images, at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(text, C.IMAGE_MARK, ""), r"\n{3,}", "\n\n")


def converted_is_empty(text: Column, least: int = 40) -> Column:
    """Whether converted text holds next to nothing but marks of images."""
    return F.length(X.strip(F.coalesce(without_images(text), F.lit("")))) < least
