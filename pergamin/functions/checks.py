"""Check digits of numbers in text, by arithmetic on their digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of a person's tax id and of a case number.
TAX_ID, CASE_NUMBER = r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}", r"[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4}"


def _digit(number: Column, k: int) -> Column:
    return F.substring(number, k, 1).cast("int")


def tax_id_valid(number: Column) -> Column:
    """Both check digits modulo 11 over the eleven digits; equal digits throughout are no tax id."""
    digits = F.regexp_replace(number, "[^0-9]", "")

    def check(n: int) -> Column:
        total = F.lit(0)
        for k in range(n):
            total = total + _digit(digits, k + 1) * (n + 1 - k)
        return (total * 10) % 11 % 10

    return (check(9) == _digit(digits, 10)) & (check(10) == _digit(digits, 11)) & ~digits.rlike(r"\A(.)\1*\z")


def case_number_valid(number: Column) -> Column:
    """98 less the remainder by 97 of the number with its check digits moved to the end as zeros."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    moved = F.concat(F.substring(digits, 1, 7), F.substring(digits, 10, 11), F.lit("00")).cast("decimal(38,0)")
    return (98 - moved % 97).cast("int") == F.substring(digits, 8, 2).cast("int")


# Form and weights of a firm's tax id; hosts of examples; what a line carries that is not to be looked at.
COMPANY_ID = r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}"
COMPANY_WEIGHTS = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
EMAIL, EXAMPLE_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"noreply@|example\.(?:com|org)|localhost|\.(?:test|example|invalid)\z"
ADDRESS = r"https?://[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SECRET = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:api[_-]?key|token|senha|password)[ \t]*[:=][ \t]*['\"][^'\"\n]{16,}['\"]"
IGNORED_LINE = r"(?m)^[^\n]*privacy-check: allow[^\n]*$"


def company_id_valid(number: Column) -> Column:
    """Both weighted check digits modulo 11 over the fourteen digits; equal digits throughout are no id."""
    digits = F.regexp_replace(number, "[^0-9]", "")

    def check(n: int) -> Column:
        total = F.lit(0)
        for k, weight in enumerate(COMPANY_WEIGHTS[13 - n :]):
            total = total + _digit(digits, k + 1) * weight
        return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)

    return (check(12) == _digit(digits, 13)) & (check(13) == _digit(digits, 14)) & ~digits.rlike(r"\A(.)\1*\z")


def masked(value: Column) -> Column:
    """A found value so that a report does not give it away: its first four and last two characters."""
    n = F.length(value)
    return F.when(n > 6, F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), n - 6), F.right(value, F.lit(2)))).otherwise(F.lit("***"))


def privacy(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What a text gives away: firms' ids with right check digits, mail addresses that are no examples (the first one masked),
    addresses of hosts by number, secrets. Lines that say so are passed over."""
    kept = F.regexp_replace(F.col(text), IGNORED_LINE, "")
    found = df.select(key, F.regexp_extract_all(kept, F.lit(COMPANY_ID), F.lit(0)).alias("c"), F.filter(F.regexp_extract_all(kept, F.lit(EMAIL), F.lit(0)), lambda m: ~m.rlike(EXAMPLE_EMAIL)).alias("m"), F.regexp_count(kept, F.lit(ADDRESS)).alias("addresses"), F.regexp_count(kept, F.lit(SECRET)).alias("secrets"))
    return found.select(key, F.size("c").alias("company_ids"), F.size(F.filter("c", company_id_valid)).alias("valid_company_ids"), F.size("m").alias("emails"), masked(F.try_element_at("m", F.lit(1))).alias("first_email"), "addresses", "secrets")


def counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = df.select(key, F.regexp_extract_all(text, F.lit(TAX_ID), F.lit(0)).alias("t"), F.regexp_extract_all(text, F.lit(CASE_NUMBER), F.lit(0)).alias("c"))
    return found.select(
        key, F.size("t").alias("tax_ids"), F.size(F.filter("t", tax_id_valid)).alias("valid_tax_ids"), F.size("c").alias("case_numbers"), F.size(F.filter("c", case_number_valid)).alias("valid_case_numbers")
    )
