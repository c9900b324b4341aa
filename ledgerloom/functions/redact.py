"""Personal data in master records and free text, shortened to what a reader needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of account numbers, mail addresses and phone numbers.
IBAN_DE = r"\bDE\d{20}\b"
IBAN_OTHER = r"\b(?:[A-Z]{2}\d{2})[A-Z0-9]{11,30}\b"
# The same matches, with their last four characters as a group.
IBAN_DE_LAST4 = r"\bDE\d{16}(\d{4})\b"
IBAN_OTHER_LAST4 = r"\b[A-Z]{2}\d{2}[A-Z0-9]{7,26}([A-Z0-9]{4})\b"
EMAIL = r"\b([A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\+?\d[\d\s\-/]{7,}\d"
PHONE_START = r"(?U)\d[\d\s\-/]{7}"
EMAIL_DOMAIN = "@example.com"
MIN_PHONE_DIGITS = 8


def iban_last4(col: Column) -> Column:
    """``****`` and the last four characters, upper case without spaces; null for null or empty."""
    bare = F.upper(F.regexp_replace(col, r"\s", ""))
    return F.when(F.length(bare) >= 4, F.concat(F.lit("****"), F.right(bare, F.lit(4)))).when(F.length(bare) > 0, F.lit("****"))


def phone_last4(col: Column) -> Column:
    """The last four digits, behind up to three digits of the country code where the number starts with a plus."""
    digits = F.regexp_replace(col, r"\D", "")
    head = F.regexp_replace(F.regexp_extract(col, r"^\s*\++(\S*)", 1), r"\D", "")
    code = F.coalesce(F.nullif(F.substring(head, 1, 3), F.lit("")), F.lit("??"))
    tail = F.concat(F.lit("*** **"), F.right(digits, F.lit(4)))
    return (
        F.when(F.length(col) == 0, F.lit(None).cast("string"))
        .when(F.length(digits) < 4, F.lit("****"))
        .when(F.ltrim(col).startswith("+"), F.concat(F.lit("+"), code, F.lit(" "), tail))
        .otherwise(tail)
    )


def email_redact(col: Column, keep_local_part: bool = True) -> Column:
    """The address with a neutral domain; what isn't an address stays as it is."""
    new = F.concat(F.substring_index(col, "@", 1) if keep_local_part else F.lit("redacted"), F.lit(EMAIL_DOMAIN))
    return F.when(col.rlike(f"^{EMAIL}$"), new).otherwise(col)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def _replaced(col: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """``col`` with ``new(match)`` in place of each match of the pattern."""
    parts = F.zip_with(
        F.split(col, pattern, -1), F.regexp_extract_all(col, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.concat(gap, F.when(hit.isNull(), "").otherwise(new(hit))),
    )
    return F.array_join(parts, "")


def _short_phone(hit: Column) -> Column:
    digits = F.regexp_replace(hit, r"(?U)\D", "")
    head = F.regexp_replace(F.regexp_extract(hit, r"(?U)^\+*\s*(\S+)", 1), r"(?U)\D", "")
    code = F.when(hit.startswith("+"), F.concat(F.lit("+"), F.left(head, F.lit(3)), F.lit(" "))).otherwise("")
    return F.when(F.length(digits) < MIN_PHONE_DIGITS, hit).otherwise(F.concat(code, F.lit("*** **"), F.right(digits, F.lit(4))))


def scrub_mail_and_iban(col: Column) -> Column:
    """Account numbers and mail addresses in free text, in that order."""
    for pattern in (IBAN_DE_LAST4, IBAN_OTHER_LAST4):
        col = F.regexp_replace(col, pattern, "****$1")
    return _let(col, lambda c: F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL, "$1" + EMAIL_DOMAIN)).otherwise(c))


def scrub_text(col: Column) -> Column:
    """Account numbers, mail addresses, then phone numbers of eight digits or more; a second pass changes nothing."""
    return _let(scrub_mail_and_iban(col), lambda c: F.when(c.rlike(PHONE_START), _replaced(c, "(?U)" + PHONE, _short_phone)).otherwise(c))


def assert_no_iban(col: Column) -> Column:
    """``col``, or an error if it still holds a whole account number."""
    return F.when(F.assert_true(~F.coalesce(col.rlike(IBAN_DE), F.lit(False)), "an account number is left").isNull(), col)
