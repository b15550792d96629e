"""Text, number and date coercion as Column expressions.

Whitespace follows Python's definition (Unicode spaces plus U+001C-U+001F), so neither plain ``\\s`` nor
a one-argument ``trim`` will do.  Regular expressions are kept for values that need one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character str.strip() removes, and the same as a character class.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ODD_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBER = "decimal(38,19)"
NUMBER_FORM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
# A place between a letter, digit or underscore of any script and something else.
WORD_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def known(text: Column) -> Column:
    """Missing text reads as the word ``nan`` so that no rule ever meets a NULL."""
    return F.coalesce(text, F.lit("nan"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse_spaces(text: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    untidy = text.contains("  ") | text.rlike(f"[{ODD_SPACE}]")
    return F.trim(F.when(untidy, F.regexp_replace(text, f"[ {ODD_SPACE}]+", " ")).otherwise(text))


def strip_markup(text: Column, tag: str) -> Column:
    return F.when(text.contains("<"), F.regexp_replace(text, rf"</?{tag}[^>]*>", "")).otherwise(text)


def has_ink(text: Column) -> Column:
    """True for text with at least one non-space character."""
    return text.isNotNull() & (F.ltrim(text, F.lit(SPACES)) != "")


def alternation(words: Iterable[str]) -> str:
    """One pattern that finds any of the words."""
    return "|".join(map(re.escape, words))


def mentions(text: Column, words: Iterable[str], ignore_case: bool = False) -> Column:
    return matches(text, alternation(words), ignore_case)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a pattern occurs in the text; its ``\\b`` sees letters, digits and underscores of every script as parts of words."""
    return text.rlike(("(?iu)" if ignore_case else "") + pattern.replace(r"\b", WORD_EDGE))


def to_number(text: Column) -> Column:
    """DOUBLE of a plain decimal number ("2.7", "1e3", " 12 "), NULL for anything else.

    Decimal parsing takes exactly the plain forms, unlike a cast to double, which also reads "1d" and "NaN".  A number beyond its range
    is read as a double once its form is checked, so no size is refused.
    """
    large = F.when(text.rlike(NUMBER_FORM), text.try_cast("double"))
    return F.coalesce(text.try_cast(NUMBER).cast("double"), large)


def to_count(text: Column) -> Column:
    """BIGINT truncated toward zero; unreadable values, and those that no BIGINT holds, are 0."""
    return F.coalesce(text.try_cast(NUMBER).try_cast("bigint"), F.lit(0).cast("bigint"))


def to_amount(text: Column) -> Column:
    """DOUBLE after dropping thousands commas; unreadable values are 0."""
    return F.coalesce(to_number(F.replace(text, F.lit(","), F.lit(""))), F.lit(0.0))


def to_moment(text: Column, forms: Sequence[str] = ()) -> Column:
    """TIMESTAMP_NTZ from year-month-day text with ``-`` or ``/``, with or without a time; else NULL.

    ``forms`` are further date patterns ("M/d/yyyy", "yyyyMMdd"), tried in their order where the first reading fails."""
    usual = F.replace(text, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz")
    if not forms:
        return usual
    return F.coalesce(usual, *[F.try_to_date(text, form).cast("timestamp_ntz") for form in forms])


def moment(value) -> Column:
    """Literal TIMESTAMP_NTZ at midnight of a date (constant-folded, so filters can be pushed down)."""
    return F.lit(str(value)).cast("timestamp_ntz")


def whole(number: Column) -> Column:
    """``1234567.5`` -> ``1,234,568``: thousands separators, half-even."""
    return F.format_number(number, 0)


def one_decimal(number: Column) -> Column:
    """``1234.56`` -> ``1234.6``: one decimal, no separators, half-even."""
    return F.replace(F.format_number(number, 1), F.lit(","), F.lit(""))
