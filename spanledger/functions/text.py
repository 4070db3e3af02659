"""Text and key folding as Column expressions.

Compatibility normalisation and full case folding come from the ICU classes
that Spark ships, called through the ``reflect`` SQL function and only on rows
that hold a non-ASCII character, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _nfkc(c: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def casefold(c: Column) -> Column:
    """NFKC plus full case folding."""
    folded = F.reflect(
        F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(c), F.lit(True)
    )
    return F.when(is_ascii(c), F.lower(c)).when(c.isNotNull(), folded)


#: Blank runs other than one plain space; single spaces need no replacement.
_BLANKS = r"[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"


def fold_text(c: Column) -> Column:
    """Case-folded text with every run of blanks turned into one space."""
    plain = F.regexp_replace(F.lower(c), _BLANKS, " ")
    folded = F.regexp_replace(casefold(c), "(?U)" + _BLANKS, " ")
    return F.trim(F.when(is_ascii(c), plain).when(c.isNotNull(), folded))


def fold_key(c: Column) -> Column:
    """Key reduced to ``[a-z0-9]``."""
    return F.regexp_replace(casefold(c), "[^a-z0-9]+", "")


def compact(c: Column) -> Column:
    """Already folded text reduced to ``[a-z0-9]``."""
    return F.regexp_replace(c, "[^a-z0-9]+", "")


def dash_token(c: Column) -> Column:
    """``Human Reviewer`` -> ``human-reviewer``; blank becomes the empty string."""
    folded = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-")
    return F.regexp_replace(folded, "^-+|-+$", "")


def feature_token(c: Column) -> Column:
    """Characteristic text as a kebab-case token; ``&`` reads as ``and``."""
    text = F.replace(F.trim(casefold(c)), F.lit("&"), F.lit(" and "))
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))


def clean_text(c: Column, limit: int | None = None) -> Column:
    """Printable, single-spaced text; with ``limit`` cut to so many characters, for print."""
    normal = F.when(is_ascii(c), c).when(c.isNotNull(), _nfkc(c))
    text = F.trim(F.regexp_replace(normal, r"[\p{C}\p{Z}\s]+", " "))
    if limit is None:
        return text
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def blank_to_underscore(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def word_match(c: Column, pattern: str) -> Column:
    """``rlike`` whose word boundaries are Unicode-aware on non-ASCII rows only."""
    return F.when(is_ascii(c), c.rlike(pattern)).otherwise(c.rlike("(?U)" + pattern))


def article_number(c: Column, *, bare: bool = False) -> Column:
    """``EU AI Act Art. 12`` -> 12. ``bare`` also accepts a lone number."""
    text = F.trim(casefold(c))
    named = F.regexp_extract(text, r"\b(?:article|art\.?)\s*\(?\s*(\d{1,3})\s*\)?", 1)
    alone = F.regexp_extract(text, r"^\(?\s*(\d{1,3})\s*\)?$", 1)
    found = F.when(named != "", named)
    if bare:
        found = F.when(named != "", named).when(alone != "", alone)
    number = found.cast("int")
    return F.when(number > 0, number)


def looks_like_article(c: Column) -> Column:
    return F.lower(c).rlike(
        r"^(?:eu\s+ai\s+act\s+)?(?:article|art\.?)\s*\(?\s*\d{1,3}[a-z]?(?:\([^)]*\))?\)?$"
    )


def annex_number(c: Column) -> Column:
    """``Annex IV, point 2.1`` -> 2."""
    text = F.trim(F.regexp_replace(F.replace(casefold(c), F.lit("paragraph"), F.lit("point")), r"\s+", " "))
    number = F.regexp_extract(
        text,
        r"^(?:annex\s*)?(?:iv|4)\s*(?:[.,:]\s*)?(?:(?:point|section|no\.?|number)\s*)?"
        r"\(?\s*(\d{1,2})(?:\.\d+)?\s*\)?$",
        1,
    )
    value = F.when(number != "", number).cast("int")
    return F.when(value > 0, value)


def designation(c: Column) -> Column:
    """Designation with single blanks and none around ``/``, ``:`` and ``-``."""
    tight = F.regexp_replace(F.trim(c), r"\s*([/:-])\s*", "$1")
    return F.regexp_replace(tight, r"\s+", " ")


def parse_flag(text: Column) -> Column:
    """Words, 0/1 and booleans as text to a boolean; anything else is null."""
    from spanledger.functions.rules import FALSE_WORDS, TRUE_WORDS

    word = blank_to_underscore(text)
    return (
        F.when(word.isin(*TRUE_WORDS), F.lit(True))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )
