"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words and are stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
#: A word, as a regular expression of Java and of Python.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """Words of a text; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_fraction(key: Column, digits: int = 13) -> Column:
    """Uniform double inside (0, 1) from the first hex digits of the MD5 of a key."""
    return (hash_bits(key, digits) + F.lit(0.5)) / F.lit(float(16**digits))


def hash_bits(key: Column, digits: int = 15) -> Column:
    """Non-negative long from the first hex digits of the MD5 of a key."""
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("long")


def key_text(column: Column) -> Column:
    """The text under which a record key is hashed; null has one of its own."""
    return F.coalesce(column.cast("string"), F.lit("\x00null"))


def pack_row(docs: DataFrame, name: str = "__row") -> Column:
    """All columns of a table as one struct, so helper columns cannot clash."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(name)


def unpack_row(df: DataFrame, columns: list[str], name: str = "__row") -> DataFrame:
    return df.select(*(F.col(name).getField(c).alias(c) for c in columns))
