"""Predicates as Column expressions: LIKE without escapes, the textual null test, token search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import ascii_fold, ascii_lower

#: Texts that count as null, and the characters that end a token.
NULL_TEXTS = ("", "NULL", "null")
TOKEN_BREAKS = " \t\n\r@.,;:_-"


def like(c: Column, pattern: str, fold: bool = False) -> Column:
    """LIKE in which % and _ are the only special characters: a backslash matches itself. `fold` ignores the case of A-Z."""
    free = next(x for x in map(chr, range(0xE000, 0xF900)) if x not in pattern)  # an escape that the pattern lacks
    return F.like(ascii_lower(c), F.lit(ascii_fold(pattern)), F.lit(free)) if fold else F.like(c, F.lit(pattern), F.lit(free))


def is_null_text(c: Column) -> Column:
    return c.isNull() | c.isin(*NULL_TEXTS)


def matches_token(c: Column, word: str) -> Column:
    """Some token of the text contains `word`, ignoring the case of A-Z.

    Tokens are what stands between breaks, so a word without breaks is in a token where it is in the text at all.
    """
    if any(x in TOKEN_BREAKS for x in word):
        return F.when(c.isNotNull(), False)
    return F.contains(ascii_lower(c), F.lit(ascii_fold(word)))


def any_column_matches(df: DataFrame, word: str) -> Column:
    """Token search over all text columns."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return any_of(*[F.coalesce(matches_token(F.col(f"`{c}`"), word), F.lit(False)) for c in texts]) if texts else F.lit(False)


def all_of(*terms: Column) -> Column:
    return reduce(lambda a, b: a & b, terms)


def any_of(*terms: Column) -> Column:
    return reduce(lambda a, b: a | b, terms)


def fits_bytes(c: Column, capacity: int) -> Column:
    """The value fits VARCHAR(capacity), which counts bytes."""
    return F.octet_length(c) <= capacity
