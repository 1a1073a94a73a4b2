"""Scalar functions: byte lengths, ASCII case folding, zero-safe modulo."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def ascii_upper(c: Column) -> Column:
    """Upper-case a-z only; other letters stay."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ascii_fold(text: str) -> str:
    """`ascii_lower` of a Python value."""
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def concat2(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def mod_or_zero(c: Column, k: Column | int) -> Column:
    """c mod k, and 0 where k is 0."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(k == 0, 0).otherwise(c % F.nullif(k, F.lit(0))).cast("long")


def int_avg(c: Column) -> Column:
    """Average in whole numbers, rounded towards zero; null over no rows."""
    return F.call_function("div", F.sum(c), F.nullif(F.count(c), F.lit(0)))
