"""Column expressions on text that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: ASCII white space, \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; the faster built-in where the text is all ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def space_words(c: Column) -> Column:
    """The words between runs of ASCII white space; none for null and blank texts."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_RUN), "")


def upto(n: Column) -> Column:
    """0, 1, ... n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def settled(c: Column) -> Column:
    """c, computed once, where it is: the (always true) random condition keeps the optimizer from copying c into later filters and lambdas, where it would run for every element."""
    return F.when(F.rand(0) >= 0, c)
