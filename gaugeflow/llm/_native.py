"""Column helpers for the operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters and digits; all beyond ASCII belongs to words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def spaced_words(text: Column) -> Column:
    """The words of the text, each with one space before and after; a single space when there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), NOT_WORD, " ")


def utf8_bytes(text: Column) -> Column:
    """Bytes of the text in UTF-8, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
