"""Column expressions over cell text: trimming, missing tokens, the number grammar, tolerance, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t"

#: Upper-cased tokens that mean "no value".
MISSING = ("", "-", "NA", "N/A", "NULL", "NAN", "NONE")

#: The number grammar, on trimmed text.
MANTISSA = r"(?:(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]*)?|\.[0-9]+)"
BODY = rf"(?:[+-]?\$?|\$[+-]){MANTISSA}(?:[eE][+-]?[0-9]+)?"
NUMBER = rf"^(?:\({BODY}\)|{BODY})$"


def trim(c: Column) -> Column:
    """Without leading and trailing spaces and tabs; nothing else counts as white space."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def is_missing(c: Column) -> Column:
    return F.upper(trim(c)).isin(*MISSING)


def parse_numeric(c: Column) -> Column:
    """The finite double that the text stands for, else null.

    Text of digits, points and minus signs only needs no grammar: the cast accepts the
    same strings. Anything else passes the grammar first, as the cast alone takes too much.
    """
    t = trim(c)
    plain = F.translate(t, "0123456789.-", "") == ""
    amount = F.translate(t, "$,()+", "").try_cast("double")
    signed = F.when(F.startswith(t, F.lit("(")), -F.abs(amount)).otherwise(amount)
    value = F.when(plain, t.try_cast("double")).when(t.rlike(NUMBER), signed)
    return F.when(F.abs(value) < float("inf"), value)


def contribution(delta: Column, tolerance: float) -> Column:
    """The change's size, or zero within the tolerance (its bound included)."""
    return F.when(F.abs(delta) <= F.lit(float(tolerance)), F.lit(0.0)).otherwise(F.abs(delta))


def identifier(c: Column) -> Column:
    """``u8:`` and the text, or ``hex:`` and its bytes where it has control characters."""
    return F.when(c.rlike(r"[\x00-\x1f\x7f]"), F.concat(F.lit("hex:"), F.lower(F.hex(c.cast("binary"))))).otherwise(F.concat(F.lit("u8:"), c))
