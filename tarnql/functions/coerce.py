"""Text to numbers, and literals to the type of a column."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Kind

# The number grammar. Spark's own casts also take blanks around a number, and a trailing d or f.
INT = r"\A[+-]?[0-9]+\z"
SPECIAL = r"\A[+-]?(?i:inf(?:inity)?)\z|\A(?i:nan)\z"
DECIMAL = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
HEXADECIMAL = r"\A[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+\z"


def _python(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z"))


_INT, _SPECIAL, _DECIMAL, _HEXADECIMAL = map(_python, (INT, SPECIAL, DECIMAL, HEXADECIMAL))


def infer(cell: str) -> Kind:
    """The kind of a first-row cell: Int if it is an int64, else Float if it is a finite or named float, else String."""
    if _INT.match(cell) and -(2**63) <= int(cell) < 2**63:
        return Kind.INT
    if _SPECIAL.match(cell):
        return Kind.FLOAT
    try:
        if (_DECIMAL.match(cell) and math.isfinite(float(cell))) or (_HEXADECIMAL.match(cell) and math.isfinite(float.fromhex(cell))):
            return Kind.FLOAT
    except OverflowError:
        pass
    return Kind.STRING


def is_int(text: Column) -> Column:
    """Whether a cell is an int64; false for null."""
    return F.coalesce(text.rlike(INT) & text.try_cast("bigint").isNotNull(), F.lit(False))


def to_int(text: Column) -> Column:
    """The cell as int64; 0 for whatever is none."""
    return F.coalesce(F.when(text.rlike(INT), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def to_float(text: Column) -> Column:
    """The cell as float64; 0 for whatever is none, and for finite numbers beyond the range."""
    number = F.when(text.rlike(f"{DECIMAL}|{HEXADECIMAL}"), text.try_cast("double"))
    finite = F.when(~number.isin(float("inf"), float("-inf")), number)
    bare = F.lower(F.regexp_replace(text, r"\A[+-]", ""))
    named = F.when(bare == "nan", float("nan")).when(text.startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.coalesce(F.when(text.rlike(SPECIAL), named).otherwise(finite), F.lit(0.0))


def to_text(text: Column) -> Column:
    """The cell as it stands; an empty cell is a value, never null."""
    return F.coalesce(text, F.lit(""))


def number_text(value: int | float) -> str:
    """A numeric literal as text: integers in decimal, floats in the shortest form, with an exponent below 1e-4 and from 1e6 up."""
    if isinstance(value, int):
        return str(value)
    if not math.isfinite(value):
        return "NaN" if math.isnan(value) else ("+Inf" if value > 0 else "-Inf")
    if value == 0:
        return "-0" if math.copysign(1, value) < 0 else "0"
    mantissa, _, power = f"{value!r}".partition("e") if "e" in repr(value) else (repr(value), "", "0")
    sign, digits = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, part = digits.partition(".")
    exponent = int(power) + len(whole) - 1
    figures = whole + part
    lead = len(figures) - len(figures.lstrip("0"))
    figures, exponent = figures.lstrip("0").rstrip("0"), exponent - lead
    if exponent < -4 or exponent >= 6:
        rest = f".{figures[1:]}" if len(figures) > 1 else ""
        return f"{sign}{figures[0]}{rest}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{figures}"
    figures = figures.ljust(exponent + 1, "0")
    rest = f".{figures[exponent + 1 :]}" if len(figures) > exponent + 1 else ""
    return f"{sign}{figures[: exponent + 1]}{rest}"
