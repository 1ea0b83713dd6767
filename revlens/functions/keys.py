"""Key coercion (F2): text -> exact number with failures as NULL, like a lenient
numeric conversion; numeric columns pass through unchanged."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Type of a key read from text: 20 whole digits hold every 64-bit id, and no two ids merge as
# they would in DOUBLE above 2^53.
KEY_TYPE = "decimal(28,8)"
# Decimal numbers only: hex, type suffixes ("1d") and infinities are no keys.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` names it: an
    expression given to several places is else copied into each of them, by
    every projection and pushed filter that it passes."""
    return F.element_at(F.transform(F.array(x), f), 1)


def coerce_numeric_key(df: DataFrame, name: str) -> Column:
    """Expression for column ``name`` coerced to a number (NULL on failure,
    NaN -> NULL).  Text becomes ``KEY_TYPE``; a number that it cannot hold
    exactly (more than 20 whole or 8 fractional digits) fails the job, as
    rounding could merge two customers."""
    field = df.schema[name]
    c = F.col(name)
    if isinstance(field.dataType, NumericType):
        return F.when(~F.isnan(c.cast("double")), c) if _is_fractional(field.dataType) else c
    return bound(F.trim(c.cast("string")), lambda t: F.when(is_number(t), exact_decimal(t, KEY_TYPE, f"key {name}")))


def is_number(text: Column) -> Column:
    return text.rlike(_NUMBER)


def exact_decimal(text: Column, target: str, what: str) -> Column:
    """``text`` as ``target`` decimal; a value that is no number, or that the
    type cannot hold exactly, raises an error naming it."""
    error = F.lit(f"{what} does not fit {target}: ")
    # Plain numbers of few digits are the common case and need no test.
    return bound(text, lambda t: F.when(t.rlike(plain_number(target)), t.cast(target)).when(
        t.isNotNull(), bound(t.try_cast(target), lambda value: F.when(
            inexact(t, value), F.raise_error(F.concat(error, t)).cast(target)).otherwise(value))))


def plain_number(target: str) -> str:
    """Pattern of the numbers without exponent that ``target`` holds exactly."""
    precision, scale = map(int, re.findall(r"\d+", target))
    return rf"^[+-]?[0-9]{{1,{precision - scale}}}(\.[0-9]{{1,{scale}}})?$"


def inexact(text: Column, value: Column) -> Column:
    """Whether ``text`` is no number, or not exactly the decimal ``value``."""
    return text.isNotNull() & (value.isNull() | F.coalesce(text.try_cast("decimal(38,18)") != value, F.lit(False)))


def _is_fractional(dt) -> bool:
    return dt.typeName() in ("double", "float")
