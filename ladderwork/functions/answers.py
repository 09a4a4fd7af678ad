"""Answers: extraction from texts, exact numbers, comparison."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound, normalize_numeric, normalize_whitespace, strip

# The three patterns.
ANSWER_TAG = r"(?isU)<answer>\s*(.*?)\s*</answer>"
REFERENCE = r"(?mdU)####\s*(.+?)\s*$"
NUMBER = r"(?U)([-+]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)%?)"

_PLAIN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)%?\z"
#: Digits that decimal arithmetic keeps.
_DIGITS = 28


def extract_reference(c: Column) -> Column:
    """What follows the first ####, on its line; null without one."""
    return F.when(c.rlike(REFERENCE), strip(F.regexp_extract(c, REFERENCE, 1)))


def extract_answer_tag(c: Column) -> Column:
    """Content of the first <answer> tag, '' if empty; null without one."""
    return F.when(F.contains(c, F.lit("<")) & c.rlike(ANSWER_TAG), strip(F.regexp_extract(c, ANSWER_TAG, 1)))


def extract_last_number(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(NUMBER), 1), F.lit(-1))


def parse_decimal(text: str | None) -> Decimal | None:
    """Exact value of a normalized number: decimals, a/b (rounded to 28 digits), a trailing % (likewise); else null."""
    if not text:
        return None
    percent, body = text.endswith("%"), text.removesuffix("%")
    try:
        if "/" in body:
            top, bottom = body.split("/", 1)
            ratio = Fraction(top) / Fraction(bottom)
            value = Decimal(ratio.numerator) / Decimal(ratio.denominator)
        else:
            value = Decimal(body)
        return value / 100 if percent else value
    except (InvalidOperation, ZeroDivisionError, ValueError, OverflowError):
        return None


def _key(value: Decimal | None) -> str | None:
    if value is None or value.is_nan():
        return None if value is None else "nan"
    sign, digits, exponent = value.as_tuple()
    if exponent == "F":
        return "-inf" if sign else "inf"
    text = "".join(map(str, digits)).lstrip("0")
    short = text.rstrip("0")
    return f"{'-' if sign else ''}{short}e{exponent + len(text) - len(short)}" if short else "0"


@lru_cache(maxsize=10_000)
def _text_key(text: str) -> str | None:
    """References come again with each of their predictions."""
    return _key(parse_decimal(text))


def _fixed(value: Decimal | None) -> str | None:
    if value is None:
        return None
    if not value.is_finite():
        return str(value)
    value = value.normalize()
    # Numbers of thousands of digits stay in scientific notation.
    return format(value, "f") if abs(value.as_tuple().exponent) < 5000 else str(value)


@F.pandas_udf(T.StringType())
def _slow_key(text: pd.Series) -> pd.Series:
    return text.map(lambda x: _text_key(x) if isinstance(x, str) else None)


@F.pandas_udf(T.StringType())
def _slow_fixed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: _fixed(parse_decimal(x)) if isinstance(x, str) else None)


def _plain(normalized: Column) -> Column:
    """Decimals in ASCII digits, few enough that nothing is rounded."""
    return normalized.rlike(_PLAIN) & (F.length(normalized) <= _DIGITS)


def _parts(normalized: Column) -> tuple[Column, Column, Column, Column]:
    """(minus sign or '', whole digits, decimal digits, 2 for a percentage else 0)."""
    sign = F.when(F.startswith(normalized, F.lit("-")), "-").otherwise("")
    return sign, F.regexp_extract(normalized, r"^[+-]?([0-9]*)", 1), F.regexp_extract(normalized, r"\.([0-9]*)", 1), F.when(F.endswith(normalized, F.lit("%")), 2).otherwise(0)


def numeric_key(c: Column) -> Column:
    """A string that is equal for equal numbers ('nan' equals nothing); null for no number."""
    return normalized_key(normalize_numeric(c))


def normalized_key(text: Column) -> Column:
    """As numeric_key, of a normalized text. Plain decimals stay in built-in functions; the rest goes to a vectorized helper,
    which gets null for plain ones."""
    return F.coalesce(plain_key(text), other_key(F.when(~_plain(text), text)))


def plain_key(text: Column) -> Column:
    """normalized_key of plain decimals; null for others. Signs, zeros and points are trimmed, which costs less than patterns."""
    point, percent = F.instr(text, "."), F.endswith(text, F.lit("%"))
    begun = F.ltrim(text, F.lit("+-0."))
    digits, short = (F.replace(F.rtrim(begun, F.lit(end)), F.lit("."), F.lit("")) for end in ("%", "%0."))
    decimals = F.when(point > 0, F.length(text) - point - F.when(percent, 1).otherwise(0)).otherwise(0)
    exponent = F.length(digits) - F.length(short) - decimals - F.when(percent, 2).otherwise(0)
    value = F.when(short == "", "0").otherwise(F.concat(F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), short, F.lit("e"), exponent.cast("string")))
    return F.when(_plain(text), value)


def other_key(text: Column) -> Column:
    """normalized_key of any number, by the vectorized helper."""
    return _slow_key(text)


def canonical_decimal(c: Column) -> Column:
    """The number in fixed notation without trailing zeros, of at most 28 digits; -0 keeps its sign; null for no number."""
    text = normalize_numeric(c)
    plain = _plain(text) & ~F.endswith(text, F.lit("%"))
    sign, whole, decimals, _ = _parts(text)
    whole, decimals = F.regexp_replace(whole, "^0+", ""), F.regexp_replace(decimals, "0+$", "")
    fast = F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.when(decimals == "", "").otherwise(F.concat(F.lit("."), decimals)))
    return F.coalesce(F.when(plain, fast), _slow_fixed(F.when(~plain, text)))


def parse_numeric(c: Column) -> Column:
    """The number as a double."""
    return canonical_decimal(c).try_cast("double")


def select_answer(prediction: Column, strict: bool = True) -> Column:
    """struct(answer, mode): the answer tag; in lenient mode else the last number."""
    answer = lambda c, mode, none: F.struct(c.alias("answer"), F.when(c.isNotNull(), mode).otherwise(none).alias("mode"))
    if strict:
        return bound(extract_answer_tag(prediction), lambda tag: answer(tag, "tag", "missing_answer_tag"))
    number = bound(extract_last_number(prediction), lambda n: answer(n, "fallback_last_number", "missing_prediction_answer"))
    return bound(extract_answer_tag(prediction), lambda tag: F.when(tag.isNotNull(), answer(tag, "tag", "")).otherwise(number))


def reference_answer(reference: Column) -> Column:
    """What follows ####, or else the whole text."""
    return F.coalesce(extract_reference(reference), normalize_whitespace(reference))

