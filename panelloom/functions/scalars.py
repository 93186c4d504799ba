"""Scalar column expressions whose missing-value rules follow NA, not SQL defaults."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Portuguese month abbreviations, January to December.
MONTHS_PT = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def divide(numerator: Column | str, denominator: Column | str) -> Column:
    """IEEE division: x/0 is +-Inf, 0/0 is NaN, a missing operand gives NULL.

    Spark's ``/`` raises on a zero divisor and ``try_divide`` returns NULL, so
    the zero cases are spelled out. ``-0.0`` equals ``0.0`` in SQL; its sign is
    recovered from the text form, which is only evaluated for zero divisors.
    """
    n = _col(numerator).cast("double")
    d = _col(denominator).cast("double")
    negative = (n < 0) != d.cast("string").startswith("-")
    return (
        F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
        .when(d != 0, n / d)
        .when(F.isnan(n) | (n == 0), F.lit(float("nan")))
        .when(negative, F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )


# Text that the JVM reads as a number although no data file means one: 1d, 2.5F.
_SUFFIXED = "lower(right(trim({c}), 1)) IN ('d', 'f') AND lower(trim({c})) NOT LIKE '%inf'"
_NUMBER = "CASE WHEN " + _SUFFIXED + " THEN NULL ELSE try_cast({c} AS DOUBLE) END"


def number_columns(names: Iterable[str]) -> list[Column]:
    """``to_number`` on many text columns, one parsed expression each (wide tables have hundreds)."""
    return [F.expr(_NUMBER.format(c=f"`{n}`")).alias(n) for n in names]


def to_number(c: Column | str) -> Column:
    """Text to double; anything unreadable becomes NULL instead of an error."""
    text = F.trim(_col(c).cast("string"))
    suffixed = F.lower(F.right(text, F.lit(1))).isin("d", "f") & ~F.lower(text).endswith("inf")
    return F.when(~suffixed, text.try_cast("double"))


def european_number(c: Column | str) -> Column:
    """``1.234,5`` style text to double: dots group digits, the comma is the decimal mark."""
    text = _col(c).cast("string")
    return to_number(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def extract_first(c: Column | str, pattern: str) -> Column:
    """First regex match, NULL when there is none."""
    return F.regexp_substr(_col(c), F.lit(pattern))


def remove_first(c: Column | str, literal: str) -> Column:
    """Drop the first occurrence of a literal substring."""
    text = _col(c)
    at = F.instr(text, literal)
    cut = F.concat(
        F.substring(text, F.lit(1), at - 1),
        F.substring(text, at + len(literal), F.length(text)),
    )
    return F.when(at > 0, cut).otherwise(text)


def code_prefix(c: Column | str, digits: int = 6) -> Column:
    """Keep the leading digits of a place code (7-digit codes carry a check digit)."""
    return to_number(F.substring(_col(c).cast("string"), 1, digits)).cast("bigint")


def month_number(c: Column | str, names: Sequence[str] = MONTHS_PT) -> Column:
    """Month abbreviation to 1..12; an unknown name gives NULL."""
    position = F.array_position(F.array(*[F.lit(n) for n in names]), _col(c))
    return F.when(position > 0, position.cast("int"))


def threshold_flag(c: Column | str, threshold: float) -> Column:
    """1 above the threshold, otherwise 0; a missing value counts as 0."""
    return F.when(_col(c) > threshold, 1).otherwise(0)


def label(c: Column | str, labels: Mapping[int, str]) -> Column:
    """Text label for each listed value; values not listed give NULL."""
    out = None
    for value, text in labels.items():
        hit = _col(c) == value
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def month_start(year: Column | str, month: Column | str) -> Column:
    """First day of a month as a date; a missing part or a month outside 1..12 gives NULL."""
    y, m = _col(year).cast("int"), _col(month).cast("int")
    return F.when(m.between(1, 12), F.make_date(y, m, F.lit(1)))
