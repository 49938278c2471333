"""Money as text with two decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwright.functions.strings import let, stripped

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _unwrapped(s: Column) -> Column:
    return F.when(s.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_extract(s, r"^\((.*)\)$", 1))).otherwise(s)


def bare(c: Column) -> Column:
    """Without quotes, currency signs and thousands separators; ``(x)`` is -x."""
    return let(F.translate(stripped(c), "\"'$£€,", ""), _unwrapped)


def parsed(c: Column) -> Column:
    """A decimal, or null for what is no number (null, empty, '-', words)."""
    return let(bare(c), lambda s: F.when(s.rlike(_NUMBER), s.try_cast("decimal(38,10)")))


def cleaned(c: Column) -> Column:
    """Two decimals, halves to even; null, empty, '-' and what is no number give
    ``0.00``.  Whole numbers beyond 28 digits keep all their digits."""

    def money(s: Column) -> Column:
        whole = F.when(s.rlike(r"^[+-]?\d{29,}$"), F.concat(F.regexp_replace(s, r"^\+", ""), F.lit(".00")))
        return F.coalesce(whole, F.when(s.rlike(_NUMBER), F.bround(s.try_cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string")), F.lit("0.00"))

    return let(bare(c), money)


def is_decimal(c: Column) -> Column:
    """Whether a text is a decimal: ``,``, ``$`` and ``"`` are left out, ``(x)`` is -x,
    size at most 1e308."""
    s = let(stripped(F.translate(c, ",$\"", "")), _unwrapped)
    return F.coalesce(let(s, lambda x: x.rlike(_NUMBER) & (F.abs(x.try_cast("double")) <= 1e308)), F.lit(False))


def is_integer(c: Column) -> Column:
    return F.coalesce(stripped(F.translate(c, ",$", "")).rlike(r"^[+-]?\d+(_\d+)*$"), F.lit(False))
