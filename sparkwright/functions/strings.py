"""Text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"(?U)\s+"
# Fixed value: the characters that this pattern means.
_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.  An expression that uses a
    part of itself many times would otherwise hold as many copies of it, and
    the generated code of a chain of rules would pass the size of a method."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeezed(c: Column) -> Column:
    """No white space at the ends, one blank for each run of it inside."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def stripped(c: Column) -> Column:
    """No white space at the ends; a pattern would be tried at every character."""
    return F.trim(c, F.lit(_SPACE))


def titled(c: Column) -> Column:
    """Upper case after every character that is no letter, lower case elsewhere."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")


def without_symbols(c: Column) -> Column:
    # Fixed value: the symbols that are deleted.
    return squeezed(F.regexp_replace(c, "[μ∞Ø!]+", ""))


def small_words(c: Column) -> Column:
    # Words in lower case between blanks.
    for word in ("Of", "And", "The", "A", "An"):
        c = F.replace(c, F.lit(f" {word} "), F.lit(f" {word.lower()} "))
    return c


def looked_up(c: Column, table: dict[str, str]) -> Column:
    """The table's value for ``c``, else null; a literal map of bounded size."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)
