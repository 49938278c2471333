"""Identifiers: transaction ids, reference numbers, row ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwright.functions.strings import let, stripped

# Texts that stand for no identifier.
SENTINELS = ("DUPLICATE", "INVALID", "N/A", "NULL", "NA")


def transaction_id(c: Column) -> Column:
    """``TXN-`` and the first run of digits, three at least; what has no such
    form, and the sentinels, stay as they are."""

    def digits(s: Column) -> Column:
        number = F.when(s.isin(*SENTINELS), "").when(s.rlike("^TXN[-_]"), F.substring(s, F.lit(5), F.length(s))).when(s.startswith("TXN"), F.substring(s, F.lit(4), F.length(s))).when(s.rlike(r"^\d"), s)
        return F.regexp_extract(number, r"(\d+)", 1)

    padded = lambda d: F.when(d != "", F.concat(F.lit("TXN-"), F.lpad(d, F.greatest(F.lit(3), F.length(d)), F.lit("0"))))
    s = F.replace(F.upper(stripped(c)), F.lit(" "), F.lit(""))
    return F.coalesce(let(let(s, digits), padded), c)


def is_transaction_id(c: Column) -> Column:
    return F.coalesce(F.upper(stripped(c)).rlike(r"^TXN-\d+$"), F.lit(False))


def reference_number(c: Column) -> Column:
    """Upper case, single hyphens, one after a leading REF; only for what looks
    like a reference."""
    s = F.regexp_replace(F.translate(F.upper(stripped(c)), "_ ", "--"), "-+", "-")
    s = let(s, lambda x: F.when(x.rlike("^REF[^-]"), F.concat(F.lit("REF-"), F.substring(x, F.lit(4), F.length(x)))).otherwise(x))
    return F.when(F.lower(c).contains("ref") | c.rlike(r"(?i)^[A-Z0-9]+[-_]?\d+$"), s).otherwise(c)


def row_uuid(columns: list[Column]) -> Column:
    """A content hash in the form of a UUID; nulls print as ``nan``.  Equal rows
    have equal ids, so joins go by row_number."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns]), 256)
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")
