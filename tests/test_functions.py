"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import amounts, dates, identifiers, strings


def apply(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in rows.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


CASES = {
    "cleaned": (amounts.cleaned, {
        None: "0.00", "": "0.00", "-": "0.00", "1500": "1500.00", "$25.00": "25.00", "(50)": "-50.00", "abc": "0.00", "1,234.5": "1234.50", "0.125": "0.12", "0.135": "0.14", "£ 7": "0.00", "'3'": "3.00", "1e2": "100.00", "inf": "0.00", "nan": "0.00",
        "123456789012345678901234567890123456789012345678": "123456789012345678901234567890123456789012345678.00",
    }),
    "parsed": (lambda c: amounts.parsed(c).cast("decimal(18,2)").cast("string"), {None: None, "": None, "-": None, "x": None, "(5)": "-5.00", "$1,000": "1000.00"}),
    "is_decimal": (amounts.is_decimal, {"": False, "1": True, "1.": True, ".5": True, "-1.5": True, "(1)": True, "inf": False, "NaN": False, "1e309": False, "1e308": True, "9" * 48: True, "x": False, "$1,000.00": True, "-": False}),
    "is_integer": (amounts.is_integer, {"1": True, "1.0": False, " 7 ": True, "1,000": True, "": False, "-3": True, "x": False}),
    "iso_date": (dates.iso_date, {
        "2024-01-15": "2024-01-15", "01/16/2024": "2024-01-16", "16/01/2024": "2024-01-16", "2024/1/9": "2024-01-09", "2024.01.15": "2024-01-15", "15-01-2024": "2024-01-15", "01-22-2024": "2024-01-22", "03-04-2024": "2024-04-03", "03/04/2024": "2024-03-04", "15.01.2024": "2024-01-15",
        "Jan 18 2024": "2024-01-18", "JANUARY 18 2024": "2024-01-18", "15 Jan 2024": "2024-01-15", "15 January 2024": "2024-01-15", "2024-Jan-15": "2024-01-15", "15-Jan-2024": "2024-01-15", "01/16/24": "2024-01-16", "16/01/24": "2024-01-16", "5/6/99": "1999-05-06", "5/6/68": "2068-05-06",
        "21st Feb 2024": "2024-02-21", "Jan 26, 2024": "2024-01-26", "2024-02-30": None, "not-a-date": None, "NULL": None, "N/A": None, "": None, None: None, "2024-13-01": None, "2024-01-15 10:30:00": "2024-01-15", "2024-01-15T10:30:00Z": "2024-01-15",
    }),
    "transaction_id": (identifiers.transaction_id, {
        "TXN001": "TXN-001", "txn_7": "TXN-007", " TXN 42 ": "TXN-042", "9": "TXN-009", "TXN-0008": "TXN-0008", "12345": "TXN-12345", "TXN-024A": "TXN-024", "duplicate": "duplicate", "n/a": "n/a", "ABC": "ABC", "TXN": "TXN", None: None, "": "",
    }),
    "reference_number": (identifiers.reference_number, {"REF_1": "REF-1", "ref22": "REF-22", "REF 2024 005": "REF-2024-005", "PENDING": "PENDING", "inv_9": "INV-9", "REF--1": "REF-1", "REF": "REF", None: None}),
    "titled": (strings.titled, {"o'brien e-mail 3d": "O'Brien E-Mail 3D", "A/r": "A/R", "SALES team": "Sales Team", "été": "Été", "": "", None: None}),
    "squeezed": (strings.squeezed, {"  a \t b\n": "a b", "a b": "a b", "": "", None: None}),
    "without_symbols": (strings.without_symbols, {"Ø a μ∞ b!!": "a b", "plain": "plain"}),
    "small_words": (strings.small_words, {"Cost Of The Goods And A Half": "Cost of the Goods and a Half", "Of Mice": "Of Mice"}),
}


@pytest.mark.parametrize("name", CASES)
def test_function(spark, name):
    f, cases = CASES[name]
    assert dict(zip(cases, apply(spark, f, list(cases)))) == cases


HOSTILE = ["'; DROP TABLE t; --", "<script>alert(1)</script>", '{"a": "b', "=cmd|' /C calc'!A0", "../../etc/passwd", "x" * 1_000_000, "\x00", "́", "🙂", "\x1b[31m", "$1 \\1", "(?i)", "%s", "{0}"]


@pytest.mark.parametrize("name", CASES)
def test_hostile_values_neither_raise_nor_run(spark, name):
    assert len(apply(spark, CASES[name][0], HOSTILE)) == len(HOSTILE)
