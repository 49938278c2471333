"""Checks.  Each is a named predicate; all fold into one array of errors per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.contract import BOOLEAN, DATE, DECIMAL, INTEGER, TableContract
from sparkwright.functions import amounts, dates, identifiers
from sparkwright.functions.memo import remembered
from sparkwright.functions.strings import stripped
from sparkwright.sources.scratch import stored

ERRORS = "__errors"
ERROR = "array<struct<ord:int,column:string,value:string,error_type:string,message:string>>"
KEY = "Transaction ID"
#: Columns whose unknown values are mapped later, so they are no violation here.
MAPPED_LATER = ("Department", "Account Name")
#: Places of the checks across columns behind those of the columns.
XOR, FORMAT, MISSING, DUPLICATE, UNIQUE = 100_000, 100_001, 100_002, 100_003, 100_004

# Categories, and below the texts of the messages.
VALIDATION, PARSE, CONTRACT, CONFIDENCE, CAP = "validation_failure", "parse_error", "llm_contract_failure", "low_confidence", "edit_cap_exceeded"


def _error(order: int, column: str, value: Column, kind: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(order).alias("ord"), F.lit(column).alias("column"), value.cast("string").alias("value"), F.lit(kind).alias("error_type"), message.alias("message"))


def valid_type(c: Column, kind: str) -> Column:
    if kind == INTEGER:
        return amounts.is_integer(c)
    if kind == DECIMAL:
        return amounts.is_decimal(c)
    if kind == DATE:
        return F.coalesce(dates.is_date(c), F.lit(False))
    if kind == BOOLEAN:
        return F.lower(stripped(c)).isin("true", "false", "1", "0", "yes", "no", "y", "n")
    return F.lit(True)


def positive(c: Column) -> Column:
    return F.coalesce(amounts.parsed(c) > 0, F.lit(False))


@remembered
def cell_errors(names: tuple[str, ...], contract: TableContract, extra: bool, empty_is_null: bool) -> list[Column]:
    """Errors of single cells and of absent columns, in contract order.  ``extra``
    adds the checks of bounds, which are off by default."""
    out = []
    for k, spec in enumerate(contract.columns):
        if spec.name not in names:
            if spec.required:
                out.append(_error(k, spec.name, F.lit(None), "missing_column", f"Required column '{spec.name}' is missing"))
            continue
        c, at = F.col(f"`{spec.name}`"), 1000 + 10 * k
        empty = c.isNull() | (c == "")
        if spec.required:
            out.append(F.when(empty, _error(at, spec.name, c, "required_field", f"Required field '{spec.name}' is empty")))
        there = ~empty if spec.required or empty_is_null else c.isNotNull()
        told = lambda text: F.concat(F.lit("Value '"), c, F.lit(f"' {text}"))  # noqa: B023, E731
        out.append(F.when(there & ~valid_type(c, spec.type), _error(at + 1, spec.name, c, "type_mismatch", told(f"is not a valid {spec.type}"))))
        if spec.enum and spec.name not in MAPPED_LATER:
            out.append(F.when(there & ~c.isin(*spec.enum), _error(at + 2, spec.name, c, "enum_violation", told("not in allowed values"))))
        if spec.pattern:
            out.append(F.when(there & ~c.rlike(f"^(?:{spec.pattern})"), _error(at + 3, spec.name, c, "pattern_violation", told(f"doesn't match pattern {spec.pattern}"))))
        if spec.min_length:
            out.append(F.when(there & (F.length(c) < spec.min_length), _error(at + 4, spec.name, c, "length_violation", f"Value too short (min: {spec.min_length})")))
        if spec.max_length:
            out.append(F.when(there & (F.length(c) > spec.max_length), _error(at + 5, spec.name, c, "length_violation", f"Value too long (max: {spec.max_length})")))
        if extra and spec.min_value is not None:
            out.append(F.when(there & (amounts.parsed(c) < F.lit(spec.min_value).cast("decimal(38,10)")), _error(at + 6, spec.name, c, "range_violation", f"Value below {spec.min_value}")))
        if extra and spec.max_value is not None:
            out.append(F.when(there & (amounts.parsed(c) > F.lit(spec.max_value).cast("decimal(38,10)")), _error(at + 7, spec.name, c, "range_violation", f"Value above {spec.max_value}")))
    if contract.debit_xor_credit:
        debit = next((s.name for s in contract.columns if "debit" in s.name.lower()), None)
        credit = next((s.name for s in contract.columns if "credit" in s.name.lower()), None)
        if debit and credit:
            d, c = (F.col(f"`{n}`") if n in names else F.lit(None).cast("string") for n in (debit, credit))
            value = F.concat(F.lit("Debit="), F.coalesce(d, F.lit("nan")), F.lit(", Credit="), F.coalesce(c, F.lit("nan")))
            out.append(F.when(positive(d) == positive(c), _error(XOR, f"{debit}/{credit}", value, "debit_xor_credit", "Exactly one of Debit or Credit must be positive")))
    if KEY in names:
        c = F.col(f"`{KEY}`")
        bad = c.isNotNull() & ~identifiers.is_transaction_id(c)
        out.append(F.when(bad, _error(FORMAT, KEY, c, "transaction_id_format", F.concat(F.lit("Invalid Transaction ID format: '"), c, F.lit("'. Must be TXN-<digits>")))))
    return out


def key_counts(df: DataFrame) -> DataFrame:
    """(__key, __n): rows of each valid identifier; all others, counted in each
    task before the shuffle, are one row with an empty key."""
    key = F.col(f"`{KEY}`")
    named = F.coalesce(F.when(identifiers.is_transaction_id(key), key), F.lit(""))
    return df.groupBy(named.alias("__key")).agg(F.count(F.lit(1)).alias("__n"))


def key_facts(df: DataFrame) -> DataFrame:
    """(__key, __n) of repeated valid identifiers; a null key has the rows of those that
    occur once, an empty one the rows without any.  Stored, so that Spark knows its size,
    which is that of the repeated ones: a table of few of them is broadcast, and the
    checked rows are not shuffled.  From an aggregation alone it knows that of all."""
    shared = F.when((F.col("__n") > 1) | (F.col("__key") == ""), F.col("__key"))
    facts = key_counts(df).groupBy(shared.alias("__key")).agg(F.sum("__n").alias("__n"))
    return stored(facts, compression="none")  # the size of its files is about that in memory


def majority_of(counts: DataFrame) -> DataFrame:
    valid = F.sum(F.when(F.col("__key").isNull() | (F.col("__key") != ""), F.col("__n")).otherwise(0))
    return counts.agg((2 * F.coalesce(valid, F.lit(0)) > F.coalesce(F.sum("__n"), F.lit(0))).alias("__majority"))


def majority_has_keys(df: DataFrame) -> DataFrame:
    """One row: whether more than half of all rows have a valid identifier."""
    return majority_of(key_counts(df))


def duplicate_counts(df: DataFrame, *key: str) -> DataFrame:
    """Each key of more than one row, with the number ``n`` of its rows; counted in each
    task before the shuffle, so one key of very many rows is no burden."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def repeated_keys(df: DataFrame) -> DataFrame:
    """Valid identifiers of more than one row."""
    return key_counts(df).filter("__n > 1 and __key <> ''").select("__key")


def check(df: DataFrame, contract: TableContract, extra: bool = False, empty_is_null: bool = False) -> DataFrame:
    """``df`` with all errors of each row in ``__errors``, in the order of the checks.
    Identifiers are counted here and now, in a pass over their column."""
    cells = cell_errors(tuple(df.columns), contract, extra, empty_is_null)
    found = F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array()
    out = df.withColumn(ERRORS, found.cast(ERROR))
    if KEY in df.columns:
        key = F.col(f"`{KEY}`")
        valid = identifiers.is_transaction_id(key)
        facts = key_facts(df)
        most = majority_of(facts).first()[0]
        if most:  # else both checks are off
            often = facts.filter("__key <> ''").select("__key")
            own = F.coalesce(F.when(valid, key), F.concat(F.lit("#"), F.xxhash64(*map(F.col, [c for c in ("row_number", "row_uuid") if c in df.columns] or [f"`{KEY}`"])).cast("string")))  # spread where there is none
            more = F.when(~valid, F.array(_error(MISSING, KEY, F.lit(None), "missing_primary_key", "Transaction ID is missing (required when majority have it)"))).when(F.col("__key").isNotNull(), F.array(_error(DUPLICATE, KEY, key, "duplicate_primary_key", F.concat(F.lit("Duplicate Transaction ID: "), key))))
            out = out.join(often, own == F.col("__key"), "left")
            out = out.withColumn(ERRORS, F.concat(F.col(ERRORS), F.coalesce(more.cast(ERROR), F.array().cast(ERROR)))).drop("__key")
    for k, columns in enumerate(contract.unique if extra else ()):
        n = F.count(F.lit(1)).over(W.partitionBy(*[F.col(f"`{c}`") for c in columns]))
        error = _error(UNIQUE + k, "/".join(columns), F.concat_ws("|", *[F.col(f"`{c}`") for c in columns]), "unique_violation", f"Repeated {'/'.join(columns)}")
        out = out.withColumn("__n", n).withColumn(ERRORS, F.when(F.col("__n") > 1, F.concat(F.col(ERRORS), F.array(error).cast(ERROR))).otherwise(F.col(ERRORS))).drop("__n")
    return out


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(ERRORS) == 0).drop(ERRORS)


def _any(kinds: tuple[str, ...]) -> Column:
    return F.exists(ERRORS, lambda x: x.error_type.isin(*kinds))


def category_by_priority() -> Column:
    """Accounting and required-field errors first, then types."""
    return F.when(_any(("debit_xor_credit", "missing_column", "required_field")), VALIDATION).when(_any(("type_mismatch",)), PARSE).otherwise(VALIDATION)


def category_by_first() -> Column:
    """The first error of a known kind decides."""
    named = lambda x: (
        F.when(x.error_type.isin("debit_xor_credit", "missing_column", "required_field", "missing_primary_key", "duplicate_primary_key"), VALIDATION)
        .when(x.error_type == "type_mismatch", PARSE).when(F.lower(x.error_type).contains("llm"), CONTRACT)
        .when(F.lower(x.error_type).contains("confidence"), CONFIDENCE).when(F.lower(x.error_type).contains("edit_cap"), CAP)
    )
    return F.coalesce(F.get(F.filter(F.transform(ERRORS, named), lambda x: x.isNotNull()), 0), F.lit(VALIDATION))


def quarantined_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(ERRORS) > 0).withColumns({"error_category": category_by_first(), "validator_category": category_by_priority()})


def error_table(checked: DataFrame) -> DataFrame:
    """One row per failed check."""
    ids = [c for c in ("row_uuid", "row_number") if c in checked.columns]
    return checked.select(*ids, F.explode_outer(ERRORS).alias("x")).filter("x is not null").select(*ids, "x.*")
