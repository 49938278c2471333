"""Profiles and inferred contracts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.contract import BOOLEAN, DATE, DECIMAL, INTEGER, STRING, SYSTEM_COLUMNS, ColumnSpec, TableContract


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SYSTEM_COLUMNS and not c.startswith("__")]


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("row_number", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("row_number", "x.column", "x.value")


def guessed_type(c: Column) -> Column:
    return F.when(c.isNull(), "empty").when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), "date").when(F.replace(c, F.lit(","), F.lit("")).rlike(r"^-?\d+\.?\d*$"), "numeric").otherwise("string")


def profile(df: DataFrame, exact: bool = True, k: int = 5) -> DataFrame:
    """Per column: values, nulls, distinct values, guessed type of the first
    value, and the ``k`` most frequent values with their counts, ties by value
    (``most_common``).  One scan and one shuffle of the distinct values, whose counts
    give all of these; with ``exact`` off, distinct and most frequent values are
    estimated (rare ones are left out), which shuffles sketches only."""
    pairs = _pairs(df, data_columns(df))
    there = F.col("value").isNotNull()
    if not exact:
        top = F.call_function("approx_top_k", F.col("value"), F.lit(k + 1), F.lit(1024))  # null may be among them
        out = pairs.groupBy("column").agg(F.count("value").alias("non_null"), F.count_if(~there).alias("nulls"), F.approx_count_distinct("value").alias("distinct_values"), F.min(F.when(there, F.struct("row_number", "value"))).alias("first"), top.alias("top"))
        most = F.slice(F.transform(F.filter("top", lambda x: x.item.isNotNull()), lambda x: F.struct(x.item.alias("value"), x["count"].alias("n"))), 1, k)
        return out.select("column", "non_null", "nulls", "distinct_values", guessed_type(F.col("first.value")).alias("data_type"), most.alias("most_common"))
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("row"))
    rows_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    facts = counts.groupBy("column").agg(rows_if(there).alias("non_null"), rows_if(~there).alias("nulls"), F.count("value").alias("distinct_values"), F.min(F.when(there, F.struct("row", "value"))).alias("first"))
    # ``row`` decides nothing here, but with it both read the same counts, so Spark shuffles them once.
    place = F.row_number().over(W.partitionBy("column").orderBy(~there, F.desc("n"), "value", "row"))
    top = counts.withColumn("place", place).filter(F.col("place") <= k).filter(there)
    top = top.groupBy(F.col("column").alias("of")).agg(F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("top"))  # k rows
    out = facts.join(F.broadcast(top), F.col("column") == F.col("of"), "left")
    most = F.coalesce(F.transform("top", lambda x: F.struct(x.value.alias("value"), x.n.alias("n"))), F.array().cast("array<struct<value:string,n:bigint>>"))
    return out.select("column", "non_null", "nulls", "distinct_values", guessed_type(F.col("first.value")).alias("data_type"), most.alias("most_common"))


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each column; ties by value."""
    counts = _pairs(df, data_columns(df)).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def is_plain_date(c: Column) -> Column:
    """The shapes and formats that inference takes for dates."""
    shape = c.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{2}/\d{2})$")
    tried = [F.when(c.rlike(rx), F.try_to_timestamp(F.initcap(c), F.lit(f))) for rx, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\p{L}+ \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^\d{1,2} \p{L}+ \d{4}$", "d MMMM yyyy"))]
    return shape | F.coalesce(*tried).isNotNull()


def voted_type(c: Column) -> Column:
    s = F.trim(c)
    number = F.translate(s, ",$", "")
    return (
        F.when(F.lower(s).isin("true", "false", "yes", "no", "1", "0"), BOOLEAN).when(s.rlike(r"^[+-]?\d+$"), INTEGER)
        .when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | F.lower(number).rlike(r"^[+-]?(inf|infinity|nan)$"), DECIMAL)
        .when(is_plain_date(s), DATE).otherwise(STRING)
    )


#: Which type wins where two have as many votes.
RANK = (INTEGER, DECIMAL, DATE, BOOLEAN, STRING)


def inferred_types(df: DataFrame, sample: int = 1000, votes: int = 100) -> DataFrame:
    """(column, type): the votes of the first values of the head sample."""
    head = df.orderBy("row_number").limit(sample)
    pairs = _pairs(head, data_columns(df)).filter("value is not null")
    place = F.row_number().over(W.partitionBy("column").orderBy("row_number"))
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("vote"))
    n = pairs.withColumn("place", place).filter(F.col("place") <= votes).groupBy("column", voted_type(F.col("value")).alias("vote")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("column").agg(F.max(F.struct("n", (-rank).alias("r"), "vote")).alias("x")).select("column", F.col("x.vote").alias("data_type"))


def inferred_facts(df: DataFrame, sample: int = 1000) -> DataFrame:
    """Per column of the head sample: share of values, distinct share, sorted
    distinct values if they look like an enum (at most 20)."""
    head = df.orderBy("row_number").limit(sample)
    out = _pairs(head, data_columns(df)).groupBy("column").agg(
        (F.count("value") / F.count(F.lit(1))).alias("filled"), F.count("value").alias("n"), F.countDistinct("value").alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"),
        F.slice(F.sort_array(F.collect_set("value")), 1, 20).alias("some"),
    )
    enum = F.when(F.try_divide(F.col("n_distinct"), F.col("n")) < 0.1, F.col("some"))
    return out.select("column", (F.col("filled") > 0.95).alias("required"), "n_distinct", "n_rows", enum.alias("enum"))


# Patterns of reference numbers and of UUIDs; columns that a mapper may see.
REFERENCE_PATTERNS = (r"^REF-?\d+$", r"^INV-?\d+$", r"^TXN-?\d+$", r"^[A-Z]{2,4}-?\d+$")
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MAPPABLE = ("department", "category", "type", "status", "account_name", "account", "vendor", "customer")


def pattern_shares(df: DataFrame, columns: list[str], sample: int = 1000) -> DataFrame:
    """(column, k, share): how many values fit each pattern, in any case."""
    patterns = (*REFERENCE_PATTERNS, UUID_PATTERN)
    head = _pairs(df.orderBy("row_number").limit(sample), columns).filter("value is not null")
    fits = F.array(*[F.struct(F.lit(k).alias("k"), F.col("value").rlike(f"(?i){p}").cast("int").alias("fit")) for k, p in enumerate(patterns)])
    return head.select("column", F.explode(fits).alias("x")).groupBy("column", "x.k").agg(F.avg("x.fit").alias("share"))


def canonical_name(name: str) -> str:
    name = re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", name))
    name = re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()
    return re.sub(r"_+", "_", name).strip("_")


def canonical_names(c: Column) -> Column:
    """``canonical_name`` over a column of names."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", ""), r"(?U)\s+", "_")
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(bare, "([a-z])([A-Z])", "$1_$2")), "_+", "_"), F.lit("_"))


def inferred_contract(df: DataFrame, sample: int = 1000) -> TableContract:
    """A contract from the head sample.  The driver sees a few facts per column."""
    columns = data_columns(df)
    types = {r["column"]: r.data_type for r in inferred_types(df, sample).collect()}
    facts = {r["column"]: r for r in inferred_facts(df, sample).collect()}
    shares: dict[tuple[str, int], float] = {(r["column"], r.k): r.share for r in pattern_shares(df, columns, sample).collect()}
    debit, credit = (next((c for c in columns if w in c.lower()), None) for w in ("debit", "credit"))
    specs, key = [], None
    for c in columns:
        name, kind, fact = canonical_name(c), types.get(c, STRING), facts.get(c)
        if debit and credit and c in (debit, credit):
            kind = DECIMAL
        named = name.lower()
        pattern = next((p for k, p in enumerate(REFERENCE_PATTERNS) if ("ref" in named or "number" in named) and shares.get((c, k), 0) > 0.9), None)
        if pattern is None and "id" in named and shares.get((c, len(REFERENCE_PATTERNS)), 0) > 0.9:
            pattern = UUID_PATTERN
        distinct = fact.n_distinct if fact else 0
        unique = bool(fact) and distinct == fact.n_rows and fact.n_rows > 0
        first_key = key is None and unique and kind in (STRING, INTEGER) and any(w in named for w in ("id", "key", "number"))
        key = c if first_key else key
        specs.append(ColumnSpec(
            c, kind, required=bool(fact and fact.required and c not in (debit, credit)), mappable=named in MAPPABLE and kind == STRING and 5 <= distinct <= 100,
            enum=tuple(fact.enum) if fact and kind == STRING and fact.enum else (), pattern=pattern, primary_key=first_key,
        ))
    return TableContract(tuple(specs), debit_xor_credit=bool(debit and credit), aliases={c: canonical_name(c) for c in columns})


def default_contract(columns: list[str]) -> TableContract:
    return TableContract(tuple(ColumnSpec(c) for c in columns))
