"""Residual values: what the rules left outside the canonical lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.contract import RunOptions, TableContract
from sparkwright.sources.sinks import scratch

#: A mapper gets (column, values, canonical names) and returns value -> canonical
#: name or None.
Mapper = Callable[[str, list[str], list[str]], dict[str, str | None]]


def canonical_values(spark: SparkSession, contract: TableContract, columns: tuple[str, ...]) -> DataFrame:
    """(column, canonical): contract lists, a few names each."""
    rows = [(c, v) for c in columns for v in contract.canonical(c)]
    return spark.createDataFrame(rows, "column string, canonical string")


def long_values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(row_number, column, value) without nulls."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
    return df.select("row_number", F.explode_outer(pairs).alias("x")).select("row_number", "x.column", "x.value").filter("value is not null")


def residual_cells(df: DataFrame, contract: TableContract, columns: tuple[str, ...]) -> DataFrame:
    columns = tuple(c for c in columns if c in df.columns and contract.canonical(c))
    known = canonical_values(df.sparkSession, contract, columns)
    cells = long_values(df, columns)
    return cells.join(F.broadcast(known), (cells["column"] == known["column"]) & (cells["value"] == known["canonical"]), "left_anti")


def residuals(df: DataFrame, contract: TableContract, columns: tuple[str, ...]) -> DataFrame:
    """One row per distinct residual value: how many rows hold it and the first."""
    return residual_cells(df, contract, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_number").alias("first_row"))


def edit_counts(found: DataFrame, total: DataFrame, cap_pct: float) -> DataFrame:
    """Per column the rows that hold a residual and whether their share of all
    rows (``total``, one row with ``n_all``) passes the cap."""
    counts = found.groupBy("column").agg(F.sum("n_rows").alias("affected"))
    share = F.try_divide(100.0 * F.col("affected"), F.col("n_all"))
    return counts.crossJoin(F.broadcast(total)).select("column", "affected", share.alias("share_pct"), (share > cap_pct).alias("over_cap"))


def under_cap(found: DataFrame, counts: DataFrame) -> DataFrame:
    """A column over the cap is left out as a whole."""
    return found.join(F.broadcast(counts.filter("not over_cap").select("column")), "column", "left_semi")  # a row per column


#: Rows of first sight whose residual values are numbered together.
SPAN = 1 << 16


def placed(found: DataFrame) -> DataFrame:
    """``found`` with ``place``: 1, 2, ... in the order of first sight, per column.
    Values are numbered within spans of ``SPAN`` rows of the table; the one task of
    a column gets a number for each span, not all its values."""
    span = F.floor(F.col("first_row") / SPAN).alias("span")
    sizes = found.groupBy("column", span).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("column").orderBy("span").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("column", "span", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("column", "span").orderBy("first_row", "value"))
    rows = found.withColumn("span", span).withColumn("within", within).join(sizes, ["column", "span"])
    return rows.withColumn("place", F.col("before") + F.col("within")).drop("span", "within", "before")


def batched(found: DataFrame, size: int) -> DataFrame:
    """Chunks of distinct values in first-seen order, per column."""
    return placed(found).withColumn("batch_id", F.floor((F.col("place") - 1) / size).cast("long")).drop("place")


def map_values(batches: DataFrame, contract: TableContract, mapper: Mapper, attempts: int = 3) -> DataFrame:
    """(column, value, mapped): the mapper runs once per batch, on distinct
    values only; a batch is bounded by its size.  What was not asked for, and
    targets that are not canonical, are left out."""
    columns = [r[0] for r in batches.select("column").distinct().collect()]  # mapped columns, a few
    lists = {c: list(contract.canonical(c)) for c in columns}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, values = pdf["column"].iloc[0], sorted(pdf["value"])
        for left in range(attempts - 1, -1, -1):
            try:
                answer = mapper(name, values, lists[name])
                break
            except Exception:
                if not left:
                    raise
        mapped = [answer.get(v) if answer.get(v) in lists[name] else None for v in values]
        return pd.DataFrame({"column": name, "value": values, "mapped": mapped})

    return batches.groupBy("column", "batch_id").applyInPandas(run, "column string, value string, mapped string")


# The offline mapper's tests, in order: names found in the lower-case
# value, names that must not be, canonical name.
DEPARTMENT_TESTS = (
    (("tech", "it"), (), "IT"), (("sale",), (), "Sales"), (("financ", "account"), (), "Finance"), (("market",), (), "Marketing"), (("hr", "human"), (), "HR"),
    (("legal", "law"), (), "Legal"), (("engineer", "dev"), (), "Engineering"), (("support", "help"), (), "Support"), (("ops", "operation"), (), "Operations"), (("admin", "general"), (), "Admin"),
)
ACCOUNT_TESTS = (
    (("cash",), ("petty",), "Cash"), (("receivable", "a/r"), (), "Accounts Receivable"), (("payable", "a/p"), (), "Accounts Payable"), (("revenue", "sales", "income"), (), "Sales Revenue"),
    (("cogs", "cost of"), (), "Cost of Goods Sold"), (("expense", "cost"), (), "Operating Expenses"), (("equipment", "asset"), (), "Equipment"), (("inventory", "stock"), (), "Inventory"), (("retained", "earnings"), (), "Retained Earnings"),
)


def rule_mapping(value: Column, tests: tuple) -> Column:
    """The offline mapper as one expression."""
    low, out = F.lower(value), None
    for names, never, target in tests:
        hit = F.lit(False)
        for n in names:
            hit = hit | low.contains(n)
        for n in never:
            hit = hit & ~low.contains(n)
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return out


def map_by_rules(found: DataFrame, *also: str) -> DataFrame:
    """(column, value, mapped, confidence) of the offline mapper, and the columns
    ``also``."""
    mapped = F.when(F.lower("column").contains("dep"), rule_mapping(F.col("value"), DEPARTMENT_TESTS)).otherwise(rule_mapping(F.col("value"), ACCOUNT_TESTS))
    return found.select("column", "value", mapped.alias("mapped"), F.lit(0.9).alias("confidence"), *also)


def parsed_response(text: Column) -> Column:
    """A mapper's JSON answer as a map, null if it is none; code fences go."""
    return F.from_json(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", ""), "map<string,string>")


def accepted(mapped: DataFrame, floor: float) -> DataFrame:
    return mapped.filter(F.col("mapped").isNotNull() & (F.col("confidence") >= floor))


def apply_mappings(df: DataFrame, mappings: DataFrame, columns: tuple[str, ...], limit_rows: int = 100_000) -> DataFrame:
    """``df`` with mapped values in place, and one change in ``__changes`` for
    each.  ``mappings``: (column, value, mapped, source), one row per value.  It
    is written first, so that what it is made from runs once, and broadcast where
    it has at most ``limit_rows`` rows; beyond, it is joined by shuffle."""
    path = f"{scratch(df.sparkSession)}/mappings"
    mappings.write.parquet(path)
    mappings = df.sparkSession.read.schema(mappings.schema).parquet(path)
    small = mappings.count() <= limit_rows
    changes = F.col("__changes") if "__changes" in df.columns else F.array()
    kind = "array<struct<ord:int,column:string,before:string,after:string,rule_id:string,reason:string>>"
    df = df.withColumn("__changes", changes.cast(kind))
    for k, name in enumerate(c for c in columns if c in df.columns):
        m = mappings.filter(F.col("column") == name).select(F.col("value").alias("__value"), F.col("mapped").alias("__mapped"), F.col("source").alias("__source"))
        c = F.col(f"`{name}`")
        df = df.join(F.broadcast(m) if small else m, c == F.col("__value"), "left")
        hit = F.col("__mapped").isNotNull() & (F.col("__mapped") != c)
        change = F.struct(F.lit(10_000 + k).alias("ord"), F.lit(name).alias("column"), c.alias("before"), F.col("__mapped").alias("after"), F.col("__source").alias("rule_id"), F.lit("Mapped to canonical value").alias("reason"))
        rest = [F.coalesce(F.col("__mapped"), c).alias(n) if n == name else F.col(f"`{n}`") for n in df.columns if n not in ("__value", "__mapped", "__source", "__changes")]
        df = df.select(*rest, F.when(hit, F.concat(F.col("__changes"), F.array(change).cast(kind))).otherwise(F.col("__changes")).alias("__changes"))
    return df


def to_canonical(mapped: DataFrame, contract: TableContract, columns: tuple[str, ...]) -> DataFrame:
    """The mappings (column, value, mapped) whose target is a canonical value of their
    column; others, and null targets, are not kept."""
    known = canonical_values(mapped.sparkSession, contract, columns).select("column", F.col("canonical").alias("mapped"))
    return mapped.join(F.broadcast(known), ["column", "mapped"], "left_semi")  # a contract's lists


def canonical_cells(df: DataFrame, contract: TableContract, column: str) -> DataFrame:
    """(row_number, value) of the rows whose value in a column is canonical."""
    known = canonical_values(df.sparkSession, contract, (column,)).select(F.col("canonical").alias("value"))
    return long_values(df, (column,)).join(F.broadcast(known), "value", "left_semi").select("row_number", "value")  # a contract's list


def planned(df: DataFrame, contract: TableContract, options: RunOptions) -> tuple[DataFrame, DataFrame]:
    """(batches to map, counts per column): the planning of one run."""
    found, counts = residual_facts(df, contract, options.map_columns, options.edit_cap_pct)
    return batched(under_cap(found, counts), options.batch_size), counts


def planner_summary(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Per column: distinct values, rows, the first five values by first row."""
    first = placed(found).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("n_rows").alias("n_rows"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "value")))), lambda x: x.value), "; ").alias("examples"),
    )
    return first.join(F.broadcast(counts.select("column", "over_cap")), "column")


def residual_facts(df: DataFrame, contract: TableContract, columns: tuple[str, ...], cap_pct: float) -> tuple[DataFrame, DataFrame]:
    """(residual values, counts per column) from one pass over ``df``: distinct
    values of each column are counted once, canonical ones and nulls with them, so
    the number of all rows is their sum."""
    columns = tuple(c for c in columns if c in df.columns and contract.canonical(c))
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n_rows long, first_row long"), df.sparkSession.createDataFrame([], "column string, affected long, share_pct double, over_cap boolean")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
    each = df.select("row_number", F.explode(pairs).alias("x")).groupBy("x.column", F.coalesce("x.value", F.lit("")).alias("value"), F.col("x.value").isNull().alias("none"))
    value = F.col("x.value")
    known = F.coalesce(*[F.when(F.col("x.column") == c, value.isin(*contract.canonical(c))) for c in columns])
    # Worked out in the aggregation, so that no filter goes below it and both results share its exchange.
    each = each.agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_number").alias("first_row"), F.bool_or(value.isNotNull() & ~known).alias("residual"))
    left = F.col("residual")
    affected = F.sum(F.when(left, F.col("n_rows")).otherwise(0))
    share = F.try_divide(100.0 * affected, F.sum("n_rows"))
    counts = each.groupBy("column").agg(affected.alias("affected"), share.alias("share_pct"), (share > cap_pct).alias("over_cap")).filter("affected > 0")
    return each.filter(left).select("column", "value", "n_rows", "first_row"), counts


def map_in_place(df: DataFrame, contract: TableContract, columns: tuple[str, ...], source: str = "mapper") -> DataFrame:
    """The offline mapper as a projection: ``df`` with the residual values that it
    knows mapped, and one change in ``__changes`` for each.  No join, no second
    pass over the rows."""
    kind = "array<struct<ord:int,column:string,before:string,after:string,rule_id:string,reason:string>>"
    changes = F.col("__changes") if "__changes" in df.columns else F.array().cast(kind)
    new, log = {}, []
    for k, name in enumerate(c for c in columns if c in df.columns and contract.canonical(c)):
        c = F.col(f"`{name}`")
        target = F.when(c.isNotNull() & ~c.isin(*contract.canonical(name)), rule_mapping(c, DEPARTMENT_TESTS if "dep" in name.lower() else ACCOUNT_TESTS))
        new[f"__mapped{k}"] = target
        hit = F.col(f"__mapped{k}").isNotNull() & (F.col(f"__mapped{k}") != c)
        change = F.struct(F.lit(10_000 + k).alias("ord"), F.lit(name).alias("column"), c.alias("before"), F.col(f"__mapped{k}").alias("after"), F.lit(source).alias("rule_id"), F.lit("Mapped to canonical value").alias("reason"))
        log.append((name, k, F.when(hit, F.array(change).cast(kind)).otherwise(F.array().cast(kind))))
    values = {name: F.coalesce(F.col(f"__mapped{k}"), F.col(f"`{name}`")).alias(name) for name, k, _ in log}
    rest = [values.get(c, F.col(f"`{c}`")) if c in values else F.col(f"`{c}`") for c in df.columns if c != "__changes"]
    return df.withColumns(new).select(*rest, F.concat(changes, *[x for *_, x in log]).alias("__changes"))


def mapping_attempts(mapped: DataFrame) -> DataFrame:
    """What a mapping came to, per column, from (column, value, n_rows, mapped):
    values asked for, rows set right, values without an answer.  Null targets are
    skipped; confidence is not looked at."""
    there = F.col("mapped").isNotNull() & (F.col("mapped") != "")
    return mapped.groupBy("column").agg(F.count(F.lit(1)).alias("attempted"), F.coalesce(F.sum(F.when(there, F.col("n_rows"))), F.lit(0)).alias("fixed"), F.count_if(~there).alias("errors"))


#: An answer to a mapper's request.
ANSWER = "array<struct<value:string,mapped:string,confidence:double,reason:string>>"


def checked_answers(text: Column, names: tuple[str, ...]) -> Column:
    """The items of a JSON answer that keep to the request's contract: a value and
    a reason, a confidence from 0 to 1, a canonical target or none.  An answer that
    is no such list gives none."""
    items = F.from_json(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", ""), ANSWER)
    kept = lambda x: x.value.isNotNull() & x.reason.isNotNull() & F.coalesce(x.confidence.between(0, 1), F.lit(False)) & (x.mapped.isNull() | x.mapped.isin(*names))
    return F.coalesce(F.filter(items, kept), F.array().cast(ANSWER))
