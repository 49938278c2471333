"""Patches from outside: applied where confidence and precondition allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What happened to a patch.
APPLIED, LOW, STALE, NO_ROW, NO_COLUMN = "applied", "low_confidence", "precondition_failed", "not_found", "column_missing"


def same_value(current: Column, before: Column) -> Column:
    """Equal after trimming; null, empty and the words for null are one value."""
    norm = lambda c: F.when(F.lower(F.trim(c)).isin("", "nan", "none", "null"), None).otherwise(F.trim(c))
    return norm(current).eqNullSafe(norm(before))


def outcomes(df: DataFrame, patches: DataFrame, columns: list[str], floor: float = 0.80, enforce: bool = True) -> DataFrame:
    """``patches`` (row_number, column, before, after, confidence, source) with
    the current value and an ``outcome``.  Joined by row_number: content ids may
    collide."""
    cells = df.select("row_number", F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))]).alias("__cells"))
    joined = patches.join(cells, "row_number", "left")
    current = F.try_element_at("__cells", F.col("column"))
    fits = F.lit(True) if not enforce else same_value(current, F.col("before"))
    outcome = (
        F.when(F.col("__cells").isNull(), NO_ROW).when(~F.col("column").isin(*columns), NO_COLUMN)
        .when(F.col("confidence") < floor, LOW).when(~fits, STALE).otherwise(APPLIED)
    )
    return joined.select(*patches.columns, current.alias("current"), outcome.alias("outcome"))


def with_patches(df: DataFrame, decided: DataFrame) -> DataFrame:
    """Every row of ``df`` with its applied patches in ``__patch``, column -> value,
    null where it has none; of two for one cell the greater confidence counts, then
    the greater value."""
    best = decided.filter(F.col("outcome") == APPLIED).groupBy("row_number", "column").agg(F.max(F.struct("confidence", "after")).alias("x"))
    by_row = best.groupBy("row_number").agg(F.map_from_entries(F.collect_list(F.struct("column", "x.after"))).alias("__patch"))
    return df.join(by_row, "row_number", "left")


def apply_patches(df: DataFrame, decided: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with applied patches in place."""
    joined = with_patches(df, decided)
    value = lambda c: F.when(F.array_contains(F.map_keys("__patch"), c), F.try_element_at("__patch", F.lit(c))).otherwise(F.col(f"`{c}`")).alias(c)
    return joined.select(*[value(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def confident(rows: DataFrame, floor: float = 0.80) -> DataFrame:
    return rows.filter(F.col("confidence") >= floor)


def precondition_failures(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("outcome") == STALE)


def patch_stats(decided: DataFrame) -> DataFrame:
    return decided.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == APPLIED).alias("applied"), F.count_if(F.col("outcome") == LOW).alias("skipped_confidence"),
        F.count_if(F.col("outcome") == STALE).alias("skipped_precondition"), F.count_if(F.col("outcome").isin(NO_ROW, NO_COLUMN)).alias("skipped_missing"),
    )


def application_summary(decided: DataFrame) -> DataFrame:
    """Patches by outcome with their share of all."""
    by = decided.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    total = decided.agg(F.count(F.lit(1)).alias("total"))
    return by.crossJoin(F.broadcast(total)).select("outcome", "n", F.try_divide(F.col("n"), F.col("total")).alias("share"))  # one row


def audit_report(log: DataFrame) -> DataFrame:
    """Changes by source, column, rule (where one is named) and confidence class."""
    c = F.col("confidence")
    bucket = F.when(c == 1.0, "1.0").when(c >= 0.9, "0.9-0.99").when(c >= 0.8, "0.8-0.89").when(c.isNotNull(), "below_0.8")
    pairs = F.array(*[F.struct(F.lit(s).alias("scope"), v.alias("name")) for s, v in (("source", F.col("source")), ("column", F.col("column")), ("rule", F.col("rule_id")), ("confidence", bucket))])
    return log.select(F.explode(pairs).alias("x")).filter("x.name is not null").groupBy("x.scope", "x.name").agg(F.count(F.lit(1)).alias("n"))
