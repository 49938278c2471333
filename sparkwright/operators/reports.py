"""Statistics of a run: small results, aggregated before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.operators.checks import CAP, CONFIDENCE, CONTRACT, ERRORS, PARSE, VALIDATION
from sparkwright.operators.rules import CHANGES
from sparkwright.sources.scratch import stored

CATEGORIES = (VALIDATION, PARSE, CONTRACT, CONFIDENCE, CAP)


def quarantine_totals(checked: DataFrame, *more: Column) -> DataFrame:
    """One row: rows, clean and quarantined rows, errors, rates (0 for no rows), and
    ``more`` aggregates of the same pass."""
    bad = F.size(ERRORS) > 0
    sums = checked.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(bad).alias("quarantined_rows"), F.coalesce(F.sum(F.size(ERRORS)), F.lit(0)).cast("long").alias("total_errors"), *more)
    rate = lambda x: F.coalesce(F.try_divide(x, F.col("total_rows")), F.lit(0.0))
    return sums.select("total_rows", (F.col("total_rows") - F.col("quarantined_rows")).alias("clean_rows"), "quarantined_rows", "total_errors", rate(F.col("total_rows") - F.col("quarantined_rows")).alias("success_rate"), rate(F.col("quarantined_rows")).alias("quarantine_rate"), *sums.columns[3:])


def rows_by_category(quarantined: DataFrame, column: str = "error_category") -> DataFrame:
    return quarantined.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def errors_by(errors: DataFrame) -> DataFrame:
    """Errors by type and by column in one pass."""
    sets = errors.groupingSets([["error_type"], ["column"]], "error_type", "column").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 1, "type").otherwise("column").alias("scope"), F.coalesce("error_type", "column").alias("name"), "n")


def top_messages(errors: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent messages; ties go to the one seen first."""
    seen = F.min(F.struct("ord", "row_number"))
    return errors.groupBy("message").agg(F.count(F.lit(1)).alias("n"), seen.alias("first")).orderBy(F.desc("n"), "first", "message").limit(k).select("message", "n")


def top_issues(errors: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent ``column:error_type``; ties by name."""
    issue = F.concat_ws(":", "column", "error_type")
    return errors.groupBy(issue.alias("issue")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue").limit(k)


def column_issues(errors: DataFrame, k: int = 5) -> DataFrame:
    return errors.groupBy("column").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "column").limit(k)


def quarantine_summary(quarantined: DataFrame) -> DataFrame:
    """Rows of each category, their share in per cent, whether they are fixable."""
    by = rows_by_category(quarantined)
    total = by.agg(F.sum("n").alias("total"))  # from at most five rows
    return by.crossJoin(F.broadcast(total)).select("category", "n", (F.col("n") * 100 / F.col("total")).alias("percentage"), F.col("category").isin(CONFIDENCE, CAP).alias("fixable"))


def validation_summary(errors: DataFrame, category: Column) -> DataFrame:
    """Errors by category with zeros for those that do not occur."""
    spark = errors.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    n = errors.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def first_rows(rows: DataFrame, by: str, k: int) -> DataFrame:
    """(by, examples): the first ``k`` distinct row numbers of each value, as text.
    The first of each of 64 parts come first, so no task sees all rows of one."""
    part = W.partitionBy(by, F.pmod(F.xxhash64("row_number"), F.lit(64))).orderBy("row_number")
    firsts = rows.select(by, "row_number").distinct().withColumn("place", F.row_number().over(part)).filter(F.col("place") <= k)
    firsts = firsts.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("row_number"))).filter(F.col("place") <= k)
    return firsts.groupBy(by).agg(F.array_join(F.sort_array(F.collect_list("row_number")).cast("array<string>"), ",").alias("examples"))


# Words of a message, in order, and the names and priorities of the
# issues; the advice is free text.
REMEDIES = (
    (("required",), "Missing Required Fields", "High", "Ask the source for the empty fields, or agree on a value that stands for them."),
    (("type",), "Data Type Mismatches", "Medium", "Add a rule that turns these values into the column's type, or give the column another type."),
    (("debit", "credit"), "Business Rule Violations", "High", "Have a bookkeeper decide which side each of these amounts belongs to."),
    (("confidence",), "Low Confidence Mappings", "Low", "Confirm the mappings by hand and put the right ones into the dictionary."),
    (("duplicate",), "Duplicate Transaction IDs", "High", "Find out whether the export repeats rows or two entries share a number."),
)


def remediation_report(errors: DataFrame, examples: int = 5) -> DataFrame:
    """Issues by the words of their messages: distinct rows, the first example
    rows, priority and advice."""
    low = F.lower("message")
    chain = F.when(F.lit(False), F.lit(-1))
    for k, (words, *_) in enumerate(REMEDIES):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        chain = chain.when(hit, F.lit(k))
    # Written once: counts and examples both come from it, so errors are made once.
    rows = stored(errors.select(chain.alias("k"), "row_number").filter("k is not null").distinct())
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("affected_rows"))
    spark = errors.sparkSession
    said = spark.createDataFrame([(k, r[1], r[2], r[3]) for k, r in enumerate(REMEDIES)], "k int, issue string, priority string, recommendation string")
    shown = first_rows(rows, "k", examples).withColumnRenamed("examples", "example_rows")
    return counts.join(F.broadcast(said), "k").join(F.broadcast(shown), "k").select("issue", "affected_rows", "priority", "recommendation", "example_rows")  # five rows


def run_metrics(raw_columns: int, checked: DataFrame) -> DataFrame:
    """One row: rows, cells, changed cells, changed rows, quarantine and rates.  Every
    ``row_number`` is one row, which has its changes beside it, so they are counted there."""
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    both = quarantine_totals(
        checked, zero(F.size(CHANGES)).alias("n_changes"), zero(F.size(F.array_distinct(F.transform(CHANGES, lambda x: x.column)))).alias("cells_modified"),
        F.count_if(F.size(CHANGES) > 0).alias("rows_modified"),
    )
    cells = F.col("total_rows") * raw_columns
    return both.select("total_rows", cells.alias("total_cells"), "n_changes", "cells_modified", "rows_modified", "quarantined_rows", "clean_rows", F.coalesce(F.try_divide(F.col("cells_modified"), cells), F.lit(0.0)).alias("modification_rate"), "quarantine_rate")


def run_state(checked: DataFrame) -> DataFrame:
    t = quarantine_totals(checked)
    return t.select(F.when(F.col("quarantined_rows") == 0, "succeeded").when(F.col("clean_rows") > 0, "partial").otherwise("failed").alias("state"))


def hit_ratio(hits: Column, misses: Column) -> Column:
    """Null where nothing was looked up."""
    return F.try_divide(hits, hits + misses)


def run_stats(runs: DataFrame) -> DataFrame:
    """Counts of runs by status, mean seconds of those that ended, workers that are busy."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    seconds = F.col("completed_at").cast("double") - F.col("started_at").cast("double")
    return runs.agg(F.count(F.lit(1)).alias("total"), *[of(s) for s in ("queued", "running", "succeeded", "failed", "partial")], F.avg(F.when(F.col("completed_at").isNotNull(), seconds)).alias("mean_seconds"), F.countDistinct(F.when(F.col("status") == "running", F.col("worker_id"))).alias("workers"))
