"""Profiles that merge: one state for each column, made from a part of a table,
stored, and added to those of other parts and other days.

Counts, votes and the two sketches come from one aggregation; a second one, of the
columns that the sketch of distinct values shows to have few, keeps their values as
an exact set.  A state's size does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.contract import STRING
from sparkwright.operators.profiling import RANK, data_columns, guessed_type, voted_type
from sparkwright.operators.registry import register
from sparkwright.sources.scratch import stored

#: Most values that a state keeps as a set.
KEPT = 100
#: Items of the sketch of frequent values; a count is off by at most 1 / (0.75 * it)
#: of all values, and exact while there are fewer distinct ones.
ITEMS = 1024
#: Shares of values: required from, enum below.
REQUIRED, ENUM = 0.95, 0.1


def _long(df: DataFrame) -> DataFrame:
    columns = data_columns(df)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select("row_number", each.alias("x")).select("row_number", "x.column", "x.value")


def states(df: DataFrame) -> DataFrame:
    """A state for each data column of a table with ``row_number``: ``column, n_rows,
    n_values, votes, first, distinct_sketch, top_sketch, kept`` (null for more than
    ``KEPT`` values).  Null values are counted in ``n_rows`` alone; an empty table
    has no state."""
    pairs = _long(df).withColumn("vote", F.when(F.col("value").isNotNull(), voted_type(F.col("value"))))
    facts = pairs.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.array(*[F.count_if(F.col("vote") == t) for t in RANK]).alias("votes"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("row_number", "value"))).alias("first"),
        F.hll_sketch_agg("value").alias("distinct_sketch"), F.call_function("approx_top_k_accumulate", F.col("value"), F.lit(ITEMS)).alias("top_sketch"),
    )
    facts = stored(facts)
    few = [r["column"] for r in facts.filter(F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)) <= 2 * KEPT).select("column").collect()]  # names of columns
    sets = _long(df.select("row_number", *[F.col(f"`{c}`") for c in few])).filter("value is not null").distinct() if few else pairs.select("column", "value").limit(0)
    kept = sets.select("column", "value").distinct().groupBy("column").agg(F.collect_set("value").alias("kept"))
    kept = kept.withColumn("kept", F.when(F.size("kept") <= KEPT, F.sort_array("kept")))
    return facts.join(F.broadcast(kept), "column", "left").withColumn("kept", F.when(F.col("n_values") == 0, F.array().cast("array<string>")).otherwise(F.col("kept")))  # a row for each column


def merged(parts: DataFrame) -> DataFrame:
    """One state for each column from those of several parts: the same as the state
    of all their rows, but for the error of the sketches."""
    total = lambda k: F.sum(F.get("votes", F.lit(k)))
    out = parts.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.array(*[total(k) for k in range(len(RANK))]).alias("votes"), F.min("first").alias("first"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.call_function("approx_top_k_combine", F.col("top_sketch"), F.lit(ITEMS)).alias("top_sketch"),
        F.when(F.bool_and(F.col("kept").isNotNull()), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept"))))).alias("kept"),  # KEPT values a part
    )
    return out.withColumn("kept", F.when(F.size("kept") <= KEPT, F.col("kept")))


def update(states_: DataFrame, store: str, part: str) -> None:
    """Stores the states of a part (a day, a run) under its name, in place of what
    was stored there before."""
    register(states_.withColumn("part", F.lit(part)), store, "part")


def facts(state: DataFrame) -> DataFrame:
    """What the states say: ``column, n_rows, n_values, required, data_type, first_type,
    n_distinct`` (exact up to ``KEPT``, else null), ``about_distinct``, ``enum`` (the
    first 20 values where at most a tenth of the values are distinct)."""
    best = F.array_max(F.array(*[F.struct(F.get("votes", F.lit(k)).alias("n"), F.lit(-k).alias("rank"), F.lit(t).alias("type")) for k, t in enumerate(RANK)]))
    few = F.size("kept").cast("long")
    share = F.try_divide(few, F.col("n_values"))
    return state.select(
        "column", "n_rows", "n_values", (F.col("n_values") > REQUIRED * F.col("n_rows")).alias("required"), F.when(F.col("n_values") > 0, best.type).otherwise(STRING).alias("data_type"),
        guessed_type(F.col("first.value")).alias("first_type"), F.when(F.col("kept").isNotNull(), few).alias("n_distinct"), F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)).alias("about_distinct"),
        F.when(share < ENUM, F.slice("kept", 1, 20)).alias("enum"),
    )


def frequent(state: DataFrame, k: int = 5) -> DataFrame:
    """(column, value, n): the k most frequent values by the stored sketches."""
    top = F.explode(F.call_function("approx_top_k_estimate", F.col("top_sketch"), F.lit(k)))
    return state.select("column", top.alias("x")).select("column", F.col("x.item").alias("value"), F.col("x.count").alias("n")).filter("value is not null")


def unique_columns(df: DataFrame, state: DataFrame, slack: float = 0.1) -> DataFrame:
    """(column): columns of ``df`` whose values are all there and all different.  The
    sketch picks those that may be; their values are then compared exactly."""
    near = F.hll_sketch_estimate("distinct_sketch") >= (1 - slack) * F.col("n_rows")
    names = [r["column"] for r in state.filter((F.col("n_values") == F.col("n_rows")) & near).select("column").collect()]  # names of columns
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "column string")
    pairs = _long(df.select("row_number", *[F.col(f"`{c}`") for c in names]))
    often = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("column").distinct()
    return spark.createDataFrame([(c,) for c in names], "column string").join(often, "column", "left_anti")
