"""The mapping dictionary: versions of variant -> canonical, newest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.operators.registry import register

KEY = ("column_name", "variant_value", "model_id")


def latest(mappings: DataFrame, approved_only: bool = False) -> DataFrame:
    """The newest version of each key; ties go to the greater target."""
    rows = mappings.filter("is_approved") if approved_only else mappings
    best = rows.groupBy(*KEY).agg(F.max(F.struct("created_at", "canonical_value", "confidence")).alias("x"))
    return best.select(*KEY, "x.canonical_value", "x.confidence", "x.created_at")


def store(new: DataFrame, path: str, part: str) -> None:
    """Writes accepted mappings as a part (a run, a day) of a stored dictionary, in
    place of what was stored under that name before; ``stored`` reads all parts."""
    register(new.withColumn("part", F.lit(part)), path, "part")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def applied(df: DataFrame, column: str, table: dict[str, str]) -> DataFrame:
    """``df`` with the values of a column that a small fixed dictionary has replaced;
    the dictionary goes to all tasks as a table."""
    names = df.sparkSession.createDataFrame(list(table.items()), "__variant string, __canonical string")
    out = df.join(F.broadcast(names), F.col(f"`{column}`") == F.col("__variant"), "left")  # the caller's literal dictionary
    return out.select(*[F.coalesce("__canonical", F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def superseded(mappings: DataFrame) -> DataFrame:
    """All versions; each is closed by the creation of the next."""
    w = W.partitionBy(*KEY).orderBy("created_at", "canonical_value")
    return mappings.withColumn("superseded_at", F.lead("created_at").over(w))


def upserted(mappings: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new versions appended; reading it through ``latest`` makes
    them current."""
    return mappings.unionByName(new, allowMissingColumns=True)


def usage(mappings: DataFrame, used: DataFrame) -> DataFrame:
    """Uses of each variant from a log of (column_name, variant_value, used_at)."""
    n = used.groupBy("column_name", "variant_value").agg(F.count(F.lit(1)).alias("use_count"), F.max("used_at").alias("last_used"))
    return mappings.join(n, ["column_name", "variant_value"], "left").fillna(0, ["use_count"])


def stats(mappings: DataFrame) -> DataFrame:
    """Of the current versions: how many, distinct columns and variants, uses, mean confidence."""
    return mappings.agg(
        F.count(F.lit(1)).alias("n_mappings"), F.countDistinct("column_name").alias("n_columns"), F.countDistinct("variant_value").alias("n_variants"),
        F.coalesce(F.sum("use_count"), F.lit(0)).alias("uses"), F.avg("confidence").alias("mean_confidence"),
    )


def hits(values: DataFrame, current: DataFrame) -> DataFrame:
    """Distinct (column, value) that the dictionary has, with their target."""
    return values.join(current.select(F.col("column_name").alias("column"), F.col("variant_value").alias("value"), F.col("canonical_value").alias("mapped"), "confidence"), ["column", "value"])


def misses(values: DataFrame, current: DataFrame) -> DataFrame:
    return values.join(current.select(F.col("column_name").alias("column"), F.col("variant_value").alias("value")), ["column", "value"], "left_anti")
