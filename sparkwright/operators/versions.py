"""The mapping dictionary as a stored table: versions in buckets of their variant,
compacted to the newest.

All versions of a key lie in one bucket, so the newest of each is found, and values
are joined to it, without an exchange of the dictionary; compaction writes a new
generation of the table that holds one version of each key.  One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators.mapping import latest

#: What a bucket is made of; rows of a key have it in common.
BUCKET = ("column_name", "variant_value")
COLUMNS = ("column_name", "variant_value", "model_id", "canonical_value", "confidence", "created_at")


@dataclass(frozen=True)
class VersionStore:
    """Tables ``{name}_0``, ``{name}_1`` and so on in the session's catalog, of which
    the last is the one in use.  Their files are in ``folder``, if one is given,
    else in the warehouse."""

    spark: SparkSession
    name: str
    buckets: int = 32
    folder: str | None = None

    def _generation(self) -> int:
        tails = [t.name.removeprefix(f"{self.name}_") for t in self.spark.catalog.listTables() if t.name.startswith(f"{self.name}_")]
        return max((int(t) for t in tails if t.isdigit()), default=-1)

    @property
    def table(self) -> str:
        return f"{self.name}_{max(0, self._generation())}"

    def _write(self, rows: DataFrame, table: str) -> None:
        writer = rows.write.bucketBy(self.buckets, *BUCKET).sortBy(*BUCKET).mode("append").format("parquet")
        (writer.option("path", f"{self.folder}/{table}") if self.folder else writer).saveAsTable(table)

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if self.folder:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def append(self, versions: DataFrame) -> None:
        """Adds versions; a version that is there already changes nothing."""
        self._write(versions.select(*COLUMNS).repartition(self.buckets, *BUCKET), self.table)  # a file for each bucket

    def current(self) -> DataFrame:
        """The newest version of each key, ties to the greater target."""
        return latest(self.spark.table(self.table))

    def compact(self) -> None:
        """Leaves the newest version of each key."""
        old = self._generation()
        self._write(self.current(), f"{self.name}_{old + 1}")
        self._drop(f"{self.name}_{old}")

    def lookup(self, values: DataFrame) -> DataFrame:
        """(column, value) with each model's target, where the dictionary has one."""
        now = self.current().select(F.col("column_name").alias("column"), F.col("variant_value").alias("value"), "model_id", F.col("canonical_value").alias("mapped"), "confidence")
        return values.join(now, ["column", "value"])

    def drop(self) -> None:
        for k in range(self._generation() + 1):
            self._drop(f"{self.name}_{k}")
