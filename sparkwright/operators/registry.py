"""What runs leave behind and are told: an index of artifacts, a store of contracts.
Both are tables whose parts are replaced when they are written again."""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkwright.contract import ColumnSpec, TableContract

ARTIFACT = "artifact_id string, run_id string, type string, file_name string, content_hash string, storage_path string, size_bytes long, mime_type string, row_count long, created_at timestamp"
SCHEMA = "name string, version string, body string, is_active boolean, created_at timestamp"


AUDIT = "event_id string, run_id string, event_type string, row_uuid string, row_number long, column_name string, before_value string, after_value string, source string, rule_id string, reason string, confidence double, metadata string"


def register(entries: DataFrame, store: str, *by: str) -> None:
    """Puts rows into a table with a folder for each value of ``by`` (``run_id``, if
    not given).  A folder is replaced as a whole when its value is written again, so
    a repeated or retried write leaves one set of rows."""
    by = by or ("run_id",)
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(store)


def replace(entries: DataFrame, store: str, run_id: str) -> None:
    """``register`` for one run, which may have no rows this time: then what it wrote
    before goes.  The write counts its rows, so ``entries`` are made once.  They go to a
    folder beside the others, which then takes the place of the run's: a write by folders
    would sort all rows of a task by the one value that they have."""
    spark, seen = entries.sparkSession, Observation()
    made = f"{store}/_{uuid.uuid4().hex}"  # readers pass over such names
    rows = entries.filter(F.col("run_id") == run_id).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.drop("run_id").write.parquet(made)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old = path(made), path(f"{store}/{_folder('run_id', run_id)}")
    system = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(old, True)
    if not seen.get["n"]:
        system.delete(new, True)
    elif not system.rename(new, old):
        raise OSError(f"{made} could not be renamed to {old.toString()}")


def _folder(column: str, value: str) -> str:
    """The folder that Spark makes for a column's value."""
    return SparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, value)


def _children(spark: SparkSession, path: str) -> list:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(system.listStatus(target)) if system.exists(target) else []


def newest(index: DataFrame, key: str) -> DataFrame:
    """One row for each key, the one made last."""
    rest = [c for c in index.columns if c != key]
    best = index.groupBy(key).agg(F.max(F.struct("created_at", *[c for c in rest if c != "created_at"])).alias("x"))
    return best.select(*[F.col(key) if c == key else F.col(f"x.{c}") for c in index.columns])


def list_artifacts(index: DataFrame, run_id: str) -> DataFrame:
    """The artifacts of one run, oldest first."""
    return index.filter(F.col("run_id") == run_id).orderBy("created_at", "artifact_id")


def get_artifact(index: DataFrame, artifact_id: str) -> DataFrame:
    """One row, or none."""
    return newest(index.filter(F.col("artifact_id") == artifact_id), "artifact_id")


def list_schemas(schemas: DataFrame) -> DataFrame:
    """Active contracts by name, newest version first (as text)."""
    return schemas.filter("is_active").orderBy("name", F.desc("version")).select("name", "version", "created_at")


def get_schema(schemas: DataFrame, name: str, version: str) -> DataFrame:
    """The active contract of that name and version; one row, or none."""
    return schemas.filter(F.col("is_active") & (F.col("name") == name) & (F.col("version") == version)).orderBy(F.desc("created_at")).limit(1)


def store_contract(spark: SparkSession, store: str, name: str, contract: TableContract) -> None:
    body = json.dumps(dataclasses.asdict(contract), sort_keys=True)
    row = spark.createDataFrame([(name, contract.version, body, True)], "name string, version string, body string, is_active boolean")
    register(row.withColumn("created_at", F.current_timestamp()), store, "name", "version")


def load_contract(spark: SparkSession, store: str, name: str, version: str) -> TableContract | None:
    found = get_schema(spark.read.schema(SCHEMA).parquet(store), name, version).collect()
    if not found:
        return None
    body = json.loads(found[0].body)
    columns = tuple(ColumnSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.items()}) for c in body.pop("columns"))
    body["unique"] = tuple(tuple(u) for u in body["unique"])
    return TableContract(columns, **{k: tuple(v) if isinstance(v, list) else v for k, v in body.items()})
