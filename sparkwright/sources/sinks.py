"""What a run writes: tables as folders, small reports as single files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.contract import SYSTEM_COLUMNS
from sparkwright.operators.checks import ERRORS
from sparkwright.operators.reports import column_issues, top_messages
from sparkwright.operators.registry import replace
from sparkwright.operators.rules import CHANGES
from sparkwright.sources.hashing import fingerprints
from sparkwright.sources.scratch import brief_shuffles, checkpointed, scratch

#: How the tables of a run are compressed; their readers see it by the files' names.
PACKED = "gzip"
#: Most rows of one of their files, and of one of error texts, whose rows are longer: a
#: packed file is hashed as one value, which so is some 20 MB at most, however many rows a
#: task writes.
FILE_ROWS, TEXT_ROWS = 500_000, 100_000
MEDIA_TYPES = {".csv": "text/csv", ".json": "application/json", ".md": "text/markdown", ".ndjson": "application/x-ndjson"}


def media_type(name: str) -> str:
    """By the name below a compression's ending."""
    return next((v for k, v in MEDIA_TYPES.items() if name.removesuffix(".gz").endswith(k)), "application/octet-stream")


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_pydict({"value": ["\n".join(x or "" for x in b.column(0).to_pylist())]})


def one_text(lines: DataFrame, path: str, header: str) -> None:
    """A sorted table of one text column as one file below ``path``, ``header`` first.  The
    sort's tasks join their lines to blocks; the task that writes reads one block after
    the other and sorts nothing, so its memory does not grow with the table."""
    blocks = checkpointed(lines.mapInArrow(_joined, "value string")).coalesce(1)
    first = F.monotonically_increasing_id() == 0
    blocks.select(F.when(first, F.concat(F.lit(f"{header}\n"), "value")).otherwise(F.col("value")).alias("value")).write.text(path)


def cleaned_table(valid: DataFrame) -> DataFrame:
    data = [c for c in valid.columns if c not in SYSTEM_COLUMNS and not c.startswith("__")]
    return valid.select(*[F.col(f"`{c}`") for c in data], *[c for c in SYSTEM_COLUMNS if c in valid.columns])


def errors_table(quarantined: DataFrame) -> DataFrame:
    """row_number, category, number of errors, the first three messages, number
    of attempted fixes (the row's changes, if it has them beside it), then the data."""
    data = [c for c in quarantined.columns if c not in SYSTEM_COLUMNS and not c.startswith("__") and c not in ("error_category", "validator_category")]
    tried = F.size(CHANGES) if CHANGES in quarantined.columns else F.lit(0)
    messages = F.transform(ERRORS, lambda x: x.message)
    return quarantined.select("row_number", "error_category", F.size(ERRORS).cast("long").alias("error_count"), F.array_join(F.slice(messages, 1, 3), "; ").alias("error_summary"), tried.cast("long").alias("attempted_fixes"), *[F.col(f"`{c}`") for c in data])


def errors_json(quarantined: DataFrame) -> DataFrame:
    """One JSON text per quarantined row: its ids, category, messages, data, errors
    (column, value, type, message) and attempted fixes (column, values before and
    after, source, confidence, reason; none if the row's changes are not beside it).
    Nulls are written."""
    data = [c for c in quarantined.columns if c not in SYSTEM_COLUMNS and not c.startswith("__") and c not in ("error_category", "validator_category")]
    mapped = lambda x: x.ord >= 10_000
    fix = lambda x: F.struct(
        x.column.alias("column"), x.before.alias("before_value"), x.after.alias("after_value"), F.when(mapped(x), x.rule_id).otherwise("rule").alias("source"),
        F.when(mapped(x), 0.9).otherwise(1.0).alias("confidence"), x.reason.alias("reason"),
    )
    fixes = F.transform(CHANGES, fix) if CHANGES in quarantined.columns else F.array().cast("array<string>")
    detail = F.struct(
        *[c for c in SYSTEM_COLUMNS if c in quarantined.columns], "error_category", F.transform(ERRORS, lambda x: x.message).alias("messages"), F.struct(*[F.col(f"`{c}`") for c in data]).alias("data"),
        F.transform(ERRORS, lambda x: F.struct(x.column.alias("column"), x.value.alias("value"), x.error_type.alias("type"), x.message.alias("message"))).alias("errors"), fixes.alias("fixes"),
    )
    return quarantined.select("row_number", F.to_json(detail, {"ignoreNullFields": "false"}).alias("detail"))


def diff_table(log: DataFrame) -> DataFrame:
    return log.select(*[c for c in SYSTEM_COLUMNS if c in log.columns], "column", F.coalesce("before", F.lit("")).alias("before_value"), F.coalesce("after", F.lit("")).alias("after_value"), "source", "reason", "confidence")


def audit_table(log: DataFrame, run_id: str) -> DataFrame:
    """Events with an id made from their content, so a repeated run repeats it."""
    event = F.sha2(F.concat_ws("|", F.lit(run_id), "row_number", "ord", "column", F.coalesce("after", F.lit(""))), 256)
    return log.select(F.substring(event, 1, 32).alias("event_id"), F.lit(run_id).alias("run_id"), F.lit("cell_change").alias("event_type"), *[c for c in SYSTEM_COLUMNS if c in log.columns], F.col("column").alias("column_name"), F.col("before").alias("before_value"), F.col("after").alias("after_value"), "source", "rule_id", "reason", "confidence", F.to_json(F.struct("ord")).alias("metadata"))


def idempotency_key(parts: list[str]) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def summary_text(metrics: dict, issues: list[tuple[str, int]], rules: dict[str, int] | None = None, sources: dict[str, int] | None = None, categories: dict[str, int] | None = None, messages: list[tuple[str, int]] | None = None, columns: list[tuple[str, int]] | None = None, files: list[tuple[str, int]] | None = None, state: str = "") -> str:
    """The Markdown report; absent figures print as 0, absent parts are left out."""
    n = lambda k: metrics.get(k) or 0
    lines = ["# Run summary", "", *([f"State: {state}.", ""] if state else []), "| figure | value |", "|-|-|"]
    lines += [f"| {k} | {n(k):,} |" for k in ("total_rows", "clean_rows", "quarantined_rows", "total_cells", "cells_modified", "rows_modified", "n_changes")]
    lines += [f"| quarantine rate | {n('quarantine_rate'):.1%} |", f"| modification rate | {n('modification_rate'):.1%} |"]

    def part(title: str, rows: list[tuple[str, int]] | None) -> None:
        if rows is not None:
            lines.extend(["", f"## {title}", "", *([f"- {name}: {count:,}" for name, count in rows] or ["None."])])

    by_count = lambda d: None if d is None else sorted(d.items(), key=lambda x: (-x[1], x[0]))
    part("Changes by rule", by_count(rules))
    part("Changes by source (rules, mapper, cache)", by_count(sources))
    part("Quarantined rows by category", by_count(categories))
    part("Most frequent messages", messages)
    part("Columns with most errors", columns)
    part("Most frequent issues", issues)
    part("Files and their bytes", files)
    return "\n".join(lines) + "\n"


def copy_input(spark: SparkSession, source: str, folder: str) -> str:
    """The input's bytes beside the outputs, through Hadoop's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, there = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(f"{folder}/{source.rstrip('/').rsplit('/', 1)[-1]}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(here.getFileSystem(conf), here, there.getFileSystem(conf), there, False, True, conf)
    return there.toString()


def files_below(spark: SparkSession, path: str) -> DataFrame:
    return fingerprints(spark, path, below=True)


def bytes_below(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Bytes by the folder or file below ``path``; the files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    top = F.regexp_extract("path", f"{path.strip('/').rsplit('/', 1)[-1]}/([^/]+)", 1).alias("top")
    return [(r.top, r.n) for r in files.groupBy(top).agg(F.sum("length").alias("n")).orderBy("top").collect()]


def artifact_entries(spark: SparkSession, path: str, run_id: str, rows: dict[str, int]) -> DataFrame:
    """Index entries of the files below ``path``: their type is the folder or the
    name below it, their identifier comes from run, place and content."""
    files = files_below(spark, path)
    below = F.expr(f"substring(path, locate({json.dumps('/' + path.strip('/').rsplit('/', 1)[-1] + '/')}, path) + {len(path.strip('/').rsplit('/', 1)[-1]) + 2})")
    first = F.element_at(F.split(below, "/"), 1)
    kind = F.regexp_replace(first, r"\.[a-z]+$", "")
    mime = F.coalesce(*[F.when(F.regexp_replace("path", r"\.gz$", "").endswith(k), v) for k, v in MEDIA_TYPES.items()], F.lit("application/octet-stream"))
    counts = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in rows.items()], F.lit(None)).cast("long")
    identity = F.substring(F.sha2(F.concat_ws("|", F.lit(run_id), below, "sha256"), 256), 1, 32)
    return files.select(
        identity.alias("artifact_id"), F.lit(run_id).alias("run_id"), kind.alias("type"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("sha256").alias("content_hash"),
        F.col("path").alias("storage_path"), F.col("length").alias("size_bytes"), mime.alias("mime_type"), counts.alias("row_count"), F.current_timestamp().alias("created_at"),
    )


def write_run(result, path: str, by_row: bool = True, store: str | None = None) -> DataFrame:
    """Writes all artifacts of a run below ``path``, the input file's bytes among
    them, and returns an index of the files (path, length, sha256).  ``by_row``
    sorts diff and errors by row.  The tables are written compressed.  With ``store``, the index also goes to that table
    (``operators.registry``), and the audit to the one beside it; a run that is
    written again replaces what it had written there."""
    spark = result.checked.sparkSession
    ordered = lambda df: df.orderBy("row_number") if by_row else df
    writer = lambda df, rows=FILE_ROWS: df.write.mode("overwrite").option("compression", PACKED).option("maxRecordsPerFile", rows)
    table = lambda df, name: writer(df).option("header", True).csv(f"{path}/{name}")
    with brief_shuffles(spark):
        table(cleaned_table(result.valid), "cleaned")
        table(ordered(errors_table(result.quarantined)), "errors")
        writer(errors_json(result.quarantined), TEXT_ROWS).json(f"{path}/errors_json")
        # Rows are sorted before their changes are taken apart: several times fewer bytes.
        table(diff_table(result.changes_of(ordered(result.checked.select(*SYSTEM_COLUMNS, CHANGES)))), "diff")
        audit = audit_table(result.changes, result.run_id)
        writer(audit).json(f"{path}/audit")
        if store:
            replace(audit, f"{store}-audit", result.run_id)
    metrics = result.metrics.first().asDict()
    put_bytes(spark, f"{path}/metrics.json", json.dumps(metrics, sort_keys=True, indent=1, default=str).encode())
    put_bytes(spark, f"{path}/manifest.json", json.dumps({"run_id": result.run_id, "idempotency_key": result.key, "options": vars(result.options), "source": result.source}, sort_keys=True, default=list).encode())
    if result.source:
        copy_input(spark, result.source, f"{path}/input")
    counted = lambda df, *by: {tuple(r)[:-1] if len(by) > 1 else r[0]: r[-1] for r in df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()}
    by_rule = counted(result.changes, "source", "rule_id")  # as many rows as there are rules
    sources: dict[str, int] = {}
    for (source, _), k in by_rule.items():
        sources[source] = sources.get(source, 0) + k
    text = summary_text(
        metrics, [(r.issue, r.n) for r in result.issues.collect()], {r: k for (_, r), k in by_rule.items() if r}, sources, counted(result.quarantined, "error_category"),
        [(r.message, r.n) for r in top_messages(result.errors).collect()], [(r["column"], r.n) for r in column_issues(result.errors).collect()],
        bytes_below(spark, path),
        "succeeded" if not metrics["quarantined_rows"] else "partial" if metrics["clean_rows"] else "failed",
    )
    put_bytes(spark, f"{path}/summary.md", text.encode())
    if store:
        rows = {"cleaned": metrics["clean_rows"], "errors": metrics["quarantined_rows"], "errors_json": metrics["quarantined_rows"], "diff": metrics["n_changes"], "audit": metrics["n_changes"]}
        replace(artifact_entries(spark, path, result.run_id, rows), store, result.run_id)
    return files_below(spark, path)
