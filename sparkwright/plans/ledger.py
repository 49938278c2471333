"""One run: ingest, rules, residual mapping, checks, reports, in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.contract import RunOptions, TableContract, ledger_contract
from sparkwright.operators import checks, mapping, profiling, reports, residual
from sparkwright.operators.rules import apply_rules, change_log
from sparkwright.sources.scratch import forget, scratch, stored
from sparkwright.sources.sinks import idempotency_key
from sparkwright.sources.tabular import read_table


@dataclass(frozen=True)
class RunResult:
    """Lazy frames over stored tables; ``close`` deletes those (``kept``)."""

    run_id: str
    key: str
    options: RunOptions
    ruled: DataFrame
    checked: DataFrame
    mapped: DataFrame | None
    source: str | None = None
    kept: tuple[str, ...] = ()

    @property
    def valid(self) -> DataFrame:
        return checks.valid_rows(self.checked)

    @property
    def quarantined(self) -> DataFrame:
        return checks.quarantined_rows(self.checked)

    @property
    def errors(self) -> DataFrame:
        return checks.error_table(self.checked)

    @property
    def changes(self) -> DataFrame:
        return self.changes_of(self.checked)

    @staticmethod
    def changes_of(checked: DataFrame) -> DataFrame:
        log = change_log(checked)
        source = F.when(F.col("ord") >= 10_000, F.col("rule_id")).otherwise(F.col("source"))
        return log.withColumns({"source": source, "rule_id": F.when(F.col("ord") < 10_000, F.col("rule_id")), "confidence": F.when(F.col("ord") >= 10_000, 0.9).otherwise(F.col("confidence"))})

    @property
    def metrics(self) -> DataFrame:
        return reports.run_metrics(len(profiling.data_columns(self.checked)), self.checked)

    @property
    def issues(self) -> DataFrame:
        return reports.top_issues(self.errors)

    def close(self) -> None:
        for path in self.kept:
            forget(self.checked.sparkSession, path)


def run(source: DataFrame | str, contract: TableContract | None = None, options: RunOptions = RunOptions(), spark: SparkSession | None = None, mapper: residual.Mapper | None = None, dictionary: DataFrame | None = None, run_id: str = "run", persist: bool = True) -> RunResult:
    """Cleans a table (text columns, ``row_uuid``, ``row_number``) or a file.

    Values the rules leave outside the canonical lists come from the
    ``dictionary`` (newest version), then from ``mapper`` if one is given (the
    offline one is ``residual.map_by_rules``); both respect the edit cap and the
    confidence floor.  ``dry_run`` plans the mapping and applies none.  With
    ``persist``, the rules and the checks run here, once for all results of the run:
    the checked rows (and the ruled ones, where values are mapped) are stored as
    compressed Parquet until it is closed; without, nothing is kept.
    """
    if problem := options.problem():
        raise ValueError(problem)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        if not persist:
            return df
        kept.append(scratch(df.sparkSession))
        return stored(df, kept[-1])

    origin = source if isinstance(source, str) else None
    if isinstance(source, str):
        source = read_table(spark or SparkSession.getActiveSession(), source, contract, options)
    if options.use_inferred:
        contract = profiling.inferred_contract(source)
    contract = contract or ledger_contract()
    ruled = apply_rules(source, contract, log_all_numbers=options.log_all_numbers)
    columns = tuple(c for c in options.map_columns if c in source.columns and contract.canonical(c))
    mapping_wanted = bool(columns) and (mapper is not None or dictionary is not None)
    ruled = keep(ruled) if mapping_wanted else ruled
    final, mapped = ruled, None
    if mapping_wanted:
        batches, _ = residual.planned(ruled, contract, options)
        parts, left = [], batches
        if dictionary is not None:
            now = mapping.latest(dictionary)
            parts.append(mapping.hits(batches.select("column", "value"), now).filter(F.col("confidence") >= options.confidence_floor).select("column", "value", "mapped", F.lit("cache").alias("source")))
            left = mapping.misses(batches, now)
        if mapper is not None:
            parts.append(residual.map_values(left, contract, mapper).filter("mapped is not null").withColumn("source", F.lit("mapper")))
        mapped = parts[0]
        for p in parts[1:]:
            mapped = mapped.unionByName(p)
        if not options.dry_run:
            final = residual.apply_mappings(ruled, mapped, columns)
    checked = keep(checks.check(final, contract, empty_is_null=options.empty_is_null))
    key = idempotency_key([contract.version, run_id, repr(options)])
    return RunResult(run_id, key, options, ruled, checked, mapped, origin, tuple(kept))
