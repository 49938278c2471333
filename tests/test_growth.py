"""What a run keeps on disk, shuffles and holds in one task as its table grows."""

import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from sparkwright.contract import ColumnSpec, TableContract
from sparkwright.functions import dates, strings
from sparkwright.operators import checks, profiling, registry
from sparkwright.operators.rules import CHANGE
from sparkwright.plans.ledger import run
from sparkwright.sources import scratch, sinks

CONTRACT = TableContract((ColumnSpec("Transaction ID"),))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def conf(spark):
    before = {}

    def put(name, value):
        before[name] = spark.conf.get(name)
        spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.set(name, value)


def ledger(spark, n, key):
    return spark.range(n).select(F.col("id").alias("row_number"), F.expr(key).alias("Transaction ID"))


def test_few_repeated_keys_among_many_are_broadcast(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "20k")
    df = checks.check(ledger(spark, 20_000, "CASE WHEN id % 100 = 0 THEN 'x' WHEN id % 50 = 1 THEN 'TXN-7' ELSE concat('TXN-', id + 1000000) END"), CONTRACT)
    kinds = {(r.kind, r.n) for r in checks.error_table(df).groupBy(F.col("error_type").alias("kind")).agg(F.count("*").alias("n")).collect()}
    assert kinds == {("transaction_id_format", 200), ("missing_primary_key", 200), ("duplicate_primary_key", 400)}
    rows = df.select("row_number", "__errors")
    rows.collect()
    assert "SortMergeJoin" not in plan(rows) and "Exchange hashpartitioning" not in plan(rows)


def test_many_repeated_keys_are_joined_by_a_shuffle(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "20k")
    df = checks.check(ledger(spark, 20_000, "CASE WHEN id % 10 = 0 THEN NULL ELSE concat('TXN-', 1000000 + id % 10000) END"), CONTRACT)
    kinds = {(r.kind, r.n) for r in checks.error_table(df).groupBy(F.col("error_type").alias("kind")).agg(F.count("*").alias("n")).collect()}
    assert kinds == {("missing_primary_key", 2000), ("duplicate_primary_key", 18_000)}
    assert df.count() == 20_000


@pytest.mark.parametrize("key, n", [("IF(id % 2 = 0, 'TXN-1', NULL)", 0), ("IF(id % 2 = 0 OR id = 1, 'TXN-1', NULL)", 100)])
def test_checks_of_keys_need_a_majority(spark, key, n):
    df = checks.check(ledger(spark, 100, key), CONTRACT)
    assert checks.error_table(df).count() == n and checks.check(ledger(spark, 0, key), CONTRACT).count() == 0


def test_what_is_stored_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f.getName() for f in (files.apply(k) for files in [disk.getAllFiles()] for k in range(files.size())) if f.getName().startswith("shuffle_")}
    before = names()
    kept = scratch.stored(spark.range(1000).repartition(3))
    for _ in range(50):
        if not names() - before:
            break
        time.sleep(0.2)
    assert not names() - before and kept.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_the_task_that_writes_one_file_sorts_nothing(spark, conf, tmp_path):
    from sparkwright.plans.queries import _ledger_file

    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc = spark.sparkContext
    n = 30_000
    (tmp_path / "in").mkdir()
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") * 1.5).alias("o_totalprice")).orderBy(F.xxhash64("o_orderkey")).write.parquet(str(tmp_path / "in/orders.parquet"))
    sc.setJobGroup("one file", "one file")
    try:
        _ledger_file(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    [file] = (tmp_path / "out").glob("*.txt")
    head, *lines = file.read_text().splitlines()
    assert head == "txn_id,debit_amt,dept" and [int(x.split(",")[0][4:]) for x in lines] == list(range(n))
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("one file") for s in sc.statusTracker().getJobInfo(j).stageIds}
    found = [(s.numTasks(), s.peakExecutionMemory()) for s in (sc._jsc.sc().statusStore().lastStageAttempt(k) for k in stages)]
    assert max(m for _, m in found) > 0 and all(m == 0 for tasks, m in found if tasks == 1)


def test_lines_of_one_file_may_be_empty(spark, tmp_path):
    sinks.one_text(spark.createDataFrame([("b",), ("",), ("a",)], "value string").orderBy("value"), str(tmp_path / "t"), "head")
    [file] = (tmp_path / "t").glob("*.txt")
    assert file.read_text() == "head\n\na\nb\n"


def test_ends_and_dates_are_as_the_patterns_say(spark):
    odd = [chr(i) for i in range(0x3100)] + ["﻿", "​"]
    d = spark.createDataFrame([(f"{c}a{c}b{c}",) for c in odd] + [("",), (" ",), (" \t\n",), (None,)], "t string")
    assert d.filter(~strings.stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    e = spark.createDataFrame([(f"{y}-{m:02d}-{x:02d}{end}",) for y in ("0000", "1900", "2000", "2023") for m in range(14) for x in range(33) for end in ("", "\n", " ")] + [("",), (None,), ("none",)], "t string")
    assert e.filter(~dates.is_date(F.col("t")).eqNullSafe(dates.parsed_date(F.col("t")).isNotNull())).count() == 0


def test_packed_files_of_a_run_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    """They are hashed whole, so a task with many rows writes several files."""
    monkeypatch.setattr(sinks, "FILE_ROWS", 3, raising=False)
    monkeypatch.setattr(sinks, "TEXT_ROWS", 2, raising=False)
    out = run(ledger(spark, 30, "CASE WHEN id < 20 THEN concat(' txn ', id) ELSE 'no' END").withColumn("row_uuid", F.lit("u")).coalesce(1), run_id="r4")
    sinks.write_run(out, str(tmp_path / "r4"))
    n = {name: [len(gzip.open(p, "rt").readlines()) for p in sorted((tmp_path / "r4" / name).glob("part-*.gz"))] for name in ("cleaned", "diff", "audit", "errors_json")}
    assert sum(n["audit"]) == out.changes.count() >= 20 and max(n["audit"]) == 3
    assert sum(k - 1 for k in n["cleaned"]) == 20 and max(n["cleaned"]) == 4 and max(n["diff"]) == 4  # with a header each
    assert sum(n["errors_json"]) == 10 and max(n["errors_json"]) == 2
    out.close()


def test_rows_of_one_run_are_stored_without_a_sort(spark, tmp_path):
    store, rows = str(tmp_path / "store"), lambda name, n: spark.range(n).select(F.concat(F.lit(name), "id").alias("event_id"), F.lit(name).alias("run_id"))
    kept = lambda: {r.run_id: r["count"] for r in spark.read.schema("event_id string, run_id string").parquet(store).groupBy("run_id").count().collect()}
    executions = spark._jsparkSession.sharedState().statusStore()
    for name, n in (("a/b=1", 50), ("two", 5), ("a/b=1", 7), ("two", 0)):
        before = executions.executionsCount()
        registry.replace(rows(name, n), store, name)
        plans = [executions.executionsList().apply(k).physicalPlanDescription() for k in range(before, executions.executionsCount())]
        assert plans and not any("Sort" in p for p in plans)
    assert kept() == {"a/b=1": 7}
    assert len([p for p in (tmp_path / "store").iterdir() if p.is_dir()]) == 1


def test_profiles_hold_the_most_frequent_values_from_one_shuffle_of_values(spark):
    values = ["b"] * 4 + ["a"] * 4 + ["c"] * 3 + [None] * 9 + ["f", "e", "d", "g"]
    df = spark.createDataFrame([(k, v, None) for k, v in enumerate(values)], "row_number long, v string, empty string").repartition(4)
    out = profiling.profile(df)
    rows = {r["column"]: r for r in out.collect()}
    assert [tuple(x) for x in rows["v"].most_common] == [("a", 4), ("b", 4), ("c", 3), ("d", 1), ("e", 1)]
    assert (rows["v"].non_null, rows["v"].nulls, rows["v"].distinct_values, rows["v"].data_type) == (15, 9, 7, "string")
    assert (rows["empty"].non_null, rows["empty"].nulls, rows["empty"].distinct_values, rows["empty"].data_type, rows["empty"].most_common) == (0, 24, 0, "empty", [])
    assert plan(out).count("Exchange hashpartitioning(column#") - plan(out).count("ReusedExchange") <= 3  # one of the values, two of a few rows for each column
    rough = {r["column"]: r for r in profiling.profile(df, exact=False).collect()}
    assert [x.n for x in rough["v"].most_common][:3] == [4, 4, 3] and all(x.value is not None for x in rough["v"].most_common) and rough["empty"].most_common == []


def test_error_details_hold_ids_whole_data_values_and_fixes(spark):
    errors = [(1010, "Date", None, "required_field", "Required field 'Date' is empty"), (1011, "A b", 'x"\n', "type_mismatch", "bad")]
    changes = [(100, "Date", None, "", "date_normalization", "Normalized"), (10_000, "A b", "x", 'x"\n', "cache", "Mapped to canonical value")]
    row = ("u1", 7, None, 'x"\n', errors, changes, "validation_failure", "parse_error")
    df = spark.createDataFrame([row], f"row_uuid string, row_number long, Date string, `A b` string, __errors {checks.ERROR}, __changes {CHANGE}, error_category string, validator_category string")
    got = [json.loads(r.detail) for r in sinks.errors_json(df).collect()]
    assert got == [{
        "row_uuid": "u1", "row_number": 7, "error_category": "validation_failure", "messages": ["Required field 'Date' is empty", "bad"], "data": {"Date": None, "A b": 'x"\n'},
        "errors": [{"column": "Date", "value": None, "type": "required_field", "message": "Required field 'Date' is empty"}, {"column": "A b", "value": 'x"\n', "type": "type_mismatch", "message": "bad"}],
        "fixes": [
            {"column": "Date", "before_value": None, "after_value": "", "source": "rule", "confidence": 1.0, "reason": "Normalized"},
            {"column": "A b", "before_value": "x", "after_value": 'x"\n', "source": "cache", "confidence": 0.9, "reason": "Mapped to canonical value"},
        ],
    }]
    assert json.loads(sinks.errors_json(df.drop("__changes")).first().detail)["fixes"] == []
