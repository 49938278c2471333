"""Whole runs on small ledgers: files, rules, mapping, checks, reports, sinks, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkwright.contract import DECIMAL, ColumnSpec, RunOptions, TableContract, ledger_contract
from sparkwright.operators import checks, profiling, registry, residual
from sparkwright.operators.rules import apply_rules, change_log
from sparkwright.plans.fixture import messy_ledger, strict_contract
from sparkwright.plans.ledger import run
from sparkwright.sources import sinks, tabular
from sparkwright.streaming.runs import watch

CSV = """Txn Id,date,Account Name,Description,Debit Amt,Credit Amt,Dept,Ref No,User
TXN001,01/16/2024,cash,"Paid, twice  ",1500,,SALES,ref1,john
txn_2,2024.01.17,Freight expense,Ø fee!!,,"1,250.00",Tech Support,REF_2,mary
3,NULL,A/R,plain,(20),,hr,PENDING,
DUPLICATE,2024-02-30,Petty Cash,x,abc,,OPS,inv_4,zoe
,15-Jan-2024,COGS,,7,,  Human   Resources ,REF-5,ann
"""


@pytest.fixture()
def path(tmp_path):
    (tmp_path / "ledger.csv").write_text("﻿" + CSV, encoding="utf-8")
    return str(tmp_path / "ledger.csv")


def test_read(spark, path):
    df = tabular.read_table(spark, path)
    assert df.columns == ["row_uuid", "row_number", "Transaction ID", "Date", "Account Name", "Description", "Debit Amount", "Credit Amount", "Department", "Reference Number", "Created By"]
    rows = df.orderBy("row_number").collect()
    assert [r.row_number for r in rows] == [1, 2, 3, 4, 5]
    assert rows[1]["Credit Amount"] == "1,250.00" and rows[2].Date is None and rows[0].Description.startswith("Paid, twice") and rows[4]["Transaction ID"] is None
    assert len({r.row_uuid for r in rows}) == 5 and len(rows[0].row_uuid) == 36
    with pytest.raises(ValueError):
        tabular.read_table(spark, path, options=RunOptions(row_limit=4))


def test_read_other_encodings_and_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Name;Betrag\nMüller;1,5\nÖztürk;2,5\n".encode("latin-1"))
    assert [tuple(r)[2:] for r in tabular.read_table(spark, str(tmp_path / "a.csv")).orderBy("row_number").collect()] == [("Müller", "1,5"), ("Öztürk", "2,5")]
    assert tabular.delimiter_of(["a|b|c", "1|2|3"]) == "|" and tabular.delimiter_of(["abc", "def"]) == "," and tabular.delimiter_of(["a;b,c", "1;2,3"]) == ","
    content = b"A,B\n1,2\n"
    assert tabular.read_bytes(spark, content).count() == 1
    with pytest.raises(ValueError):
        tabular.read_bytes(spark, content, options=RunOptions(byte_limit=3))


def test_headers():
    assert tabular.normalized_header('"txn_id"') == "Transaction ID" and tabular.normalized_header("created date") == "Created By" and tabular.normalized_header("some-column name") == "Some Column Name"
    assert tabular.normalized_header("Abt", {"abt": "department"}) == "department"
    assert tabular.mapped_header("tbl_Dept Name_col", {"dept_name": "Department"}) == "Department"
    assert tabular.missing_headers(["a"], TableContract((ColumnSpec("A", required=True), ColumnSpec("B", required=True)))) == ["B"]


def test_run(spark, path):
    out = run(path, spark=spark)
    rows = {r.row_number: r for r in out.ruled.collect()}
    assert [rows[k]["Transaction ID"] for k in (1, 2, 3, 4)] == ["TXN-001", "TXN-002", "TXN-003", "DUPLICATE"]
    assert [rows[k]["Department"] for k in (1, 2, 3, 4, 5)] == ["Sales", "Tech Support", "HR", "Operations", "HR"]
    assert [rows[k]["Account Name"] for k in (1, 2, 3, 4, 5)] == ["Cash", "Freight Expense", "Accounts Receivable", "Petty Cash", "Cogs"]
    assert (rows[3]["Debit Amount"], rows[3]["Credit Amount"]) == ("", "20.00") and rows[4]["Debit Amount"] == "0.00"
    assert rows[2]["Description"] == "fee" and rows[2]["Reference Number"] == "REF-2" and rows[4]["Reference Number"] == "INV-4"
    assert {r.row_number for r in out.valid.collect()} == {1, 2}
    kinds = {(r.row_number, r.error_type) for r in out.errors.collect()}
    assert kinds == {(3, "type_mismatch"), (4, "type_mismatch"), (4, "transaction_id_format"), (4, "missing_primary_key"), (5, "missing_primary_key")}
    assert out.metrics.first().quarantined_rows == 3
    out.close()


def test_mapping_dictionary_and_mapper(spark, path):
    asked = spark.sparkContext.accumulator(0)

    def mapper(column, values, names):
        asked.add(len(values))
        return {v: "IT" if "Tech" in v else "Operating Expenses" if "Freight" in v else "nonsense" for v in values}

    dictionary = spark.sql("SELECT 'Account Name' AS column_name, 'Petty Cash' AS variant_value, 'm' AS model_id, 'Cash' AS canonical_value, 0.95D AS confidence, DATE '2024-01-01' AS created_at, true AS is_approved, 0L AS use_count")
    out = run(path, spark=spark, mapper=mapper, dictionary=dictionary, options=RunOptions(edit_cap_pct=90))
    rows = {r.row_number: r for r in out.checked.collect()}
    assert rows[2].Department == "IT" and rows[2]["Account Name"] == "Operating Expenses" and rows[4]["Account Name"] == "Cash" and rows[5]["Account Name"] == "Cogs"
    assert {(r["column"], r.source) for r in out.changes.filter("ord >= 10000").collect()} == {("Department", "mapper"), ("Account Name", "mapper"), ("Account Name", "cache")}
    capped = run(path, spark=spark, mapper=mapper, options=RunOptions(edit_cap_pct=50))
    assert {r.Department for r in capped.checked.collect()} >= {"IT"} and "Freight Expense" in {r["Account Name"] for r in capped.checked.collect()}
    dry = run(path, spark=spark, mapper=mapper, options=RunOptions(edit_cap_pct=90, dry_run=True))
    assert "Tech Support" in {r.Department for r in dry.checked.collect()} and asked.value > 0


def test_replay_of_the_log_gives_the_output(spark):
    before = messy_ledger(spark, "/root/testdata/sf0.001")
    after = apply_rules(before, ledger_contract(), log_all_numbers=True)
    cells = {(r.row_number, c): r[c] for r in before.collect() for c in profiling.data_columns(before)}
    for r in sorted(change_log(after).collect(), key=lambda r: (r.row_number, r.ord)):
        assert (cells[r.row_number, r["column"]] or "") == (r.before or "")
        cells[r.row_number, r["column"]] = r.after
    assert cells == {(r.row_number, c): r[c] for r in after.collect() for c in profiling.data_columns(before)}


def test_a_second_pass_changes_nothing(spark):
    columns = ("Transaction ID", "Date", "Account Code", "Department", "Reference Number", "Created By", "Description")
    once = apply_rules(messy_ledger(spark, "/root/testdata/sf0.001"), ledger_contract()).drop("__changes")
    assert change_log(apply_rules(once, ledger_contract())).filter(F.col("column").isin(*columns)).count() == 0


def test_order_of_rows_does_not_matter(spark):
    df = messy_ledger(spark, "/root/testdata/sf0.001")
    rows = df.collect()
    random.Random(3).shuffle(rows)
    shuffled = spark.createDataFrame(rows, df.schema)
    key = lambda x: sorted(map(str, checks.error_table(checks.check(apply_rules(x, ledger_contract()), strict_contract())).collect()))
    assert key(df) == key(shuffled)


def test_clean_and_quarantined_rows_make_up_the_input(spark):
    df = checks.check(apply_rules(messy_ledger(spark, "/root/testdata/sf0.001"), ledger_contract()), strict_contract())
    good, bad = ({r.row_number for r in x.select("row_number").collect()} for x in (checks.valid_rows(df), checks.quarantined_rows(df)))
    assert not good & bad and len(good) + len(bad) == 1500


def test_extra_checks(spark):
    contract = TableContract((ColumnSpec("Amount", DECIMAL, min_value="0", max_value="10"), ColumnSpec("Key")), unique=(("Key",),))
    df = spark.createDataFrame([(1, "5", "a"), (2, "-1", "b"), (3, "11", "b")], "row_number long, Amount string, Key string")
    kinds = {(r.row_number, r.error_type) for r in checks.error_table(checks.check(df, contract, extra=True)).collect()}
    assert kinds == {(2, "range_violation"), (3, "range_violation"), (2, "unique_violation"), (3, "unique_violation")}
    assert checks.error_table(checks.check(df, contract)).count() == 0


def test_empty_table(spark):
    df = messy_ledger(spark, "/root/testdata/sf0.001").limit(0)
    out = run(df)
    assert out.valid.count() == out.quarantined.count() == out.changes.count() == 0 and out.metrics.first().quarantine_rate == 0.0


def test_contracts():
    with pytest.raises(ValueError):
        TableContract((ColumnSpec("a"), ColumnSpec("a")))
    field = ColumnSpec("a", DECIMAL, required=True, enum=("x",)).field()
    assert not field.nullable and field.metadata["enum"] == ["x"]
    assert residual.Mapper and ledger_contract().canonical("department")[0] == "Sales"


def test_inferred_contract(spark):
    rows = [(k, f"REF-{k}", str(k * 1.5), "Sales" if k % 2 else "HR", f"2024-01-{k % 28 + 1:02d}", "yes" if k % 3 else "no") for k in range(60)]
    df = spark.createDataFrame(rows, "row_number long, `Ref Number` string, `Debit Amount` string, Department string, Date string, Flag string")
    c = {x.name: x for x in profiling.inferred_contract(df).columns}
    assert c["Ref Number"].pattern == r"^REF-?\d+$" and c["Ref Number"].primary_key and c["Debit Amount"].type == "decimal" and c["Date"].type == "date" and c["Flag"].type == "boolean"
    assert c["Department"].enum == ("HR", "Sales")


def test_artifacts(spark, path, tmp_path):
    out = run(path, spark=spark, run_id="r1")
    index = sinks.write_run(out, str(tmp_path / "out"))
    assert index.count() >= 8
    metrics = json.loads((tmp_path / "out/metrics.json").read_text())
    assert metrics["total_rows"] == 5 and "Run summary" in (tmp_path / "out/summary.md").read_text()
    assert spark.read.option("header", True).csv(str(tmp_path / "out/errors")).count() == 3
    audit = spark.read.json(str(tmp_path / "out/audit"))
    assert audit.count() == out.changes.count() and audit.select("event_id").distinct().count() == audit.count()
    assert sinks.media_type("a.md") == "text/markdown" and sinks.media_type("a") == "application/octet-stream"
    out.close()


def test_watched_folder_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "one.csv").write_text(CSV)
    args = (spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    watch(*args).awaitTermination()
    assert (tmp_path / "out/one/metrics.json").exists()
    first = (tmp_path / "out/one/metrics.json").stat().st_mtime_ns
    (inbox / "two.csv").write_text(CSV)
    watch(*args).awaitTermination()
    assert (tmp_path / "out/two/metrics.json").exists() and (tmp_path / "out/one/metrics.json").stat().st_mtime_ns == first


def test_artifacts_are_registered_listed_and_fetched(spark, path, tmp_path):
    store, out = str(tmp_path / "index"), run(path, spark=spark, run_id="r2")
    sinks.write_run(out, str(tmp_path / "r2"), store=store)
    out.close()
    index = spark.read.schema(registry.ARTIFACT).parquet(store)
    rows = registry.list_artifacts(index, "r2").collect()
    assert {r.type for r in rows} >= {"cleaned", "errors", "diff", "audit", "metrics", "manifest", "summary", "input"}
    assert {r.type: r.row_count for r in rows}["errors"] == 3 and registry.list_artifacts(index, "other").count() == 0
    one = registry.get_artifact(index, rows[0].artifact_id).collect()
    assert len(one) == 1 and one[0].storage_path == rows[0].storage_path and registry.get_artifact(index, "none").count() == 0
    assert (tmp_path / "r2/input/ledger.csv").read_bytes() == open(path, "rb").read()
    assert spark.read.parquet(store + "-audit").count() == spark.read.json(str(tmp_path / "r2/audit")).count()
    text = (tmp_path / "r2/summary.md").read_text()
    assert all(f"## {x}" in text for x in ("Changes by rule", "Quarantined rows by category", "Most frequent messages", "Columns with most errors", "Files and their bytes"))


def test_contracts_are_stored_and_loaded(spark, tmp_path):
    store = str(tmp_path / "contracts")
    for name, contract in (("a", strict_contract()), ("b", ledger_contract())):
        registry.store_contract(spark, store, name, contract)
    assert registry.load_contract(spark, store, "a", "1.0.0") == strict_contract() and registry.load_contract(spark, store, "a", "2") is None
    assert [r.name for r in registry.list_schemas(spark.read.schema(registry.SCHEMA).parquet(store)).collect()] == ["a", "b"]


def test_guards(spark, path):
    assert "experimental" in RunOptions(use_inferred=True).problem() and RunOptions(use_inferred=True, acknowledge_experimental=True).problem() is None
    assert "forced" not in (RunOptions().problem() or "") and "Vendor" in RunOptions(map_columns=("Vendor",)).problem() and RunOptions(map_columns=("Vendor",), force_map_columns=True).problem() is None
    with pytest.raises(ValueError):
        run(path, spark=spark, options=RunOptions(use_inferred=True))


def test_files_are_cut_unless_values_hold_line_breaks(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n" + "x,\"y, z\"\n" * 5)
    (tmp_path / "broken.csv").write_text('a,b\n1,"two\nlines"\n2,three\n')
    assert not tabular.shape_of(spark, str(tmp_path / "plain.csv")).broken_lines and tabular.shape_of(spark, str(tmp_path / "broken.csv")).broken_lines
    assert [r.B for r in tabular.read_table(spark, str(tmp_path / "broken.csv")).orderBy("row_number").collect()] == ["two\nlines", "three"]
    assert tabular.read_table(spark, str(tmp_path / "plain.csv")).count() == 5
    out = tabular.ingest(spark, str(tmp_path / "plain.csv"))
    assert out.headers == {"a": "A", "b": "B"} and len(out.fingerprint) == 64 and out.table.count() == 5


def test_plans_read_the_table_twice_at_most(spark):
    from sparkwright.plans import queries

    for name in ("split_valid", "ledger_run", "planner_summary"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan") <= 2, name


def test_answers_keep_to_their_contract(spark):
    texts = ['[{"value":"x","mapped":"Sales","confidence":0.9,"reason":"r"},{"value":"y","mapped":null,"confidence":0,"reason":"r"}]', '[{"value":"x","mapped":"Sales","confidence":1.2,"reason":"r"}]', '[{"value":"x","mapped":"Moon","confidence":0.5,"reason":"r"}]', "no json", None, '{"value":"x"}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    kept = df.select("k", residual.checked_answers(F.col("t"), ("Sales", "IT")).alias("x")).orderBy("k").collect()
    assert [len(r.x) for r in kept] == [2, 0, 0, 0, 0, 0]


def test_a_run_keeps_one_compressed_table_and_writes_compressed_ones(spark, path, tmp_path):
    from pathlib import Path

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = run(path, spark=spark, run_id="r3")
    sinks.write_run(out, str(tmp_path / "r3"), store=str(tmp_path / "index3"))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before and len(out.kept) == 1
    stored = Path(out.kept[0].removeprefix("file:"))
    assert stored.exists()
    for name in ("cleaned", "errors", "errors_json", "diff", "audit"):
        parts = [p.name for p in (tmp_path / "r3" / name).iterdir() if p.name.startswith("part-")]
        assert parts and all(p.endswith(".gz") for p in parts)
    kinds = {r.mime_type for r in spark.read.parquet(str(tmp_path / "index3")).filter("type in ('errors', 'diff', 'cleaned')").collect()}
    assert kinds == {"text/csv"} and sinks.media_type("a.csv.gz") == "text/csv"
    diff = [r.row_number for r in spark.read.option("header", True).csv(str(tmp_path / "r3/diff")).coalesce(1).collect()]
    assert len(diff) == out.changes.count()
    out.close()
    assert not stored.exists()


def test_tasks_of_rules_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tabular, "TASK_ROWS", 100)
    spark.range(2000).selectExpr("id AS o_orderkey", "id AS o_custkey", "timestamp'1995-01-01' AS o_orderdate", "1.5D AS o_totalprice", "'5-LOW' AS o_orderpriority").repartition(6).write.parquet(str(tmp_path / "orders.parquet"))
    held = messy_ledger(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 2000 and max(r["count"] for r in held) <= 110


def test_reports_of_rows_make_no_second_pass(spark):
    from sparkwright.plans import queries

    for name in ("sink_errors", "join_attempted_fixes", "set_minus_rows", "run_metrics"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        df.collect()
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") <= 2, name


def test_a_replaced_run_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(10, numPartitions=2).mapInArrow(told, "id long").withColumn("run_id", F.lit("x"))
    registry.replace(rows, str(tmp_path / "s"), "x")
    assert made.value == 10 and spark.read.parquet(str(tmp_path / "s")).count() == 10
    registry.replace(rows.filter("id < 0"), str(tmp_path / "s"), "x")
    assert not (tmp_path / "s/run_id=x").exists()
