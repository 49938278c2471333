"""Ordinals, quoted files, hashes, stores, merged profiles, versions, runs as a stream."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkwright.operators import profiles, registry, versions
from sparkwright.sources import hashing, headers, quoted, scratch, sinks, tabular
from sparkwright.streaming import heartbeats
from sparkwright.streaming.runs import run_name


@pytest.mark.parametrize("partitions", [8, 200])
def test_places_of_sorted_rows(spark, partitions):
    """One wide column and skewed keys: places are 1..n, each once and in order."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        n = 200_000
        rows = spark.range(n).select((F.xxhash64("id") % 1000).alias("k"), F.col("id"), F.when(F.col("id") % 50 == 0, F.repeat(F.lit("wide "), 100)).alias("text"))
        out = tabular.placed(rows, "place", by=("k", "id"))
        facts = out.agg(F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b")).first()
        assert tuple(facts) == (n, n, 1, n)
        wrong = out.alias("x").join(out.alias("y"), F.expr("y.place = x.place + 1")).filter("y.k < x.k or (y.k = x.k and y.id <= x.id)")
        assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_input_of_places_runs_once(spark):
    """Counted by a task that leaves a mark for each row it makes."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000, numPartitions=3).mapInArrow(run, "id long")
    out = tabular.placed(rows, "place", by=(F.desc("id"),))
    assert {(r.id, r.place) for r in out.collect()} == {(i, 1000 - i) for i in range(1000)} and out.count() == 1000
    assert seen.value == 1000


def test_odd_names_and_no_rows_keep_their_places(spark):
    df = spark.createDataFrame([(1, "x")], "`a b` int, `c,;{}()=` string")
    assert tabular.placed(df, "n").columns == ["a b", "c,;{}()=", "n"]
    assert tabular.placed(df.limit(0), "n").count() == 0


def test_lenient_numbers_have_no_gaps(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text("a,b\n" + "".join(f"{k}{i},x{',y' if i in (3, 7) else ''}\n" for i in range(10)))
    rows = tabular.read_table(spark, str(tmp_path), lenient=True).select("row_number", "A").orderBy("row_number").collect()
    assert [r.row_number for r in rows] == list(range(1, 25)) and [r.A for r in rows] == [f"{k}{i}" for k in range(3) for i in range(10) if i not in (3, 7)]


def test_quoted_files_are_cut_and_read_as_one_task_would(spark, tmp_path):
    rng = random.Random(4)
    for f in range(2):
        out = ["k,v,w"]
        for i in range(400):
            value = "".join(rng.choice('ab ,;"\n') for _ in range(rng.randint(0, 12)))
            out.append(f'{f}-{i},"' + value.replace('"', '""') + f'",{"plain" if i % 3 else ""}')
        (tmp_path / f"f{f}.csv").write_text("\n".join(out) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).csv(str(tmp_path))
    want = sorted(map(tuple, want.collect()), key=str)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert quoted._lines(spark, str(tmp_path), "UTF-8").rdd.getNumPartitions() > 8
        got, names = quoted.read_quoted(spark, str(tmp_path), ",")
        rows = got.orderBy("row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert names == ["k", "v", "w"] and [r.row_number for r in rows] == list(range(1, 801))
    assert [r.c0 for r in rows] == [f"{f}-{i}" for f in range(2) for i in range(400)]
    assert sorted(((r.c0, r.c1, r.c2) for r in rows), key=str) == want


@pytest.mark.parametrize("line, inside, out", [('a,"b', False, True), ('a,"b"', False, False), ('b"",c', True, True), ('b",c', True, False), ('x"y,z', False, False), ('a, "b', False, True), ("", True, True), ('"";"', False, False), ('"a"b,"c', False, True)])
def test_ends_inside(line, inside, out):
    assert quoted.ends_inside(line, ",", inside) is out


def test_hashes_by_chunks(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    files = {"a.bin": rng.randbytes(300_000), "b.bin": b"\n" * 5000, "c.bin": b"no end", "d.txt": b"line\n" * 10_000, "e.gz": b"not packed at all", "f.bin": b""}
    (tmp_path / "in").mkdir()
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    monkeypatch.setattr(hashing, "CHUNK_BYTES", 1 << 12)
    for whole in (1000, 1 << 20):
        got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in hashing.fingerprints(spark, str(tmp_path / "in"), whole=whole).collect()}
        assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items() if c}


def test_a_store_holds_a_run_once(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = lambda n, run: spark.createDataFrame([(f"e{i}", run) for i in range(n)], "event_id string, run_id string")
    read = lambda: sorted((r.run_id, r.event_id) for r in spark.read.schema("event_id string, run_id string").parquet(store).collect())
    registry.replace(rows(3, "a b/1"), store, "a b/1")
    registry.replace(rows(2, "007"), store, "007")
    registry.replace(rows(2, "a b/1"), store, "a b/1")
    assert read() == [("007", "e0"), ("007", "e1"), ("a b/1", "e0"), ("a b/1", "e1")]
    registry.replace(rows(0, "007"), store, "007")
    assert read() == [("a b/1", "e0"), ("a b/1", "e1")]


def test_scratch_is_released_from_a_mark(spark):
    first = scratch.stored(spark.range(3))
    since = scratch.mark()
    second = scratch.stored(spark.range(4))
    assert second.count() == 4 and scratch.release(spark, since) == 1 and first.count() == 3


def test_profiles_of_two_halves_equal_the_whole(spark, tmp_path):
    rows = [(i, str(i % 7) if i % 11 else None, f"name {i}", "x" if i < 500 else f"y{i % 60}", None, str(i / 4)) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "row_number long, few string, all string, more string, none string, number string")
    whole = profiles.states(df)
    halves = str(tmp_path / "states")
    for part, test in (("one", "row_number <= 500"), ("two", "row_number > 500"), ("two", "row_number > 500")):
        profiles.update(profiles.states(df.filter(test)), halves, part)
    both = profiles.merged(spark.read.parquet(halves))
    exact = lambda s: {tuple(map(str, r)) for r in profiles.facts(s).drop("about_distinct").collect()}
    assert exact(whole) == exact(both)
    facts = {r["column"]: r for r in profiles.facts(both).collect()}
    assert facts["few"].n_distinct == 7 and facts["few"].enum == list("0123456") and not facts["few"].required
    assert facts["all"].n_distinct is None and abs(facts["all"].about_distinct - 1000) < 50 and facts["all"].enum is None
    assert facts["more"].n_distinct == 61 and facts["number"].data_type == "decimal" and facts["none"].n_values == 0 and facts["none"].n_distinct == 0
    top = {(r["column"], r.value): r.n for r in profiles.frequent(both, 1).collect()}
    assert top["more", "x"] == 499 or abs(top["more", "x"] - 499) <= 1000 / (0.75 * profiles.ITEMS)
    assert {r["column"] for r in profiles.unique_columns(df, whole).collect()} == {"all", "number"}


def test_versions_are_read_without_an_exchange(spark, tmp_path):
    store = versions.VersionStore(spark, "versions_under_test", 4, str(tmp_path))
    kind = "column_name string, variant_value string, model_id string, canonical_value string, confidence double, created_at date"
    row = lambda v, c, day: ("Department", v, "m", c, 0.9, day)
    import datetime

    day = datetime.date(2024, 1, 1)
    try:
        store.append(spark.createDataFrame([row(f"v{i}", f"c{i % 3}", day) for i in range(50)], kind))
        store.append(spark.createDataFrame([row("v1", "new", day + datetime.timedelta(1)), row("v2", "old", day - datetime.timedelta(1))], kind))
        for _ in range(2):
            now = {r.variant_value: r.canonical_value for r in store.current().collect()}
            assert len(now) == 50 and now["v1"] == "new" and now["v2"] == "c2"
            plan = store.current()._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan.replace("BroadcastExchange", "")
            store.compact()
        assert spark.table(store.table).count() == 50
        values = spark.createDataFrame([("Department", "v1"), ("Department", "none")], "column string, value string")
        assert [(r.value, r.mapped) for r in store.lookup(values).collect()] == [("v1", "new")]
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = store.lookup(values)._jdf.queryExecution().sparkPlan().toString()
        physical = store.lookup(values)._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "SortMergeJoin" in plan and physical.count("Exchange") == 1  # of the values
    finally:
        store.drop()


def test_missing_headers_of_files_and_mapped_names(spark):
    names = spark.createDataFrame([("GL-Account_col",), ("tbl_Cost  Centre",), ("fld_other",), (None,)], "name string")
    assert [r.m for r in names.select(headers.mapped_headers(F.col("name")).alias("m")).collect()] == ["Account Code", "Department", "fld_other", None]


def test_runs_as_a_stream(spark, tmp_path):
    """Two micro-batches and one that moves the clock; each outcome comes once."""
    base = str(tmp_path)
    parts = (
        [("a", "00:00:00", "started", "w1"), ("a", "00:01:00", "heartbeat", "w1"), ("b", "00:00:30", "started", "w2"), ("a", "00:02:00", "progress", "w1"), ("a", "00:02:30", "heartbeat", "other"), (None, "00:01:00", "started", "w")],
        [("b", "00:03:00", "completed", "w2"), ("c", "01:00:00", "started", "w3")],
        [("c", "01:00:10", "completed", "w3"), ("c", "01:00:20", "completed", "w3"), ("z", "02:00:00", "started", "w9")],
    )
    stream = spark.readStream.schema(heartbeats.EVENT).parquet(f"{base}/in/*")
    for k, part in enumerate(parts):
        rows = [(r, f"2024-01-01 {t}", kind, w, "rules" if kind == "progress" else None, 50 if kind == "progress" else None, "succeeded" if kind == "completed" else None) for r, t, kind, w in part]
        df = spark.createDataFrame(rows, "run_id string, at string, kind string, worker_id string, phase string, percent int, status string")
        df.withColumn("at", F.col("at").cast("timestamp")).write.parquet(f"{base}/in/{k}")
        heartbeats.track(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = spark.read.schema(heartbeats.OUTCOME).parquet(f"{base}/out").select("run_id", "outcome", F.col("at").cast("string"), "worker_id", "phase", "percent", "n_events").collect()
    assert sorted(map(tuple, out)) == [
        ("a", "timed_out", "2024-01-01 00:07:00", "w1", "rules", 50, 3), ("b", "succeeded", "2024-01-01 00:03:00", "w2", None, None, 2), ("c", "succeeded", "2024-01-01 01:00:10", "w3", None, None, 2),
    ]


def test_files_of_one_name_are_runs_of_their_own():
    assert run_name("file:/data/inbox/a/x.csv", "/data/inbox") == "a-x" and run_name("file:/data/inbox/x.csv", "/data/inbox/") == "x"
