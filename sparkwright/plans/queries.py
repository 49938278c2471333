"""One query for each operator, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwright.contract import RunOptions, ledger_contract
from sparkwright.functions import amounts, dates, identifiers
from sparkwright.operators import checks, lateral, mapping, patches, profiles, profiling, registry, reports, residual, versions
from sparkwright.operators.rules import DEPARTMENTS, apply_rules, change_log, rules_summary
from sparkwright.plans import ledger, oracle
from sparkwright.plans.fixture import COLUMNS, messy_ledger, strict_contract
from sparkwright.plans.oracle import CATEGORY, ERRORS, LOG, MAPPED, RESIDUAL, STAGES, with_
from sparkwright.sources import headers, sinks, tabular
from sparkwright.sources.scratch import brief_shuffles, stored
from sparkwright.streaming import heartbeats, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
N = oracle.N
SHORT = {v: k for k, v in COLUMNS.items()}
MAP_COLUMNS = ("Department", "Account Name")
LAST = f"s{N}"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(messy_ledger(spark, sf_dir), ledger_contract())


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check(_ruled(spark, sf_dir), strict_contract())


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.error_table(_checked(spark, sf_dir))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_log(_ruled(spark, sf_dir))


def _short(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(SHORT.get(c, c)) for c in df.columns])


# --- sources ----------------------------------------------------------------

@query("WITH f AS (" + oracle.SQL.format(orders="orders") + "), h AS (SELECT row_number, sha256(concat_ws('|', " + ", ".join(f"coalesce({c}, 'nan')" for c in COLUMNS) + ")) AS h FROM f) SELECT row_number, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS row_uuid FROM h")
def row_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy_ledger(spark, sf_dir).select("row_number", "row_uuid")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, o_orderkey::BIGINT AS key FROM orders")
def row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("key"))
    return tabular.placed(orders, "row_number", by=("key",)).select("row_number", "key")


def _csv(spark: SparkSession, sf_dir: str) -> str:
    path = f"{sinks.scratch(spark)}/ledger_csv"
    messy_ledger(spark, sf_dir).drop("row_uuid", "row_number").write.option("header", True).csv(path)
    return path


_READ = with_("f AS (" + oracle.SQL.format(orders="orders") + ")") + "SELECT " + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in COLUMNS) + " FROM f"


@query(_READ)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file written and read again: its writer trims values.  The order of rows,
    and so their numbers, is the writer's."""
    return _short(tabular.read_table(spark, _csv(spark, sf_dir), ledger_contract())).drop("row_uuid", "row_number")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, o_orderkey::VARCHAR AS key, o_orderpriority AS priority FROM orders WHERE o_orderkey % 7 <> 0")
def scan_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files; every seventh key's line has a value too many and is dropped,
    and the lines that are left have numbers without gaps."""
    path = f"{sinks.scratch(spark)}/lines"
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "more"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    o.select(F.when(first, F.concat(F.lit("key,priority\n"), line)).otherwise(line).alias("value")).write.text(path)
    return tabular.read_table(spark, path, lenient=True).select("row_number", F.col("Key").alias("key"), F.col("Priority").alias("priority"))


_SUPPLIERS = "SELECT row_number() OVER (ORDER BY s_suppkey) AS row_number, s_suppkey::VARCHAR AS key, s_name AS name FROM supplier"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("txn_id"), F.col("s_name").alias("user"))


def _read_back(df: DataFrame) -> DataFrame:
    return df.select("row_number", F.col("Transaction ID").alias("key"), F.col("Created By").alias("name"))


@query(_SUPPLIERS)
def scan_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file, in its own order."""
    path = f"{sinks.scratch(spark)}/one"
    _suppliers(spark, sf_dir).orderBy(F.col("txn_id")).coalesce(1).write.option("header", True).option("sep", "|").csv(path)
    return _read_back(tabular.read_table(spark, path))


@query(_SUPPLIERS.replace("row_number() OVER (ORDER BY s_suppkey) AS row_number, ", ""))
def scan_object_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files by a pattern, through Hadoop's file systems."""
    path = f"{sinks.scratch(spark)}/many"
    _suppliers(spark, sf_dir).repartition(3).write.option("header", True).csv(path)
    return _read_back(tabular.read_table(spark, f"{path}/*.csv")).drop("row_number")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS row_number, n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def scan_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows, an upload
    content = "txn_id,user\n" + "".join(f"{r.n_nationkey},{r.n_name}\n" for r in nations)
    return _read_back(tabular.read_bytes(spark, content.encode()))


@query(r"""WITH d AS (SELECT coalesce(lang, 'none') AS lang, bool_or(regexp_matches(coalesce(text, ''), '[\x{80}-\x{ff}]')) AS beyond FROM documents GROUP BY 1)
    SELECT lang, w AS written, CASE WHEN w = 'ISO-8859-1' AND beyond THEN w ELSE 'UTF-8' END AS encoding FROM d, (SELECT unnest(['UTF-8', 'ISO-8859-1']) AS w)""")
def detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, written in two encodings, and what their files show."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ").alias("line"))
    out = None
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = f"{sinks.scratch(spark)}/{encoding}"
        d.write.partitionBy("lang").option("encoding", encoding).csv(path)
        found = tabular.encodings(spark, path).select(F.regexp_extract("file", "/lang=([^/]*)/", 1).alias("lang"), F.lit(encoding).alias("written"), "encoding")
        found = found.groupBy("lang", "written").agg(F.min("encoding").alias("encoding"))  # one file in another encoding decides
        out = found if out is None else out.unionByName(found)
    return out


_HEADERS = """SELECT cast(p_partkey AS BIGINT) AS id, cast(p_size AS BIGINT) AS file, CASE cast(p_partkey % 9 AS INT) WHEN 0 THEN 'txn_id' WHEN 1 THEN 'Acct-Code' WHEN 2 THEN '"Ref  No"' WHEN 3 THEN 'tbl_created_by_col'
    WHEN 4 THEN 'DATE' WHEN 5 THEN 'fld_gl-account' WHEN 6 THEN 'cost centre' WHEN 7 THEN 'Department' ELSE concat('"', replace(lower(p_name), ' ', '_'), '-', p_brand, '"') END AS name FROM {part}"""


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HEADERS, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


_H = "h AS (" + _HEADERS.format(part="part") + ")"
_SYNONYMS = "MAP {" + ", ".join(f"'{k.lower()}': '{v}'" for k, v in tabular.HEADER_SYNONYMS.items()) + "}"
_DICTIONARY = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in headers.HEADER_DICTIONARY.items()) + "}"


@query(with_(_H) + rf"""SELECT id, coalesce({_SYNONYMS}[lower(w)], w) AS header FROM (SELECT id, array_to_string(list_transform(string_split(trim(regexp_replace(translate(trim(name, chr(34)), '_-', '  '), '\s+', ' ', 'g')), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS w FROM h)""")
def normalize_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("id", headers.normalized_headers(F.col("name")).alias("header"))


@query(with_(_H) + rf"""SELECT id, coalesce({_DICTIONARY}[k], name) AS header FROM (SELECT id, name, regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[\s-]+', '_', 'g'), '^(tbl_|col_|fld_)', ''), '(_col|_fld|_field)$', '') AS k FROM h)""")
def map_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("id", headers.mapped_headers(F.col("name")).alias("header"))


_REQUIRED = "r AS (SELECT unnest(['Date', 'Account Name', 'Department', 'Created By']) AS missing)"


@query(with_(_H, _REQUIRED) + "SELECT f.file, missing FROM (SELECT DISTINCT file FROM h) f, r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.file = f.file AND lower(trim(h.name)) = lower(missing))")
def check_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required columns that each file does not have, in any case."""
    return headers.missing_by_file(_headers(spark, sf_dir).select("file", F.col("name").alias("header")), strict_contract())


@query(with_(_H, _REQUIRED) + "SELECT f.file, missing FROM (SELECT DISTINCT file FROM h) f, r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.file = f.file AND h.name = missing)")
def set_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set difference, by the very names."""
    return headers.missing_by_file(_headers(spark, sf_dir).select("file", F.col("name").alias("header")), strict_contract(), fold_case=False)


def _refused(f: Callable[[], object]) -> bool:
    try:
        f()
    except ValueError:
        return True
    return False


@query("SELECT unnest([24, 25]) AS row_limit, unnest([true, false]) AS refused")
def row_limit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.scratch(spark)}/nations"
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.option("header", True).csv(path)
    return spark.createDataFrame([(n, _refused(lambda: tabular.read_table(spark, path, options=RunOptions(row_limit=n)))) for n in (24, 25)], "row_limit int, refused boolean")  # noqa: B023


def _by_priority(spark: SparkSession, sf_dir: str) -> str:
    """A file of order lines for each priority, in the order of the keys."""
    path = f"{sinks.scratch(spark)}/priorities"
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), "o_orderpriority", F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("value"))
    o.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "k").select("o_orderpriority", "value").write.partitionBy("o_orderpriority").text(path)
    return path


def _priority() -> Column:
    return F.regexp_replace(F.regexp_extract("path", "o_orderpriority=([^/]*)/", 1), "%20| ", "_")


_FILES = "f AS (SELECT replace(o_orderpriority, ' ', '_') AS priority, string_agg(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR || chr(10), '' ORDER BY o_orderkey) AS content FROM orders GROUP BY 1)"


@query(with_(_FILES, "m AS (SELECT (sum(length(content)) // count(*))::BIGINT AS mean FROM f)") + "SELECT priority, length(content) AS length, length(content) > mean AS refused FROM f, m")
def byte_limit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of more bytes than their mean are refused."""
    path = _by_priority(spark, sf_dir)
    mean = tabular.over_limit(spark, f"{path}/*", 0).agg(F.expr("sum(length) div count(*)").alias("m")).first().m
    return tabular.over_limit(spark, f"{path}/*", mean).select(_priority().alias("priority"), "length", "refused")


_FLAGS = "SELECT cast(o_orderkey AS BIGINT) AS id, o_orderkey % 2 = 0 AS inferred, o_orderkey % 3 = 0 AS acknowledged, o_orderkey % 5 = 0 AS odd, o_orderkey % 7 = 0 AS forced FROM {orders}"


@query(with_("c AS (" + _FLAGS.format(orders="orders") + ")") + "SELECT id, NOT (inferred AND NOT acknowledged) AND NOT (odd AND NOT forced) AS allowed FROM c")
def feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of many runs: each of their few combinations is judged once."""
    asked = spark.sql(_FLAGS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    flags = ("inferred", "acknowledged", "odd", "forced")
    kinds = asked.select(*flags).distinct().collect()  # sixteen at most
    judged = [(*k, RunOptions(use_inferred=k.inferred, acknowledge_experimental=k.acknowledged, map_columns=("Vendor",) if k.odd else ("Department",), force_map_columns=k.forced).problem() is None) for k in kinds]
    table = spark.createDataFrame(judged, ", ".join(f"{f} boolean" for f in (*flags, "allowed")))
    return asked.join(F.broadcast(table), list(flags)).select("id", "allowed")


@query(with_(_FILES) + "SELECT priority, length(content) AS length, sha256(content) AS sha256 FROM f")
def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of files, here by chunks: all are larger than what is taken whole."""
    return tabular.fingerprints(spark, _by_priority(spark, sf_dir), below=True, whole=512).select(_priority().alias("priority"), "length", "sha256")


@query("""WITH l AS (SELECT o_orderkey AS n, concat_ws(',', o_orderkey::VARCHAR, o_orderpriority, o_orderstatus) || CASE WHEN o_orderkey = 3 THEN ';' ELSE '' END AS value FROM orders ORDER BY o_orderkey LIMIT 10),
    c AS (SELECT k - 1 AS k, d, n, length(value) - length(replace(value, d, '')) AS c FROM l, (SELECT unnest([1, 2, 3, 4, 5]) AS k, unnest([',', chr(9), '|', ';', ':']) AS d))
    SELECT k::BIGINT AS k, d AS delimiter, (CASE WHEN min(c) = max(c) AND min(c) > 0 THEN min(c) * 10 ELSE arg_min(c, n) END)::BIGINT AS score FROM c GROUP BY k, d""")
def detect_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.concat(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus"), F.when(F.col("o_orderkey") == 3, ";").otherwise(""))
    return tabular.delimiter_scores(o.select(F.col("o_orderkey").alias("n"), value.alias("value"))).withColumn("k", F.col("k").cast("long"))


# --- profiles and inference -------------------------------------------------

_LONG = "v AS (" + " UNION ALL ".join(f"SELECT row_number, '{COLUMNS[c]}' AS \"column\", {c} AS value FROM f" for c in COLUMNS) + ")"
_F = "f AS (" + oracle.SQL.format(orders="orders") + ")"
_HEAD = "f AS (SELECT * FROM (" + oracle.SQL.format(orders="orders") + ") ORDER BY row_number LIMIT 1000)"


_TOP = """c AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM c),
    t AS (SELECT "column", string_agg(value || ' x ' || n, '; ' ORDER BY place) AS most_common FROM p WHERE place <= 5 GROUP BY 1)"""


@query(with_(_F, _LONG, _TOP) + r"""SELECT "column", count(value) AS non_null, count(*) - count(value) AS nulls, count(DISTINCT value) AS distinct_values,
    CASE WHEN arg_min(value, row_number) IS NULL THEN 'empty' WHEN regexp_matches(arg_min(value, row_number), '^\d{4}-\d{2}-\d{2}') THEN 'date' WHEN regexp_full_match(replace(arg_min(value, row_number), ',', ''), '-?\d+\.?\d*') THEN 'numeric' ELSE 'string' END AS data_type, coalesce(any_value(most_common), '') AS most_common FROM v LEFT JOIN t USING ("column") GROUP BY 1""")
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.array_join(F.transform("most_common", lambda x: F.concat(x.value, F.lit(" x "), x.n)), "; ")
    return profiling.profile(messy_ledger(spark, sf_dir)).withColumn("most_common", most)


@query(with_(_F, _LONG) + """, c AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM c) SELECT * FROM p WHERE place <= 5""")
def topk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.top_values(messy_ledger(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


_VOTE = r"""CASE WHEN lower(trim(value)) IN ('true','false','yes','no','1','0') THEN 'boolean' WHEN regexp_full_match(trim(value), '[+-]?\d+') THEN 'integer'
    WHEN regexp_full_match(translate(trim(value), ',$', ''), '[+-]?(\d+\.?\d*|\.\d+)') THEN 'decimal'
    WHEN regexp_full_match(value, '\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{1,2}/\d{1,2}') THEN 'date' ELSE 'string' END"""


@query(with_(_HEAD, _LONG) + f""", p AS (SELECT "column", {_VOTE} AS vote, row_number() OVER (PARTITION BY "column" ORDER BY row_number) AS place FROM v WHERE value IS NOT NULL),
    c AS (SELECT "column", vote, count(*) AS n, list_position(['integer','decimal','date','boolean','string'], vote) AS r FROM p WHERE place <= 100 GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, r) AS best FROM c) SELECT "column", vote AS data_type FROM b WHERE best = 1""")
def infer_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.inferred_types(messy_ledger(spark, sf_dir))


@query(with_(_HEAD, _LONG) + """SELECT "column", count(value) / count(*) > 0.95 AS required, count(DISTINCT value) AS n_distinct FROM v GROUP BY 1""")
def infer_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.inferred_facts(messy_ledger(spark, sf_dir)).select("column", "required", "n_distinct")


@query(with_(_HEAD, _LONG) + """SELECT "column", CASE WHEN count(DISTINCT value) / nullif(count(value), 0) < 0.1 THEN array_to_string(list_sort(list_distinct(list(value)))[1:20], '|') END AS enum_values FROM v GROUP BY 1""")
def infer_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.inferred_facts(messy_ledger(spark, sf_dir)).select("column", F.array_join("enum", "|").alias("enum_values"))


@query(with_(_HEAD) + r"""SELECT k::BIGINT AS k, avg(regexp_matches(upper(ref), p)::INT) AS share FROM f, (SELECT unnest([0, 1, 2, 3]) AS k, unnest(['^REF-?\d+$', '^INV-?\d+$', '^TXN-?\d+$', '^[A-Z]{2,4}-?\d+$']) AS p) WHERE ref IS NOT NULL GROUP BY k""")
def infer_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.pattern_shares(messy_ledger(spark, sf_dir), ["Reference Number"]).filter("k < 4").select(F.col("k").cast("long").alias("k"), "share")


@query(with_(_F) + r"""SELECT row_number, date, coalesce(regexp_full_match(date, '\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{1,2}/\d{1,2}'), false) AS is_date FROM f""")
def infer_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("Date")
    return messy_ledger(spark, sf_dir).select("row_number", c.alias("date"), F.coalesce(profiling.is_plain_date(c), F.lit(False)).alias("is_date"))


@query(r"""SELECT p_partkey::BIGINT AS id, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(n, '[^\w\s]', '', 'g'), '\s+', '_', 'g'), '([a-z])([A-Z])', '\1_\2', 'g')), '_+', '_', 'g'), '_') AS canonical
    FROM (SELECT p_partkey, '__' || p_name || '  ($)' || p_brand || p_type AS n FROM part)""")
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("__"), "p_name", F.lit("  ($)"), "p_brand", "p_type")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), profiling.canonical_names(name).alias("canonical"))


@query(with_(_HEAD, _LONG) + """SELECT "column", count(DISTINCT value) = count(*) AS unique_values FROM v GROUP BY 1""")
def detect_primary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.inferred_facts(messy_ledger(spark, sf_dir)).select("column", (F.col("n_distinct") == F.col("n_rows")).alias("unique_values"))


@query("SELECT unnest(['txn_id', 'dept', 'user']) AS original, unnest(['Transaction ID', 'Department', 'Created By']) AS header, 64::BIGINT AS hash_length, (SELECT count(*) FROM orders) AS n_rows")
def ingest_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of a file and what they become, beside its hash and rows."""
    path = f"{sinks.scratch(spark)}/in"
    messy_ledger(spark, sf_dir).select(F.col("Transaction ID").alias("txn_id"), F.col("Department").alias("dept"), F.col("Created By").alias("user")).write.option("header", True).csv(path)
    out = tabular.ingest(spark, path)
    headers = spark.createDataFrame([(k, v, len(out.fingerprint)) for k, v in out.headers.items()], "original string, header string, hash_length long")
    return headers.crossJoin(F.broadcast(out.table.agg(F.count(F.lit(1)).alias("n_rows"))))  # one row


@query("SELECT unnest(['Transaction ID', 'Date', 'Account Code', 'Account Name', 'Description', 'Debit Amount', 'Credit Amount', 'Department', 'Reference Number', 'Created By']) AS name, unnest(['string', 'string', 'string', 'string', 'string', 'decimal', 'decimal', 'string', 'string', 'string']) AS type, unnest([true, true, true, false, false, false, false, true, true, true]) AS required, false AS primary_key, NULL::VARCHAR AS pattern")
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = profiling.inferred_contract(messy_ledger(spark, sf_dir))
    return spark.createDataFrame([(c.name, c.type, c.required, c.pattern, c.primary_key) for c in contract.columns], "name string, type string, required boolean, pattern string, primary_key boolean")


@query("SELECT unnest(['category', 'vendor', 'remark']) AS name, unnest([true, false, false]) AS mappable")
def infer_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns of certain names with 5 to 100 distinct values may be mapped."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    df = o.select(k.cast("long").alias("row_number"), F.concat(F.lit("kind "), k % 7).alias("category"), F.concat(F.lit("firm "), k).alias("vendor"), F.concat(F.lit("said "), k % 7).alias("remark"))
    return spark.createDataFrame([(c.name, c.mappable) for c in profiling.inferred_contract(df).columns], "name string, mappable boolean")


@query("SELECT unnest(['Debit', 'Credit', 'Code']) AS name, unnest(['decimal', 'decimal', 'integer']) AS type, unnest([false, false, true]) AS required, true AS debit_xor_credit")
def infer_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where there are a debit and a credit column, both are decimal and optional."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    df = o.select(k.cast("long").alias("row_number"), (k * 3).cast("string").alias("Debit"), F.lit("none").alias("Credit"), (k + 10).cast("string").alias("Code"))
    contract = profiling.inferred_contract(df)
    return spark.createDataFrame([(c.name, c.type, c.required, contract.debit_xor_credit) for c in contract.columns], "name string, type string, required boolean, debit_xor_credit boolean")


@query("SELECT DISTINCT p_brand AS name, 'string' AS type, false AS required FROM part")
def default_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of a table that has a column for each brand."""
    names = [r.p_brand for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand").distinct().collect()]  # names of columns
    contract = profiling.default_contract(names)
    return spark.createDataFrame([(c.name, c.type, c.required) for c in contract.columns], "name string, type string, required boolean")


@query(with_(_HEAD) + "SELECT row_number, txn FROM f")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy_ledger(spark, sf_dir).orderBy("row_number").limit(1000).select("row_number", F.col("Transaction ID").alias("txn"))


# --- rules ------------------------------------------------------------------

def _rule_query(rule: str, rule_ids: tuple[str, ...]) -> None:
    """The log of one rule: what it saw and what it made."""
    ids = ", ".join(f"'{r}'" for r in rule_ids)

    @query(with_(STAGES, LOG) + f"SELECT row_number, \"column\", before, after FROM log WHERE rule_id IN ({ids})", name=rule)
    def of_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _log(spark, sf_dir).filter(F.col("rule_id").isin(*rule_ids)).select("row_number", "column", "before", "after")


for _name, _ids in {
    "rule_trim_whitespace": ("trim_whitespace",), "rule_title_case": ("case_normalization",), "rule_upper_codes": ("uppercase_codes",), "rule_numeric_clean": ("numeric_cleaning",), "rule_date_iso": ("date_normalization",),
    "rule_department_map": ("department_mapping",), "rule_account_map": ("account_mapping",), "rule_account_title": ("account_title_case",), "rule_txn_id": ("transaction_id_format",), "rule_sign_fix": ("debit_sign_fix", "credit_sign_fix"),
    "rule_text_clean": ("text_cleaning",), "rule_reference": ("reference_number_format",),
}.items():
    _rule_query(_name, _ids)


@query(with_(STAGES) + f"SELECT row_number, {', '.join(COLUMNS)} FROM {LAST}")
def apply_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_ruled(spark, sf_dir).drop("__changes", "row_uuid"))


@query(with_(_F) + f"SELECT row_number, {oracle._money('debit')} AS debit, {oracle._money('credit')} AS credit FROM f")
def clean_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy_ledger(spark, sf_dir).select("row_number", amounts.cleaned(F.col("Debit Amount")).alias("debit"), amounts.cleaned(F.col("Credit Amount")).alias("credit"))


@query(with_(_F) + f"SELECT row_number, {oracle._iso('date')} AS iso FROM f")
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy_ledger(spark, sf_dir).select("row_number", dates.iso_date(F.col("Date")).alias("iso"))


@query(with_(STAGES, LOG) + "SELECT row_number, \"column\", before, after, rule_id, 1.0::DOUBLE AS confidence, 'rule' AS source FROM log")
def change_log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("row_number", "column", "before", "after", "rule_id", "confidence", "source")


@query(with_(STAGES, LOG) + "SELECT 'rule' AS scope, rule_id AS name, count(*) AS n FROM log GROUP BY 2 UNION ALL SELECT 'column', \"column\", count(*) FROM log GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM log", name="rules_summary")
def rules_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_summary(_log(spark, sf_dir))


@query(with_(STAGES) + f"SELECT dept AS department, count(*) AS n FROM {LAST} GROUP BY 1")
def department_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir).groupBy(F.col("Department").alias("department")).agg(F.count(F.lit(1)).alias("n"))


# --- checks -----------------------------------------------------------------

def _check_query(name: str, kind: str) -> None:
    @query(with_(STAGES, ERRORS) + f"SELECT row_number, \"column\", value, message FROM e WHERE error_type = '{kind}'", name=name)
    def of_check(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _errors(spark, sf_dir).filter(F.col("error_type") == kind).select("row_number", "column", "value", "message")


for _name, _kind in {
    "check_required": "required_field", "check_type": "type_mismatch", "check_enum": "enum_violation", "check_pattern": "pattern_violation", "check_length": "length_violation", "check_debit_xor_credit": "debit_xor_credit",
    "check_txn_format": "transaction_id_format", "check_txn_missing": "missing_primary_key", "check_txn_duplicate": "duplicate_primary_key",
}.items():
    _check_query(_name, _kind)


@query("SELECT o_orderkey::BIGINT AS row_number, 'Account Name' AS \"column\", 'missing_column' AS error_type FROM orders")
def check_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checks.check(messy_ledger(spark, sf_dir).drop("Account Name"), strict_contract())
    return checks.error_table(out).filter("error_type = 'missing_column'").select("row_number", "column", "error_type")


@query(with_(STAGES, ERRORS) + "SELECT row_number, ord::BIGINT AS ord, \"column\", error_type FROM e")
def bag_append_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).select("row_number", F.col("ord").cast("long").alias("ord"), "column", "error_type")


@query(with_(_F) + rf"SELECT row_number, CASE WHEN regexp_full_match({oracle._bare('debit')}, '[+-]?(\d+(\.\d*)?|\.\d+)') THEN cast(cast({oracle._bare('debit')} AS DECIMAL(18,2)) AS VARCHAR) END AS debit FROM f")
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy_ledger(spark, sf_dir).select("row_number", amounts.parsed(F.col("Debit Amount")).cast("decimal(18,2)").cast("string").alias("debit"))


@query(with_(STAGES, ERRORS) + f"SELECT row_number, txn, debit, credit FROM {LAST} WHERE row_number NOT IN (SELECT row_number FROM e)")
def split_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(checks.valid_rows(_checked(spark, sf_dir))).select("row_number", "txn", "debit", "credit")


@query(with_(STAGES, ERRORS, CATEGORY) + "SELECT row_number, n AS error_count FROM q")
def split_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.quarantined_rows(_checked(spark, sf_dir)).select("row_number", F.size("__errors").cast("long").alias("error_count"))


@query(with_(STAGES, ERRORS, CATEGORY) + "SELECT row_number, validator_category AS category FROM q")
def categorize_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.quarantined_rows(_checked(spark, sf_dir)).select("row_number", F.col("validator_category").alias("category"))


@query(with_(STAGES, ERRORS, CATEGORY) + "SELECT row_number, error_category AS category FROM q")
def categorize_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.quarantined_rows(_checked(spark, sf_dir)).select("row_number", F.col("error_category").alias("category"))


@query(with_(STAGES, ERRORS, CATEGORY) + "SELECT c.category, count(q.row_number) AS n FROM (SELECT unnest(['validation_failure','parse_error','llm_contract_failure','low_confidence','edit_cap_exceeded']) AS category) c LEFT JOIN q ON q.error_category = c.category GROUP BY 1")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.validation_summary(checks.quarantined_rows(_checked(spark, sf_dir)), F.col("error_category"))


@query(with_(STAGES) + rf"SELECT count_if(coalesce(regexp_full_match(upper(trim(txn)), 'TXN-\d+'), false)) * 2 > count(*) AS majority FROM {LAST}")
def majority_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.majority_has_keys(_ruled(spark, sf_dir)).withColumnRenamed("__majority", "majority")


@query(with_(STAGES, ERRORS) + "SELECT row_number, string_agg(message, '; ' ORDER BY ord) AS messages FROM e GROUP BY 1")
def join_errors_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.quarantined_rows(_checked(spark, sf_dir)).select("row_number", F.array_join(F.transform("__errors", lambda x: x.message), "; ").alias("messages"))


@query(with_(STAGES, ERRORS) + "SELECT row_number, arg_min(error_type, ord) AS error_type FROM e GROUP BY 1")
def win_primary_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("row_number").orderBy("ord")
    return _errors(spark, sf_dir).withColumn("place", F.row_number().over(w)).filter("place = 1").select("row_number", "error_type")


@query("SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def win_duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return checks.duplicate_counts(lines, "l_orderkey", "l_linenumber")


@query(with_(STAGES) + rf"SELECT row_number FROM {LAST} WHERE txn IS NULL OR NOT regexp_full_match(upper(trim(txn)), 'TXN-\d+')")
def set_union_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, c = _ruled(spark, sf_dir), F.col("Transaction ID")
    return df.filter(c.isNull() | ~identifiers.is_transaction_id(c)).select("row_number")


@query(with_(STAGES, ERRORS) + f"SELECT row_number FROM {LAST} EXCEPT SELECT row_number FROM e")
def set_minus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: the rows and those with errors come from the same table."""
    rows = _checked(spark, sf_dir).groupBy("row_number").agg(F.bool_or(F.size("__errors") > 0).alias("bad"))
    return rows.filter("not bad").select("row_number")


# --- residuals and mappings -------------------------------------------------

def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.residuals(_ruled(spark, sf_dir), ledger_contract(), MAP_COLUMNS)


def _facts(spark: SparkSession, sf_dir: str, cap: float = 35.0) -> tuple[DataFrame, DataFrame]:
    return residual.residual_facts(_ruled(spark, sf_dir), ledger_contract(), MAP_COLUMNS, cap)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _ruled(spark, sf_dir)
    return residual.edit_counts(residual.residuals(df, ledger_contract(), MAP_COLUMNS), df.agg(F.count(F.lit(1)).alias("n_all")), 35.0)


@query(with_(STAGES, RESIDUAL) + "SELECT \"column\", value, n_rows, first_row FROM r")
def residual_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("column", "value", "n_rows", "first_row")


@query(with_(STAGES, RESIDUAL) + "SELECT DISTINCT \"column\", value FROM cells")
def set_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.residual_cells(_ruled(spark, sf_dir), ledger_contract(), MAP_COLUMNS).select("column", "value").distinct()


@query(with_(STAGES, RESIDUAL) + "SELECT \"column\", value, min(row_number) AS first_row FROM cells GROUP BY 1, 2")
def win_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("column", "value", "first_row")


@query(with_(STAGES) + "SELECT \"column\", canonical, count(row_number) AS n_rows FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", unnest([{v.strip('()')}]) AS canonical" for c, v in oracle._CANON.items()) + f") LEFT JOIN (SELECT row_number, dept AS value, 'Department' AS c FROM {LAST} UNION ALL SELECT row_number, acct, 'Account Name' FROM {LAST}) ON canonical = value AND \"column\" = c GROUP BY 1, 2")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical values of each column, and how many rows have each after the rules."""
    known = residual.canonical_values(spark, ledger_contract(), MAP_COLUMNS)
    rows = _ruled(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("canonical")) for c in MAP_COLUMNS])).alias("x")).select("x.*")
    return known.join(rows.groupBy("column", "canonical").agg(F.count(F.lit(1)).alias("n_rows")), ["column", "canonical"], "left").fillna(0, ["n_rows"])


@query(with_(STAGES) + f"SELECT row_number, dept AS value FROM {LAST} WHERE dept IN {oracle._CANON['Department']}")
def semi_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.canonical_cells(_ruled(spark, sf_dir), ledger_contract(), "Department")


@query(with_(STAGES, RESIDUAL) + "SELECT row_number, value FROM cells WHERE \"column\" = 'Department'")
def anti_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.residual_cells(_ruled(spark, sf_dir), ledger_contract(), ("Department",)).select("row_number", "value")


_COUNTS = f"counts AS (SELECT \"column\", sum(n_rows)::BIGINT AS affected, round(sum(n_rows) * 100.0 / (SELECT count(*) FROM {LAST}), 6) AS share_pct, sum(n_rows) * 100.0 / (SELECT count(*) FROM {LAST}) > 35 AS over_cap FROM r GROUP BY 1)"


@query(with_(STAGES, RESIDUAL, _COUNTS) + "SELECT \"column\", affected, share_pct FROM counts")
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("column", "affected", F.round("share_pct", 6).alias("share_pct"))


#: A cap that one of the two columns passes.
CAP = 41.0


@query(with_(STAGES, RESIDUAL, _COUNTS.replace("> 35 AS", f"> {CAP} AS")) + "SELECT r.\"column\", value FROM r JOIN counts USING (\"column\") WHERE NOT over_cap")
def edit_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.under_cap(*_facts(spark, sf_dir, CAP)).select("column", "value")


_BATCH = "SELECT \"column\", value, floor((row_number() OVER (PARTITION BY \"column\" ORDER BY first_row, value) - 1) / 2)::BIGINT AS batch_id FROM r"


@query(with_(STAGES, RESIDUAL) + _BATCH)
def batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.batched(_found(spark, sf_dir), 2).select("column", "value", "batch_id")


@query("SELECT \"column\", value, floor((row_number() OVER (PARTITION BY \"column\" ORDER BY first_row, value) - 1) / 15)::BIGINT AS batch_id FROM (SELECT 'clerk ' || (o_custkey % 3) AS \"column\", o_custkey::VARCHAR AS value, min(o_orderkey)::BIGINT AS first_row FROM orders GROUP BY 1, 2)")
def win_batch_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 15 over many distinct values."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = o.groupBy(F.concat(F.lit("clerk "), (F.col("o_custkey") % 3).cast("string")).alias("column"), F.col("o_custkey").cast("string").alias("value"))
    return residual.batched(found.agg(F.min("o_orderkey").cast("long").alias("first_row")), 15).select("column", "value", "batch_id")


def _offline(column: str, values: list[str], names: list[str]) -> dict[str, str | None]:
    return {v: next((n for n in names if n.lower()[:4] in v.lower()), None) for v in values}


_NAMES = {c: v.strip("()").replace("'", "").split(",") for c, v in oracle._CANON.items()}
_FIRST = " ".join(f"WHEN \"column\" = '{c}' AND contains(lower(value), '{n.lower()[:4]}') THEN '{n}'" for c, names in _NAMES.items() for n in names)


@query(with_(STAGES, RESIDUAL) + f"SELECT \"column\", value, CASE {_FIRST} END AS mapped FROM r")
def external_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.map_values(residual.batched(_found(spark, sf_dir), 15), ledger_contract(), _offline)


def _mapper(name: str, column: str) -> None:
    @query(with_(STAGES, RESIDUAL, MAPPED) + f"SELECT value, mapped FROM m WHERE \"column\" = '{column}'", name=name)
    def of_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        return residual.map_by_rules(_found(spark, sf_dir)).filter(F.col("column") == column).select("value", "mapped")


_mapper("mapper_rules_department", "Department")
_mapper("mapper_rules_account", "Account Name")


@query("SELECT o_orderkey::BIGINT AS id, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderpriority END AS mapped FROM orders")
def parse_mapper_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    body = F.to_json(F.create_map(F.lit("x"), F.col("o_orderpriority")))
    text = F.when(F.col("o_orderkey") % 3 == 0, body).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise("no json")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), F.try_element_at(residual.parsed_response(text), F.lit("x")).alias("mapped"))


@query(with_(STAGES, RESIDUAL, MAPPED) + f"SELECT \"column\", value, mapped FROM m WHERE mapped IN {oracle._CANON['Department']} OR mapped IN {oracle._CANON['Account Name']}")
def contract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = residual.map_by_rules(_found(spark, sf_dir))
    return residual.to_canonical(mapped, ledger_contract(), MAP_COLUMNS).select("column", "value", "mapped")


def _mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.map_in_place(_ruled(spark, sf_dir), ledger_contract(), MAP_COLUMNS)


_APPLIED = f"SELECT s.row_number, coalesce(d.mapped, dept) AS dept, coalesce(a.mapped, acct) AS acct FROM {LAST} s LEFT JOIN m d ON d.\"column\" = 'Department' AND d.value = s.dept LEFT JOIN m a ON a.\"column\" = 'Account Name' AND a.value = s.acct"


@query(with_(STAGES, RESIDUAL, MAPPED) + _APPLIED)
def apply_value_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_mapped_rows(spark, sf_dir)).select("row_number", "dept", "acct")


@query(with_(STAGES, RESIDUAL, MAPPED) + "SELECT c.row_number, c.\"column\", c.value AS before, m.mapped AS after FROM cells c JOIN m ON m.\"column\" = c.\"column\" AND m.value = c.value WHERE mapped IS NOT NULL")
def mapping_apply_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers of the mapper, whatever their confidence: the cells they fix."""
    return change_log(_mapped_rows(spark, sf_dir)).filter("ord >= 10000").select("row_number", "column", "before", "after")


_CACHED = "k AS (SELECT 'Account Name' AS \"column\", 'Petty Cash' AS value, 'Cash' AS mapped, 'cache' AS source UNION ALL SELECT \"column\", value, mapped, 'mapper' FROM m WHERE mapped IS NOT NULL AND CASE \"column\" WHEN 'Department' THEN 0.9 ELSE 0.7 END >= 0.8)"


@query(with_(STAGES, RESIDUAL, MAPPED, _CACHED) + "SELECT c.row_number, c.\"column\", c.value AS before, k.mapped AS after, k.source FROM cells c JOIN k ON k.\"column\" = c.\"column\" AND k.value = c.value")
def mapping_apply_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits, and answers whose confidence reaches the floor, by a join."""
    found = _found(spark, sf_dir)
    sure = residual.map_by_rules(found).withColumn("confidence", F.when(F.col("column") == "Department", 0.9).otherwise(0.7))
    cached = spark.createDataFrame([("Account Name", "Petty Cash", "Cash", "cache")], "column string, value string, mapped string, source string")
    maps = residual.accepted(sure, 0.8).select("column", "value", "mapped", F.lit("mapper").alias("source")).unionByName(cached)
    out = residual.apply_mappings(_ruled(spark, sf_dir), maps, MAP_COLUMNS)
    return change_log(out).filter("ord >= 10000").select("row_number", "column", "before", "after", F.col("rule_id").alias("source"))


@query(with_(STAGES, RESIDUAL, MAPPED) + "SELECT \"column\", count(*) AS attempted, coalesce(sum(n_rows) FILTER (WHERE mapped IS NOT NULL), 0)::BIGINT AS fixed, count_if(mapped IS NULL)::BIGINT AS errors FROM m GROUP BY 1")
def mapping_apply_skip_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null targets are skipped: what was asked for, fixed and left."""
    found = _found(spark, sf_dir)
    return residual.mapping_attempts(residual.map_by_rules(found.select("column", "value", "n_rows"), "n_rows"))


@query("SELECT o_orderkey::BIGINT AS id, CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 5 ELSE 0 END::BIGINT AS n_kept FROM orders")
def prompt_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with one good item, no item, a confidence over 1, a target that is
    not canonical, and no reason."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 5
    item = F.struct(F.col("o_orderpriority").alias("value"), F.when(k == 3, "Nowhere").otherwise("Sales").alias("mapped"), F.when(k == 2, 1.5).otherwise(0.9).alias("confidence"), F.when(k != 4, "said").alias("reason"))
    text = F.when(k == 0, "no json").otherwise(F.to_json(F.array(item)))
    kept = residual.checked_answers(text, ledger_contract().canonical("Department"))
    return o.select(F.col("o_orderkey").cast("long").alias("id"), F.size(kept).cast("long").alias("n_kept"))


@query(with_(STAGES, LOG, RESIDUAL, MAPPED) + "SELECT \"column\", count(*) AS n FROM (SELECT \"column\" FROM log UNION ALL SELECT c.\"column\" FROM cells c JOIN m ON m.\"column\" = c.\"column\" AND m.value = c.value WHERE mapped IS NOT NULL) GROUP BY 1")
def bag_append_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_log(_mapped_rows(spark, sf_dir)).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query(with_(STAGES, RESIDUAL, _COUNTS) + ", p AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY first_row, value) AS place FROM r) SELECT p.\"column\", count(*) AS n_values, sum(n_rows)::BIGINT AS n_rows, string_agg(value, '; ' ORDER BY place) FILTER (WHERE place <= 5) AS examples, any_value(over_cap) AS over_cap FROM p JOIN counts USING (\"column\") GROUP BY 1")
def planner_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.planner_summary(*_facts(spark, sf_dir))


@query(with_(_F) + f"SELECT row_number, coalesce({oracle._dictionary('trim(dept)', DEPARTMENTS)}, trim(dept)) AS department FROM f")
def join_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messy_ledger(spark, sf_dir).select("row_number", F.trim("Department").alias("department"))
    return mapping.applied(rows, "department", DEPARTMENTS)


# --- the mapping dictionary -------------------------------------------------

_VERSIONS = """SELECT 'Department' AS column_name, o_orderpriority AS variant_value, concat('m', cast(o_orderkey % 2 AS STRING)) AS model_id,
    CASE cast(o_orderkey % 3 AS INT) WHEN 0 THEN 'Sales' WHEN 1 THEN 'IT' ELSE 'HR' END AS canonical_value, cast(cast(70 + 5 * (o_orderkey % 5) AS DECIMAL(5,2)) / 100 AS DOUBLE) AS confidence,
    cast(o_orderdate AS DATE) AS created_at, o_orderkey % 4 = 0 AS is_approved, cast(o_orderkey % 9 AS BIGINT) AS use_count FROM {orders}"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_VERSIONS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


_V = "v AS (" + _VERSIONS.format(orders="orders") + ")"
_NOW = "now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name, variant_value, model_id ORDER BY created_at DESC, canonical_value DESC, confidence DESC) AS place FROM v) WHERE place = 1)"


@query(with_(_V, _NOW) + "SELECT column_name, variant_value, model_id, canonical_value, confidence, created_at::VARCHAR AS created_at FROM now")
def win_latest_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.latest(_versions(spark, sf_dir)).withColumn("created_at", F.col("created_at").cast("string"))


@query(with_(_V, "now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name, variant_value, model_id ORDER BY created_at DESC, canonical_value DESC, confidence DESC) AS place FROM v WHERE is_approved) WHERE place = 1)") + "SELECT variant_value, model_id, canonical_value FROM now")
def latest_approved_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.latest(_versions(spark, sf_dir), approved_only=True).select("variant_value", "model_id", "canonical_value")


@query(with_(_V) + "SELECT variant_value, model_id, canonical_value, created_at::VARCHAR AS created_at, lead(created_at) OVER (PARTITION BY column_name, variant_value, model_id ORDER BY created_at, canonical_value)::VARCHAR AS superseded_at FROM v")
def win_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapping.superseded(_versions(spark, sf_dir))
    return out.select("variant_value", "model_id", "canonical_value", F.col("created_at").cast("string").alias("created_at"), F.col("superseded_at").cast("string").alias("superseded_at"))


@query(with_(_V) + "SELECT count(*) AS n_mappings, count(DISTINCT column_name) AS n_columns, count(DISTINCT variant_value) AS n_variants, sum(use_count)::BIGINT AS uses, round(avg(confidence), 6) AS mean_confidence FROM v")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.stats(_versions(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


_UPSERT = "u AS (SELECT * FROM v UNION ALL SELECT 'Department', '5-LOW', 'm0', 'Legal', 0.99, DATE '2030-01-01', true, 0)"


@query(with_(_V, _UPSERT, _NOW.replace("FROM v)", "FROM u)")) + "SELECT variant_value, model_id, canonical_value FROM now")
def mapping_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.sql("SELECT 'Department' AS column_name, '5-LOW' AS variant_value, 'm0' AS model_id, 'Legal' AS canonical_value, 0.99D AS confidence, DATE '2030-01-01' AS created_at, true AS is_approved, 0L AS use_count")
    return mapping.latest(mapping.upserted(_versions(spark, sf_dir), new)).select("variant_value", "model_id", "canonical_value")


@query("SELECT p.v AS variant_value, count(o_orderkey) AS use_count, max(o_orderdate)::DATE::VARCHAR AS last_used FROM (SELECT unnest(['1-URGENT', '2-HIGH', 'none']) AS v) p LEFT JOIN orders ON o_orderpriority = p.v GROUP BY 1")
def mapping_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("Department").alias("column_name"), F.col("o_orderpriority").alias("variant_value"), F.col("o_orderdate").alias("used_at"))
    table = spark.createDataFrame([("Department", v) for v in ("1-URGENT", "2-HIGH", "none")], "column_name string, variant_value string")
    return mapping.usage(table, used).select("variant_value", "use_count", F.col("last_used").cast("date").cast("string").alias("last_used"))


_WORDS = "w AS (SELECT DISTINCT 'Department' AS \"column\", o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN '?' ELSE '' END AS value FROM orders), c AS (SELECT variant_value AS value, canonical_value AS mapped FROM now WHERE model_id = 'm0')"


def _words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    values = o.select(F.lit("Department").alias("column"), F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "?").otherwise("")).alias("value")).distinct()
    return values, mapping.latest(_versions(spark, sf_dir)).filter("model_id = 'm0'")


@query(with_(_V, _NOW, _WORDS) + "SELECT \"column\", value, mapped FROM w JOIN c USING (value)")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.hits(*_words(spark, sf_dir)).select("column", "value", "mapped")


@query(with_(_V, _NOW, _WORDS) + "SELECT \"column\", value FROM w WHERE value NOT IN (SELECT value FROM c)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.misses(*_words(spark, sf_dir)).select("column", "value")


@query(with_(_V, _NOW, _WORDS) + "SELECT \"column\", value, mapped FROM w LEFT JOIN c USING (value)")
def join_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, now = _words(spark, sf_dir)
    return values.join(mapping.hits(values, now).select("column", "value", "mapped"), ["column", "value"], "left")


@query(with_(_V, _NOW, _WORDS) + "SELECT o_orderkey::BIGINT AS row_number, coalesce(mapped, o_orderpriority) AS value FROM orders LEFT JOIN c ON value = o_orderpriority")
def join_cache_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("row_number"), F.col("o_orderpriority").alias("variant_value"))
    _, now = _words(spark, sf_dir)
    return rows.join(now.select("variant_value", "canonical_value"), "variant_value", "left").select("row_number", F.coalesce("canonical_value", "variant_value").alias("value"))


@query(with_(_V, _NOW, _WORDS) + "SELECT round(count(mapped) / count(*), 6) AS ratio FROM w LEFT JOIN c USING (value)")
def cache_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, now = _words(spark, sf_dir)
    joined = values.join(mapping.hits(values, now), ["column", "value"], "left")
    return joined.agg(F.round(reports.hit_ratio(F.count("mapped"), F.count_if(F.col("mapped").isNull())), 6).alias("ratio"))


@query(with_(_V, _NOW) + "SELECT variant_value, model_id, canonical_value FROM now")
def cache_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored in two parts, one of them twice, and read."""
    path = f"{sinks.scratch(spark)}/dictionary"
    new = _versions(spark, sf_dir)
    for part, some in (("one", "is_approved"), ("two", "not is_approved"), ("two", "not is_approved")):
        mapping.store(new.filter(some), path, part)
    return mapping.latest(mapping.stored(spark, path)).select("variant_value", "model_id", "canonical_value")


# --- patches ----------------------------------------------------------------

_PATCHES = """SELECT CASE WHEN o_orderkey % 29 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS row_number, CASE WHEN o_orderkey % 23 = 0 THEN 'Nowhere' ELSE 'Department' END AS `column`,
    CASE WHEN o_orderkey % 4 = 0 THEN 'stale' WHEN o_orderpriority = '1-URGENT' THEN ' Sales ' WHEN o_orderpriority = '2-HIGH' THEN 'Operations' ELSE 'HR' END AS before, 'Legal' AS after,
    cast(cast(75 + 5 * (o_orderkey % 5) AS DECIMAL(5,2)) / 100 AS DOUBLE) AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'human' ELSE 'llm' END AS source FROM {orders}"""


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(_PATCHES, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return p.withColumn("row_number", F.col("row_number").cast("long"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.outcomes(_ruled(spark, sf_dir), _patches(spark, sf_dir), ["Department"])


_P = "p AS (" + _PATCHES.format(orders="orders").replace("`", '"') + ")"
_OUT = f"""o AS (SELECT p.*, s.row_number IS NOT NULL AS there, s.dept AS cur, CASE WHEN s.row_number IS NULL THEN 'not_found' WHEN "column" <> 'Department' THEN 'column_missing' WHEN p.confidence < 0.8 THEN 'low_confidence'
    WHEN trim(before) IS DISTINCT FROM dept THEN 'precondition_failed' ELSE 'applied' END AS outcome FROM p LEFT JOIN {LAST} s USING (row_number))"""


@query(with_(STAGES, _P, _OUT) + "SELECT row_number::BIGINT AS row_number, \"column\", confidence, source, outcome FROM o")
def patch_precondition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("row_number", "column", "confidence", "source", "outcome")


@query(with_(STAGES, _P, _OUT) + "SELECT row_number::BIGINT AS row_number, before FROM o WHERE outcome = 'precondition_failed'")
def precondition_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.precondition_failures(_decided(spark, sf_dir)).select("row_number", "before")


@query(with_(STAGES, _P, _OUT) + f"SELECT s.row_number, CASE WHEN o.outcome = 'applied' THEN o.after ELSE s.dept END AS dept FROM {LAST} s LEFT JOIN o USING (row_number)")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = patches.apply_patches(_ruled(spark, sf_dir), _decided(spark, sf_dir), ["Department"])
    return out.select("row_number", F.col("Department").alias("dept"))


@query(with_(STAGES, _P, _OUT) + f"SELECT s.row_number, s.dept AS value, CASE WHEN o.outcome = 'applied' THEN o.after END AS patch, (o.outcome = 'applied') IS TRUE AS patched FROM {LAST} s LEFT JOIN o USING (row_number)")
def join_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row beside its patch, if it has one that counts."""
    out = patches.with_patches(_ruled(spark, sf_dir), _decided(spark, sf_dir))
    patch = F.try_element_at("__patch", F.lit("Department"))
    return out.select("row_number", F.col("Department").alias("value"), patch.alias("patch"), patch.isNotNull().alias("patched"))


@query(with_(STAGES, _P, _OUT) + "SELECT count(*) AS total, count_if(outcome = 'applied')::BIGINT AS applied, count_if(outcome = 'low_confidence')::BIGINT AS skipped_confidence, count_if(outcome = 'precondition_failed')::BIGINT AS skipped_precondition, count_if(outcome IN ('not_found', 'column_missing'))::BIGINT AS skipped_missing FROM o")
def patch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.patch_stats(_decided(spark, sf_dir))


@query(with_(STAGES, _P, _OUT) + "SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM o), 6) AS share FROM o GROUP BY 1")
def application_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.application_summary(_decided(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(with_(_P) + "SELECT row_number::BIGINT AS row_number, confidence FROM p WHERE confidence >= 0.8")
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.confident(_patches(spark, sf_dir)).select("row_number", "confidence")


@query(with_(STAGES, LOG, _P) + """, l AS (SELECT 'rule' AS source, "column" AS c, rule_id AS r, 1.0 AS confidence FROM log UNION ALL SELECT source, "column", NULL, confidence FROM p)
    SELECT 'source' AS scope, source AS name, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'column', c, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'rule', r, count(*) FROM l WHERE r IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'confidence', CASE WHEN confidence = 1 THEN '1.0' WHEN confidence >= 0.9 THEN '0.9-0.99' WHEN confidence >= 0.8 THEN '0.8-0.89' ELSE 'below_0.8' END, count(*) FROM l GROUP BY 2""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).select("source", "column", "rule_id", "confidence")
    return patches.audit_report(log.unionByName(_patches(spark, sf_dir).select("source", "column", F.lit(None).cast("string").alias("rule_id"), "confidence")))


@query(with_(STAGES, ERRORS, CATEGORY, LOG) + "SELECT q.row_number, count(log.row_number) AS attempted_fixes FROM q LEFT JOIN log USING (row_number) GROUP BY 1")
def join_attempted_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _checked(spark, sf_dir)
    return sinks.errors_table(checks.quarantined_rows(df)).select("row_number", "attempted_fixes")


# --- reports ----------------------------------------------------------------

_TOTALS = f"t AS (SELECT (SELECT count(*) FROM {LAST}) AS total_rows, (SELECT count(*) FROM q) AS quarantined_rows, (SELECT count(*) FROM e) AS total_errors)"


@query(with_(STAGES, ERRORS, CATEGORY, _TOTALS) + "SELECT total_rows, total_rows - quarantined_rows AS clean_rows, quarantined_rows, total_errors, round((total_rows - quarantined_rows) / total_rows, 6) AS success_rate, round(quarantined_rows / total_rows, 6) AS quarantine_rate FROM t")
def quarantine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quarantine_totals(_checked(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("success_rate", "quarantine_rate")})


@query(with_(STAGES, ERRORS) + "SELECT 'type' AS scope, error_type AS name, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'column', \"column\", count(*) FROM e GROUP BY 2")
def quarantine_stats_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.errors_by(_errors(spark, sf_dir))


@query(with_(STAGES, ERRORS, CATEGORY) + "SELECT error_category AS category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM q), 6) AS percentage, false AS fixable FROM q GROUP BY 1")
def quarantine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quarantine_summary(checks.quarantined_rows(_checked(spark, sf_dir))).withColumn("percentage", F.round("percentage", 6))


@query(with_(STAGES, ERRORS) + "SELECT message, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, min(ord), arg_min(row_number, ord::BIGINT * 1000000000 + row_number), message LIMIT 10")
def topk_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_messages(_errors(spark, sf_dir))


@query(with_(STAGES, ERRORS) + "SELECT \"column\" || ':' || error_type AS issue, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, issue LIMIT 5")
def topk_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_issues(_errors(spark, sf_dir))


@query(with_(STAGES, ERRORS) + "SELECT \"column\", count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, \"column\" LIMIT 5")
def column_issue_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.column_issues(_errors(spark, sf_dir))


@query(with_(STAGES, ERRORS) + """, k AS (SELECT DISTINCT row_number, CASE WHEN contains(lower(message), 'required') THEN 'Missing Required Fields' WHEN contains(lower(message), 'type') THEN 'Data Type Mismatches' WHEN contains(lower(message), 'debit') OR contains(lower(message), 'credit') THEN 'Business Rule Violations'
    WHEN contains(lower(message), 'confidence') THEN 'Low Confidence Mappings' WHEN contains(lower(message), 'duplicate') THEN 'Duplicate Transaction IDs' END AS issue FROM e)
    SELECT issue, count(*) AS affected_rows, array_to_string(list(row_number ORDER BY row_number)[1:5], ',') AS example_rows FROM k WHERE issue IS NOT NULL GROUP BY 1""")
def remediation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.remediation_report(_errors(spark, sf_dir)).select("issue", "affected_rows", "example_rows")


@query(with_(STAGES, ERRORS, CATEGORY, LOG, _TOTALS) + "SELECT total_rows, total_rows * 10 AS total_cells, (SELECT count(*) FROM log) AS n_changes, (SELECT count(*) FROM (SELECT DISTINCT row_number, \"column\" FROM log)) AS cells_modified, (SELECT count(DISTINCT row_number) FROM log) AS rows_modified, quarantined_rows, total_rows - quarantined_rows AS clean_rows FROM t")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _checked(spark, sf_dir)
    return reports.run_metrics(10, df).select("total_rows", "total_cells", "n_changes", "cells_modified", "rows_modified", "quarantined_rows", "clean_rows")


@query(with_(STAGES, ERRORS, CATEGORY, _TOTALS) + "SELECT CASE WHEN quarantined_rows = 0 THEN 'succeeded' WHEN quarantined_rows < total_rows THEN 'partial' ELSE 'failed' END AS state FROM t")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_state(_checked(spark, sf_dir))


# --- the run queue ----------------------------------------------------------

_RUNS = """SELECT cast(o_orderkey AS BIGINT) AS run_id, CASE cast(o_orderkey % 6 AS INT) WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' WHEN 4 THEN 'partial' ELSE 'queued' END AS status,
    cast(o_orderdate AS TIMESTAMP) AS created_at, cast(o_orderdate AS TIMESTAMP) AS started_at, CASE WHEN o_orderkey % 6 IN (2, 3, 4) THEN cast('2005-01-01' AS TIMESTAMP) END AS completed_at,
    cast(o_orderdate AS TIMESTAMP) AS heartbeat_at, concat('w', cast(o_custkey % 4 AS STRING)) AS worker_id FROM {orders}"""
_R = "runs AS (" + _RUNS.format(orders="orders") + ")"
_CLOCK = "1998-01-01 00:00:00"
_CLAIM = f"status = 'queued' OR (status = 'running' AND heartbeat_at < TIMESTAMP '{_CLOCK}' - INTERVAL 300 SECOND)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RUNS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


@query(with_(_R) + f"SELECT run_id, status FROM runs WHERE {_CLAIM}")
def visibility_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.claimable(_runs(spark, sf_dir), _CLOCK).select("run_id", "status")


@query(with_(_R) + f"SELECT run_id, status FROM runs WHERE {_CLAIM} ORDER BY created_at, run_id LIMIT 1")
def fifo_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.next_run(_runs(spark, sf_dir), _CLOCK).select("run_id", "status")


@query(with_(_R) + "SELECT run_id, rank() OVER (ORDER BY created_at) AS position FROM runs WHERE status = 'queued'")
def win_queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.queue_positions(_runs(spark, sf_dir)).select("run_id", "position")


@query(with_(_R) + "SELECT run_id FROM runs WHERE status = 'failed' ORDER BY created_at DESC, run_id LIMIT 20 OFFSET 40")
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.list_runs(_runs(spark, sf_dir), "failed", 20, 40).select("run_id")


@query(with_(_R) + "SELECT count(*) AS total, count_if(status = 'queued')::BIGINT AS queued, count_if(status = 'running')::BIGINT AS running, count_if(status = 'succeeded')::BIGINT AS succeeded, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'partial')::BIGINT AS \"partial\", round(avg(epoch(completed_at) - epoch(started_at)), 3) AS mean_seconds, count(DISTINCT worker_id) FILTER (WHERE status = 'running') AS workers FROM runs")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_stats(_runs(spark, sf_dir)).withColumn("mean_seconds", F.round("mean_seconds", 3))


@query(with_(_R) + "SELECT status, count(*) AS n FROM runs WHERE created_at > TIMESTAMP '1997-12-01' GROUP BY 1")
def queue_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.by_state(_runs(spark, sf_dir), "1997-12-01")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 300 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id::BIGINT AS user_id, session::BIGINT AS session, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at FROM s GROUP BY 1, 2""")
def heartbeat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.heartbeat_gaps(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts"), "user_id", "ts")
    return out.select(F.col("user_id").cast("long").alias("user_id"), F.col("session").cast("long").alias("session"), "n", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"))


# --- sinks and whole runs ---------------------------------------------------

@query(with_(STAGES, ERRORS, CATEGORY, LOG) + """, x AS (SELECT row_number, count(*) AS n FROM log GROUP BY 1), z AS (SELECT row_number, array_to_string(list(message ORDER BY ord)[1:3], '; ') AS error_summary FROM e GROUP BY 1)
    SELECT row_number, error_category, q.n AS error_count, error_summary, coalesce(x.n, 0) AS attempted_fixes FROM q JOIN z USING (row_number) LEFT JOIN x USING (row_number)""")
def sink_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _checked(spark, sf_dir)
    return sinks.errors_table(checks.quarantined_rows(df)).select("row_number", "error_category", "error_count", "error_summary", "attempted_fixes")


@query(with_(STAGES, ERRORS) + "SELECT error_type, array_to_string(list(DISTINCT row_number ORDER BY row_number)[1:5], ',') AS examples FROM e GROUP BY 1")
def first_n_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_rows(_errors(spark, sf_dir), "error_type", 5).select("error_type", "examples")


@query(with_(STAGES, ERRORS, CATEGORY) + "SELECT row_number() OVER (ORDER BY row_number) AS place, row_number, n AS error_count FROM q")
def sort_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined rows in the order of the file, with their place."""
    rows = sinks.errors_table(checks.quarantined_rows(_checked(spark, sf_dir))).select("row_number", "error_count")
    return tabular.placed(rows, "place", by=("row_number",))


@query(with_(STAGES, LOG) + "SELECT row_number, \"column\", coalesce(before, '') AS before_value, coalesce(after, '') AS after_value, 'rule' AS source, 1.0::DOUBLE AS confidence FROM log")
def sink_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.diff_table(_log(spark, sf_dir)).select("row_number", "column", "before_value", "after_value", "source", "confidence")


@query(with_(STAGES, LOG) + """, d AS (SELECT row_number, "column", rule_id FROM log) SELECT row_number() OVER (ORDER BY row_number, "column", rule_id) AS place, row_number, "column" FROM d""")
def sort_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes in the order of the file, with their place."""
    rows = _log(spark, sf_dir).select("row_number", "column", "rule_id")
    return tabular.placed(rows, "place", by=("row_number", "column", "rule_id")).select("place", "row_number", "column")


@query(with_(STAGES, LOG) + "SELECT row_number, \"column\" AS column_name, before AS before_value, after AS after_value, rule_id FROM log")
def sink_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.audit_table(_log(spark, sf_dir), "run").select("row_number", "column_name", "before_value", "after_value", "rule_id")


# What the JSON texts hold beside that: ids, data, errors and fixes as texts.
_DETAIL = ", ".join(
    (
        "h AS (SELECT row_number, sha256(concat_ws('|', " + ", ".join(f"coalesce({c}, 'nan')" for c in COLUMNS) + ")) AS h FROM f)",
        "er AS (SELECT row_number, string_agg(concat_ws('|', \"column\", coalesce(value, 'null'), error_type, message), '; ' ORDER BY ord) AS errors, string_agg(message, '; ' ORDER BY ord) AS messages FROM e GROUP BY 1)",
        "fx AS (SELECT row_number, array_to_string(list_sort(list(concat_ws('|', \"column\", coalesce(before, 'null'), coalesce(after, 'null'), 'rule', '1.0'))), '; ') AS fixes FROM log GROUP BY 1)",
    )
)


@query(
    with_(STAGES, ERRORS, CATEGORY, LOG, _DETAIL) + f"""SELECT q.row_number, error_category AS category, n AS n_errors, s.dept AS department, (SELECT arg_min(message, ord) FROM e WHERE e.row_number = q.row_number) AS first_message,
    concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS row_uuid, concat_ws('|', {", ".join(f"coalesce(s.{c}, 'null')" for c in COLUMNS)}) AS data, errors, messages, coalesce(fixes, '') AS fixes
    FROM q JOIN {LAST} s USING (row_number) JOIN h USING (row_number) JOIN er USING (row_number) LEFT JOIN fx USING (row_number)"""
)
def sink_errors_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON texts, read again whole."""
    path = f"{sinks.scratch(spark)}/errors_json"
    sinks.errors_json(checks.quarantined_rows(_checked(spark, sf_dir))).select("detail").write.text(path, compression="lz4")
    detail = f"""row_uuid string, row_number long, error_category string, messages array<string>, data struct<{",".join(f"`{c}`:string" for c in COLUMNS.values())}>, errors array<struct<column:string,value:string,type:string,message:string>>,
        fixes array<struct<column:string,before_value:string,after_value:string,source:string,confidence:double,reason:string>>"""
    back = spark.read.json(path, schema=detail).select(F.struct("*").alias("d"))
    text = lambda *values: F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("null")) for v in values])
    return back.select(
        "d.row_number", F.col("d.error_category").alias("category"), F.size("d.errors").cast("long").alias("n_errors"), F.col("d.data.Department").alias("department"), F.get("d.errors", 0).message.alias("first_message"),
        "d.row_uuid", text(*[F.col(f"d.data.`{c}`") for c in COLUMNS.values()]).alias("data"), F.array_join(F.transform("d.errors", lambda x: text(x.column, x.value, x.type, x.message)), "; ").alias("errors"), F.array_join("d.messages", "; ").alias("messages"),
        F.array_join(F.array_sort(F.transform("d.fixes", lambda x: text(x.column, x.before_value, x.after_value, x.source, x.confidence))), "; ").alias("fixes"),
    )


@query(with_(STAGES, oracle.LOOSE) + f"SELECT row_number, {', '.join(COLUMNS)} FROM {LAST} WHERE row_number NOT IN (SELECT row_number FROM e)")
def sink_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.run(messy_ledger(spark, sf_dir), persist=False)
    return _short(sinks.cleaned_table(out.valid).drop("row_uuid"))


_WRITTEN = f"w AS (SELECT (SELECT count(*) FROM {LAST}) AS total, (SELECT count(DISTINCT row_number) FROM e) AS bad, (SELECT count(*) FROM log) AS changes)"


@query(with_(STAGES, oracle.LOOSE, LOG, _WRITTEN) + "SELECT 'cleaned' AS type, total - bad AS row_count FROM w UNION ALL SELECT 'errors', bad FROM w UNION ALL SELECT 'errors_json', bad FROM w UNION ALL SELECT 'diff', changes FROM w UNION ALL SELECT 'audit', changes FROM w UNION ALL SELECT unnest(['manifest', 'metrics', 'summary']), -1")
def artifact_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's artifacts, written, registered and listed."""
    base = sinks.scratch(spark)
    out = ledger.run(messy_ledger(spark, sf_dir), run_id="r")
    sinks.write_run(out, f"{base}/r", store=f"{base}/index")
    out.close()
    return registry.list_artifacts(spark.read.schema(registry.ARTIFACT).parquet(f"{base}/index"), "r").groupBy("type").agg(F.coalesce(F.max("row_count"), F.lit(-1)).alias("row_count"))


_ARTIFACTS = """SELECT concat('a', cast(o_orderkey AS STRING)) AS artifact_id, concat('run', cast(o_orderkey % 50 AS STRING)) AS run_id, o_orderpriority AS type, concat('f', cast(o_custkey AS STRING)) AS file_name, 'h' AS content_hash, 'p' AS storage_path,
    cast(o_custkey AS BIGINT) AS size_bytes, 'text/csv' AS mime_type, cast(o_orderkey % 9 AS BIGINT) AS row_count, cast(o_orderdate AS TIMESTAMP) AS created_at FROM {orders}"""
_A = "a AS (" + _ARTIFACTS.format(orders="orders") + ")"


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ARTIFACTS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


@query(with_(_A) + "SELECT row_number() OVER (ORDER BY created_at, artifact_id) AS place, artifact_id, type, file_name, size_bytes, row_count FROM a WHERE run_id = 'run7'")
def list_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.placed(registry.list_artifacts(_artifacts(spark, sf_dir), "run7"), "place").select("place", "artifact_id", "type", "file_name", "size_bytes", "row_count")


@query(with_(_A) + "SELECT artifact_id, run_id, type, size_bytes FROM a WHERE artifact_id = 'a11'")
def artifact_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended twice, fetched once."""
    store = f"{sinks.scratch(spark)}/index"
    for _ in range(2):
        registry.register(_artifacts(spark, sf_dir), store)
    return registry.get_artifact(spark.read.schema(registry.ARTIFACT).parquet(store), "a11").select("artifact_id", "run_id", "type", "size_bytes")


_CONTRACTS = "SELECT concat('c', cast(o_custkey % 20 AS STRING)) AS name, concat('1.', cast(o_orderkey AS STRING)) AS version, '{}' AS body, o_orderkey % 3 = 0 AS is_active, cast(o_orderdate AS TIMESTAMP) AS created_at FROM {orders}"
_C = "c AS (" + _CONTRACTS.replace("{orders}", "orders") + ")"


@query(with_(_C) + "SELECT row_number() OVER (ORDER BY name, version DESC) AS place, name, version FROM c WHERE is_active")
def list_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.sql(_CONTRACTS.replace("'{}'", "'{{}}'"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return tabular.placed(registry.list_schemas(stored), "place").select("place", "name", "version")


@query(with_(_C) + "SELECT name, version, body FROM c WHERE is_active AND name = 'c7' AND version = (SELECT max(version) FROM c WHERE is_active AND name = 'c7')")
def schema_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract of many, stored twice and fetched once by name and version."""
    store = f"{sinks.scratch(spark)}/contracts"
    contracts = spark.sql(_CONTRACTS.replace("'{}'", "'{{}}'"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    for _ in range(2):
        registry.register(contracts, store, "name")
    stored = spark.read.schema(registry.SCHEMA).parquet(store)
    wanted = stored.filter("is_active and name = 'c7'").agg(F.max("version").alias("v")).first().v
    return registry.get_schema(stored, "c7", wanted).select("name", "version", "body")


@query(with_(STAGES, oracle.LOOSE) + f"SELECT (SELECT count(*) FROM {LAST}) AS total_rows, (SELECT count(DISTINCT row_number) FROM e) AS quarantined_rows")
def work_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sinks.scratch(spark)
    with brief_shuffles(spark):
        messy_ledger(spark, sf_dir).drop("row_uuid", "row_number").repartition(1).write.option("header", True).csv(f"{base}/inbox")
    runs.watch(spark, f"{base}/inbox", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.json(f"{base}/out/*/metrics.json", schema="total_rows long, quarantined_rows long", multiLine=True)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w > 86400000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id::VARCHAR AS run_id, 'timed_out' AS outcome, (epoch_us(max(ts)) // 1000 + 86400000)::BIGINT AS at_ms, count(*) AS n_events FROM s GROUP BY user_id, session""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as heartbeats, replayed in micro-batches: each silence of more than a day
    comes out once, those at the end by their timers."""
    base = sinks.scratch(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("at"))
    ends = e.agg(F.min("at").alias("a"), F.max("at").alias("b"), F.expr("timestamp_millis(unix_millis(max(at)) + 400L * 86400000)").alias("c")).first()
    half = ends.a + (ends.b - ends.a) / 2
    parts = (e.filter(F.col("at") <= half), e.filter(F.col("at") > half), spark.createDataFrame([("the end", ends.c)], "run_id string, at timestamp"), spark.createDataFrame([("the end", ends.c)], "run_id string, at timestamp"))
    stream = spark.readStream.schema(heartbeats.EVENT).parquet(f"{base}/in/*")
    for k, part in enumerate(parts):
        event = part.select("run_id", "at", F.lit("heartbeat").alias("kind"), F.lit("w").alias("worker_id"), F.lit(None).cast("string").alias("phase"), F.lit(None).cast("int").alias("percent"), F.lit(None).cast("string").alias("status"))
        event.write.parquet(f"{base}/in/{k}")
        heartbeats.track(stream, f"{base}/out", f"{base}/checkpoint", timeout_s=86400).awaitTermination()
    found = spark.read.schema(heartbeats.OUTCOME).parquet(f"{base}/out").filter("run_id <> 'the end'")
    return found.select("run_id", "outcome", F.unix_millis("at").alias("at_ms"), "n_events")


# --- mechanisms beside the rows of the inventory -----------------------------

_BROKEN = "SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, o_orderkey::VARCHAR AS key, CASE o_orderkey % 4 WHEN 0 THEN 'two' || chr(10) || 'lines, \"quoted\"' WHEN 1 THEN 'a \"sign\" inside' WHEN 2 THEN o_orderpriority ELSE NULL END AS remark FROM orders"


@query(_BROKEN)
def scan_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files whose quoted values hold line breaks, read by blocks."""
    path = f"{sinks.scratch(spark)}/quoted"
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
    kind = F.col("o_orderkey") % 4
    remark = F.when(kind == 0, 'two\nlines, "quoted"').when(kind == 1, 'a "sign" inside').when(kind == 2, F.col("o_orderpriority"))
    o.select(F.col("o_orderkey").cast("string").alias("key"), remark.alias("remark")).write.option("header", True).option("escape", '"').csv(path)
    return tabular.read_table(spark, path).select("row_number", F.col("Key").alias("key"), F.col("Remark").alias("remark"))


@query(with_(STAGES, ERRORS) + "SELECT row_number, \"column\", error_type, message FROM e")
def error_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of each row by a table function, through SQL."""
    return lateral.error_rows(_checked(spark, sf_dir), "row_number")


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a ledger, merged from the stored states of two parts of it."""
    store = f"{sinks.scratch(spark)}/profiles"
    df = messy_ledger(spark, sf_dir)
    for part, half in (("even", F.col("row_number") % 2 == 0), ("odd", F.col("row_number") % 2 == 1), ("odd", F.col("row_number") % 2 == 1)):
        profiles.update(profiles.states(df.filter(half)), store, part)
    return profiles.merged(spark.read.parquet(store))


@query(with_(_F, _LONG) + f""", p AS (SELECT "column", {_VOTE} AS vote FROM v WHERE value IS NOT NULL), c AS (SELECT "column", vote, count(*) AS n, list_position(['integer','decimal','date','boolean','string'], vote) AS r FROM p GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, r) AS best FROM c), t AS (SELECT "column", vote FROM b WHERE best = 1),
    g AS (SELECT "column", count(*) AS n_rows, count(value) AS n_values, count(DISTINCT value) AS d, list_sort(list_distinct(list(value)))[1:20] AS low FROM v GROUP BY 1)
    SELECT "column", n_rows, n_values, n_values > 0.95 * n_rows AS required, vote AS data_type, CASE WHEN d <= 100 THEN d ELSE -1 END AS n_distinct, CASE WHEN d <= 100 AND d / n_values < 0.1 THEN array_to_string(low, '|') END AS enum_values FROM g JOIN t USING ("column")""")
def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, required columns and enums from all rows, through stored states; one part
    is stored twice and counts once."""
    return profiles.facts(_halves(spark, sf_dir)).select("column", "n_rows", "n_values", "required", "data_type", F.coalesce("n_distinct", F.lit(-1).cast("long")).alias("n_distinct"), F.array_join("enum", "|").alias("enum_values"))


@query(with_(_F, _LONG) + """, c AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL AND "column" IN ('Department', 'Created By') GROUP BY 1, 2) SELECT "column", value, n FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 3""")
def topk_values_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent values by merged sketches, which are exact for few values."""
    state = _halves(spark, sf_dir).filter(F.col("column").isin("Department", "Created By"))
    found = profiles.frequent(state, 20)
    place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return found.withColumn("place", place).filter("place <= 3").drop("place")


@query("SELECT unnest(['clerk_id', 'order_id']) AS \"column\" WHERE (SELECT count(DISTINCT o_orderkey) = count(*) FROM orders)")
def detect_primary_key_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without nulls and repeats in the whole table: a sketch picks, an exact
    count confirms."""
    k = F.col("o_orderkey")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.cast("long").alias("row_number"), k.cast("string").alias("order_id"), F.concat(F.lit("c"), k).alias("clerk_id"), F.when(k > 1, k).cast("string").alias("partly"), F.greatest(k, F.lit(2)).cast("string").alias("nearly"))
    return profiles.unique_columns(df, profiles.states(df))


@query(with_(_V, _UPSERT, _NOW.replace("FROM v)", "FROM u)")) + "SELECT variant_value, model_id, canonical_value, confidence FROM now")
def mapping_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in buckets: appended, compacted, appended to, read."""
    store = versions.VersionStore(spark, f"mappings_{uuid.uuid4().hex[:12]}", 4, sinks.scratch(spark))
    all_ = _versions(spark, sf_dir)
    store.append(all_.filter("is_approved"))
    store.append(all_.filter("not is_approved"))
    store.compact()
    store.append(spark.sql("SELECT 'Department' AS column_name, '5-LOW' AS variant_value, 'm0' AS model_id, 'Legal' AS canonical_value, 0.99D AS confidence, DATE '2030-01-01' AS created_at"))
    return store.current().select("variant_value", "model_id", "canonical_value", "confidence")


@query(with_(STAGES, LOG) + "SELECT row_number, \"column\" AS column_name, rule_id FROM log")
def audit_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's events, stored twice, are there once."""
    store = f"{sinks.scratch(spark)}/audit"
    audit = stored(sinks.audit_table(_log(spark, sf_dir), "run 7"))
    for _ in range(2):
        registry.replace(audit, store, "run 7")
    return spark.read.schema(registry.AUDIT).parquet(store).filter("run_id = 'run 7'").select("row_number", "column_name", "rule_id")


def _written(spark: SparkSession, sf_dir: str) -> str:
    base = sinks.scratch(spark)
    _ledger_file(spark, sf_dir, f"{base}/in")
    out = ledger.run(f"{base}/in", spark=spark, run_id="r")
    sinks.write_run(out, f"{base}/r")
    out.close()
    return f"{base}/r"


def _ledger_file(spark: SparkSession, sf_dir: str, path: str) -> None:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("p"))
    line = F.concat_ws(",", F.concat(F.lit("TXN-"), F.lpad(F.col("k").cast("string"), 7, "0")), F.when(F.col("k") % 3 == 0, F.concat(F.lit("-"), "p")).otherwise(F.col("p")), F.when(F.col("k") % 5 == 0, "sales").otherwise("HR"))
    sinks.one_text(o.orderBy("k").select(line.alias("value")), path, "txn_id,debit_amt,dept")


_INPUT = "i AS (SELECT 'txn_id,debit_amt,dept' || chr(10) || string_agg('TXN-' || lpad(o_orderkey::VARCHAR, 7, '0') || ',' || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '' END || o_totalprice::DECIMAL(18,2)::VARCHAR || ',' || CASE WHEN o_orderkey % 5 = 0 THEN 'sales' ELSE 'HR' END || chr(10), '' ORDER BY o_orderkey) AS content FROM orders)"


@query(with_(_INPUT) + "SELECT length(content) AS length, sha256(content) AS sha256 FROM i")
def sink_input_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the input beside the outputs."""
    return tabular.fingerprints(spark, f"{_written(spark, sf_dir)}/input", below=True).filter("path like '%.txt'").select("length", "sha256")


@query("SELECT count(*) AS total_rows, count(*) * 3 AS total_cells, 2 * count_if(o_orderkey % 3 = 0)::BIGINT + count_if(o_orderkey % 5 = 0)::BIGINT AS n_changes, count_if(o_orderkey % 3 = 0)::BIGINT AS quarantined_rows FROM orders")
def sink_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negative debit is moved, which logs both sides, and leaves an empty amount,
    which is no decimal."""
    return spark.read.json(f"{_written(spark, sf_dir)}/metrics.json", multiLine=True, schema="total_rows long, total_cells long, n_changes long, quarantined_rows long")


@query("SELECT 'r' AS run_id, 64::BIGINT AS key_length, true AS has_source, 20.0::DOUBLE AS edit_cap_pct, (SELECT count(*) FROM orders) > 0 AS ran")
def sink_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.read.json(f"{_written(spark, sf_dir)}/manifest.json", multiLine=True, schema="run_id string, idempotency_key string, source string, options struct<edit_cap_pct:double>")
    return m.select("run_id", F.length("idempotency_key").cast("long").alias("key_length"), F.col("source").isNotNull().alias("has_source"), F.col("options.edit_cap_pct").alias("edit_cap_pct"), F.lit(True).alias("ran"))


@query("SELECT unnest(['total_rows', 'clean_rows', 'quarantined_rows']) AS figure, unnest([n, n - bad, bad]) AS value FROM (SELECT count(*) AS n, count_if(o_orderkey % 3 = 0)::BIGINT AS bad FROM orders)")
def sink_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the report, read from its table."""
    lines = spark.read.text(f"{_written(spark, sf_dir)}/summary.md")
    cell = lambda k: F.trim(F.element_at(F.split("value", r"\|"), k))
    return lines.filter("value rlike '^[|] (total_rows|clean_rows|quarantined_rows) '").select(cell(2).alias("figure"), F.replace(cell(3), F.lit(","), F.lit("")).cast("long").alias("value"))


@query(with_(STAGES, ERRORS, CATEGORY, RESIDUAL, MAPPED) + f", a AS ({_APPLIED}) SELECT dept AS department, count(*) AS n_rows, count_if(q.row_number IS NULL)::BIGINT AS clean_rows FROM a LEFT JOIN q USING (row_number) GROUP BY 1")
def ledger_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: rules, mapping and checks in one plan, then clean rows by
    department.  Mapping changes names only, which the strict checks let pass."""
    checked = checks.check(_mapped_rows(spark, sf_dir), strict_contract())
    return checked.groupBy(F.col("Department").alias("department")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("__errors") == 0).alias("clean_rows"))


