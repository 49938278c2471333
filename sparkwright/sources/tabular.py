"""CSV files as tables of text with row ids."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.contract import RunOptions, TableContract
from sparkwright.functions.identifiers import row_uuid
from sparkwright.sources.hashing import fingerprints
from sparkwright.sources.quoted import read_quoted
from sparkwright.sources.scratch import scratch, stored

# Texts that are null, candidates for the delimiter, header synonyms.
NULL_TOKENS = ("", "NA", "N/A", "NULL", "null", "None", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "NaN", "n/a", "nan")
DELIMITERS = (",", "\t", "|", ";", ":")
HEADER_SYNONYMS = {
    "Txn Id": "Transaction ID", "Trans Id": "Transaction ID", "Transaction Id": "Transaction ID", "Acct Code": "Account Code", "Account Cd": "Account Code", "Acct Name": "Account Name", "Account Nm": "Account Name", "Dept": "Department",
    "Debit Amt": "Debit Amount", "Credit Amt": "Credit Amount", "Ref Number": "Reference Number", "Ref Num": "Reference Number", "Ref No": "Reference Number", "Created Date": "Created By", "Created User": "Created By", "User": "Created By",
}


def normalized_header(name: str, aliases: dict[str, str] | None = None) -> str:
    name = name.strip("\"'").strip()
    for alias, canonical in (aliases or {}).items():
        if alias.lower() == name.lower():
            return canonical
    words = " ".join(w.capitalize() for w in re.sub("[_-]", " ", name).split())
    return next((v for k, v in HEADER_SYNONYMS.items() if k.lower() == words.lower()), words)


def mapped_header(name: str, synonyms: dict[str, str]) -> str:
    """A dictionary probe after folding: blanks and hyphens to ``_``, without the
    prefixes tbl_ col_ fld_ and the suffixes _col _fld _field."""
    probe = re.sub(r"(_col|_fld|_field)$", "", re.sub(r"^(tbl_|col_|fld_)", "", re.sub(r"[\s-]+", "_", name.strip().lower())))
    return synonyms.get(probe, name)


def missing_headers(names: list[str], contract: TableContract) -> list[str]:
    low = {n.lower() for n in names}
    return [c.name for c in contract.columns if c.required and c.name.lower() not in low]


def delimiter_of(lines: list[str]) -> str:
    """Ten times the count where all lines have the same, else that of the first
    line; the first candidate wins ties, a comma where nothing is found."""
    lines, best, score = lines[:10], ",", 0
    for d in DELIMITERS if len(lines) > 1 else ():
        counts = [x.count(d) for x in lines]
        points = counts[0] * 10 if counts[0] and len(set(counts)) == 1 else counts[0]
        if points > score:
            best, score = d, points
    return best


def delimiter_scores(lines: DataFrame) -> DataFrame:
    """The same over a table of (n, value): scores of all candidates."""
    head = lines.orderBy("n").limit(10)
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("delimiter"), (F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias("c")) for k, d in enumerate(DELIMITERS)])
    out = head.select("n", F.explode(each).alias("x")).groupBy("x.k", "x.delimiter").agg(F.min("x.c").alias("low"), F.max("x.c").alias("high"), F.min(F.struct("n", "x.c")).alias("first"))
    return out.select("k", "delimiter", F.when((F.col("low") == F.col("high")) & (F.col("low") > 0), F.col("low") * 10).otherwise(F.col("first.c")).cast("long").alias("score"))


@dataclass(frozen=True)
class Shape:
    """How a file is to be read: its encoding, and whether quoted values may hold line
    breaks, so that it cannot be cut at each of them."""

    encoding: str
    broken_lines: bool


def shape_of(spark: SparkSession, path: str) -> Shape:
    """One pass over the lines, which are cut by bytes: UTF-8 if all are, else
    Latin-1, which every byte string is; a line with an odd number of quotes means
    that a value goes on in the next one."""
    lines = spark.read.text(path)
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    r = lines.agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"), F.coalesce(F.bool_or(odd % 2 == 1), F.lit(False)).alias("odd")).first()
    return Shape("UTF-8" if r.utf8 else "ISO-8859-1", r.odd)


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding) of each of many files, from one pass over their lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    utf8 = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    return utf8.select("file", F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"))


def over_limit(spark: SparkSession, path: str, byte_limit: int) -> DataFrame:
    """(path, length, refused) of files: whether each has more bytes than the limit."""
    return spark.read.format("binaryFile").load(path).select("path", "length", (F.col("length") > byte_limit).alias("refused"))


def encoding_of(spark: SparkSession, path: str) -> str:
    return shape_of(spark, path).encoding


#: Helper columns of stored rows.
_PART, _BLOCK, _ID = "__part", "__block", "__id"


def _offset(rows: DataFrame, by: list[str], name: str, start: int) -> DataFrame:
    """Stored ``rows`` with their place: those of each group ``by`` are counted, the
    groups follow one another in the order of ``by``, and ``_ID`` rises by one from
    row to row of a group.  A row of a group that was not counted is an error."""
    spark, names = rows.sparkSession, [c for c in rows.columns if c not in (*by, _ID)]
    found = rows.groupBy(*by).agg(F.min(_ID).alias("first"), F.count(F.lit(1)).alias("n")).collect()  # a row for each group
    table, total = [], start
    for r in sorted(found, key=lambda r: tuple(r)):
        table.append((*r[: len(by)], total - r.first))
        total += r.n
    offsets = spark.createDataFrame(table, ", ".join([f"{rows.select(c).schema[0].name} {rows.select(c).schema[0].dataType.simpleString()}" for c in by] + ["__offset long"]))
    at = F.col(_ID) + F.coalesce("__offset", F.raise_error(F.lit("rows without a count")).cast("long"))
    return rows.join(F.broadcast(offsets), by, "left").select(*[F.col(f"`{c}`") for c in names], at.alias(name))


def numbered(raw: DataFrame, start: int = 1) -> DataFrame:
    """A table read from files with ``row_number``: by path, then by place in the
    file.  Rows are stored once with their file block; only counts of blocks go to
    the driver, and nothing is sorted or sent to one task."""
    rows = stored(raw.select("*", F.col("_metadata.file_path").alias(_PART), F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias(_ID)))
    return _offset(rows, [_PART, _BLOCK], "row_number", start)


def placed(df: DataFrame, name: str, start: int = 1, by: tuple[str | Column, ...] = ()) -> DataFrame:
    """Each row's place in the order of ``df``, or in the order ``by`` (ties as they
    come), in a column ``name``.

    Rows are written once with the partition and the position that they have there;
    counts, offsets and the result come from that table, so a sort whose bounds or
    partitions would differ in a second run runs once.  With ``by``, ``df`` itself
    is stored before, so the sort's sampling does not run it again.
    """
    if by:
        df = stored(df).orderBy(*by)
    rows = stored(df.withColumn(_ID, F.monotonically_increasing_id()))
    return _offset(rows.withColumn(_PART, F.shiftright(_ID, 33)), [_PART], name, start)


#: Rows of a task that applies rules and checks.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer parts than there are cores, or in parts of more than
    some ``TASK_ROWS`` rows, is dealt out anew, so a task's time and memory do not grow
    with the table.  Spark cuts files into as many parts as there are cores until a part
    has 128 MB, which are millions of short rows.  Of Parquet, only footers are counted."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(1, -(-df.count() // (TASK_ROWS * cores)))  # whole rounds of tasks
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def nulled(df: DataFrame, columns: list[str] | None = None, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Null tokens of ``columns`` (all, unless given) as nulls."""
    some = set(df.columns if columns is None else columns)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if c in some else F.col(f"`{c}`") for c in df.columns])


def read_table(spark: SparkSession, path: str, contract: TableContract | None = None, options: RunOptions = RunOptions(), lenient: bool = False) -> DataFrame:
    """Every column as text, headers normalised, with ``row_uuid`` and
    ``row_number``.  ``path`` is whatever Spark reads: a file, a folder, an object
    store.  ``lenient`` drops malformed lines and keeps null tokens as they are.
    Files are cut into tasks also where quoted values hold line breaks
    (``sources.quoted``).  ``row_number`` counts rows by path, then by place."""
    shape = shape_of(spark, path)
    head = [r.value for r in spark.read.option("encoding", shape.encoding).text(path).limit(10).collect()]
    sep = delimiter_of([h.lstrip("﻿") for h in head])
    if shape.broken_lines:
        raw, found = read_quoted(spark, path, sep, shape.encoding, lenient)
    else:
        reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("encoding", shape.encoding)
        raw = reader.option("mode", "DROPMALFORMED" if lenient else "PERMISSIVE").csv(path)
        found = raw.columns
    names = [normalized_header(c.lstrip("﻿"), contract.aliases if contract else None) for c in found]
    names = [n if n not in names[:k] else f"{n} {k}" for k, n in enumerate(names)]
    if options.row_limit is not None and raw.limit(options.row_limit + 1).count() > options.row_limit:
        raise ValueError(f"more than {options.row_limit} rows")
    df = (raw if shape.broken_lines else numbered(raw)).toDF(*names, "row_number")
    df = spread(df if lenient else nulled(df, names))
    return df.select(row_uuid([F.col(f"`{c}`") for c in names]).alias("row_uuid"), "row_number", *[F.col(f"`{c}`") for c in names])


def read_bytes(spark: SparkSession, content: bytes, contract: TableContract | None = None, options: RunOptions = RunOptions()) -> DataFrame:
    """A small upload: its bytes go through the driver into the shared folder."""
    if options.byte_limit is not None and len(content) > options.byte_limit:
        raise ValueError(f"more than {options.byte_limit} bytes")
    from sparkwright.sources.sinks import put_bytes

    path = f"{scratch(spark)}/input.csv"
    put_bytes(spark, path, content)
    return read_table(spark, path, contract, options)


@dataclass(frozen=True)
class Ingested:
    """A file as a table, the hash of its bytes, and original -> normalised header."""

    table: DataFrame
    fingerprint: str
    headers: dict[str, str]


def ingest(spark: SparkSession, path: str, contract: TableContract | None = None, options: RunOptions = RunOptions()) -> Ingested:
    """Reads a file or the files of a folder; with ``use_inferred`` headers keep
    their own names, so that a contract can be inferred from them.  Of several
    files, the hash is that of their hashes in the order of their paths."""
    if problem := options.problem():
        raise ValueError(problem)
    hashes = [r.sha256 for r in fingerprints(spark, path).orderBy("path").collect()]  # one for each file
    whole = hashes[0] if len(hashes) == 1 else hashlib.sha256("".join(hashes).encode()).hexdigest()
    shape = shape_of(spark, path)
    head = [r.value for r in spark.read.option("encoding", shape.encoding).text(path).limit(10).collect()]
    names = spark.read.option("header", True).option("sep", delimiter_of(head)).option("quote", '"').option("escape", '"').option("encoding", shape.encoding).csv(path).columns
    names = [n.lstrip("\ufeff") for n in names]
    aliases = None if contract is None else contract.aliases
    return Ingested(read_table(spark, path, contract, options), whole, {n: normalized_header(n, aliases) for n in names})
