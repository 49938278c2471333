"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.exact import digest_filter, may_hold, probed
from sparkwright.llm.shared import exists, fresh, named, new_path, written
from sparkwright.llm.text import slices, texts

#: Base rules: kind, version, pattern, what a match must be like.  Offsets are
#: code points of the whole match; matches of a kind do not overlap.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Rules beyond the base ones.
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
_PEM_LINES = re.compile(r"(?:(?:\s|\\[nr])+(?:(?:Proc-Type|DEK-Info):[^\n\\]*|[A-Za-z0-9+/]{16,}={0,2}))*(?:(?:\s|\\[nr])+[A-Za-z0-9+/]+={1,2})?")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")

BASE_KINDS = ("assign", "access", "hex")


def _assign(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if _WORD.search(text) else []


def _access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []


def _hex(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _HEX.finditer(text)]  # a run of 24 or more is the whole run


def _pem(text: str) -> list[tuple[int, int]]:
    """Each key to its END line; if none comes before the next key, to the end of
    its base64 lines."""
    heads = list(_PEM.finditer(text)) if "-----BEGIN" in text else []
    out = []
    for m, limit in zip(heads, [*(x.start() for x in heads[1:]), len(text)]):
        end = f"-----END {m[1]}-----"
        at = text.find(end, m.end(), limit)
        out.append((m.start(), at + len(end) if at >= 0 else _PEM_LINES.match(text, m.end(), limit).end()))
    return out


def _jwt(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _JWT.finditer(text)] if "eyJ" in text else []


#: (kind, version) -> finder.  A changed rule gets a higher version and is then
#: unseen for every blob.
RULES = {("assign", 1): _assign, ("access", 1): _access, ("hex", 1): _hex, ("pem", 2): _pem, ("jwt", 1): _jwt}

SPANS = "array<struct<start:int,stop:int>>"


TODO = "array<struct<kind:string,version:int>>"


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class BlobLedger:
    """Which blobs (SHA-256 of a text) were scanned by which rule version, and
    what was found.  A Parquet table in ``path``, which need not exist yet: one
    row per pair, findings as an array of spans, empty where there were none, so
    that a clean blob is not scanned again either.  Two scans at once, or one that
    is tried again after it was written, leave a pair twice, with equal spans;
    those who read findings take equal spans of a blob once."""

    SCHEMA = f"blob binary, kind string, version int, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str | None = None, rules: dict | None = None):
        self.spark, self.path, self.rules = spark, path or new_path(spark, "blob-ledger"), dict(rules or RULES)
        self._empty = not path or not exists(spark, path)

    def read(self) -> DataFrame:
        if self._empty:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def unseen(self, versions: DataFrame, text_col: str = "text") -> DataFrame:
        """(blob, text, todo) of the versions that some rule has not seen.  Which
        they are is found from digests alone; a filter of theirs then tells the
        texts, so those that every rule has seen are in no shuffle, but for the
        filter's few false hits."""
        text = F.coalesce(named(text_col).cast("string"), F.lit(""))
        digested = versions.select(_blob(text).alias("blob"), text.alias("text"))
        rules = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v in self.rules]).cast(TODO)
        if self._empty:
            return digested.withColumn("todo", rules)
        seen = self.read().groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        todo = F.array_except(rules, F.coalesce(F.col("seen").cast(TODO), F.array().cast(TODO)))
        left = digested.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)
        left = written(left, "unseen")
        return may_hold(digested, digest_filter(left.select(F.col("blob").alias("digest"))), "blob").join(left, "blob")

    def scan(self, versions: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds the unseen pairs of blobs in ``versions`` and rules to the ledger;
        returns (blob, kind, version, spans) of the present rules' findings.

        The shuffle by digest carries each distinct text that is to be scanned
        once per task that read it.
        """
        keys = list(self.rules)
        digested = self.unseen(versions, text_col)
        blobs = digested.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
        rules = self.rules

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = []
                    for blob, text, todo in zip(part.column("blob").to_pylist(), texts(part, "text"), part.column("todo").to_pylist()):
                        for rule in todo:
                            key = rule["kind"], rule["version"]
                            rows.append((blob, *key, [{"start": a, "stop": b} for a, b in rules[key](text)]))
                    a, b, c, d = zip(*rows) if rows else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.string()), pa.array(c, pa.int32()), pa.array(d, kind)], ["blob", "kind", "version", "spans"])

        blobs.mapInArrow(run, self.SCHEMA).write.mode("append").option("compression", "zstd").parquet(self.path)
        self._empty = False
        present = self.spark.createDataFrame(keys, "kind string, version int")
        return self.read().filter(F.size("spans") > 0).join(F.broadcast(present), ["kind", "version"], "left_semi")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """One row per input row: ``doc_id, blob, found`` where ``found`` is an array
    of (start, rank, kind, stop) sorted by start, then by the rules' order.

    Only blobs and rule versions that the ledger has not seen are scanned; the
    findings are then joined to every path (row) that holds the blob.  Null
    text: empty, no finding.  Null ids stay null.  Repeated rows and copies share
    their blob's findings.  An empty table gives an empty result.  Other columns
    are not read.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    findings = ledger.scan(docs.select(named(text_col).alias("text")))
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, (k, _) in enumerate(ledger.rules)])
    flat = findings.select("blob", order.alias("rank"), "kind", F.explode("spans").alias("s")).select("blob", F.struct(F.col("s.start").alias("start"), "rank", "kind", F.col("s.stop").alias("stop")).alias("x"))
    by_blob = written(flat.groupBy("blob").agg(F.sort_array(F.collect_set("x")).alias("found")), "findings")
    paths = docs.select(named(id_col).cast("long").alias("doc_id"), _blob(named(text_col)).alias("blob"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans as text: one
    row per input row, null text as empty, null ids as they are, other columns
    not read, an empty table empty."""
    base = F.filter("found", lambda x: x.kind.isin(*BASE_KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return secret_spans(docs).select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", ledger: BlobLedger | None = None) -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by ``mark``;
    overlapping spans give one mark.  All columns stay, whatever their names, and
    so do all rows; a row without findings is unchanged, null text included.

    Only texts whose digest may have findings, by a filter, are shuffled to meet
    them; a large group of copies is split by adaptive execution.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    findings = ledger.scan(docs.select(named(text_col).alias("text")))
    flat = findings.select("blob", F.explode("spans").alias("s")).select("blob", F.struct("s.start", "s.stop").alias("x"))
    by_blob = flat.groupBy("blob").agg(F.sort_array(F.collect_set("x")).alias("found"))
    # Spans joined where they overlap: the state is (joined spans, open start, open end).
    start = F.struct(F.array().cast(SPANS).alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    closed = lambda s: F.when(s.a < 0, s.done).otherwise(F.concat(s.done, F.array(F.struct(s.a.alias("start"), s.b.alias("stop")))))
    step = lambda s, x: F.when((s.a >= 0) & (x.start < s.b), F.struct(s.done.alias("done"), s.a.alias("a"), F.greatest(s.b, x.stop).alias("b"))).otherwise(F.struct(closed(s).alias("done"), x.start.alias("a"), x.stop.alias("b")))
    blob, joined, held = fresh(docs, "blob", "spans", "held")
    by_blob = written(by_blob.select(named("blob").alias(blob), F.aggregate("found", start, step, closed).alias(joined)), "findings")
    text, spans = named(text_col), named(joined)
    piece = F.transform(spans, lambda x, i: F.concat(F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.get(spans, i - 1).stop + 1), x.start - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1).stop)), F.lit(mark)))
    clean = F.concat(F.array_join(piece, ""), F.substring(text, F.get(spans, F.size(spans) - 1).stop + 1, F.length(text)))
    filter_ = digest_filter(by_blob.select(named(blob).alias("digest")))
    rows = probed(docs.withColumn(blob, _blob(text)), filter_, held, blob)
    hit = rows.filter(named(held)).join(by_blob, blob, "left")
    hit = hit.select(*[F.when(spans.isNull(), text).otherwise(clean).alias(c) if c == text_col else named(c) for c in docs.columns])
    return rows.filter(~named(held)).select(*map(named, docs.columns)).unionByName(hit)
