"""Headers as rows: names of columns of many files at once, as Column functions and
joins.  The functions of single names are in ``sources.tabular``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.contract import TableContract
from sparkwright.functions.strings import looked_up, squeezed
from sparkwright.sources.tabular import HEADER_SYNONYMS

# Other names of the ledger's columns, as they are after folding.
HEADER_NAMES = {
    "Transaction ID": ("transaction_id", "trans_id", "txn_id", "transactionid", "transaction_number", "trans_number", "trans_no", "transaction_no"),
    "Date": ("date", "transaction_date", "trans_date", "txn_date", "posting_date", "value_date", "effective_date"),
    "Account Code": ("account_code", "acct_code", "account_cd", "acct_cd", "acc_code", "accountcode", "gl_code", "gl_account"),
    "Account Name": ("account_name", "acct_name", "account_nm", "acct_nm", "accountname", "gl_name", "gl_account_name"),
    "Description": ("description", "desc", "transaction_description", "trans_desc", "narrative", "particulars", "details"),
    "Debit Amount": ("debit_amount", "debit_amt", "debit", "dr_amount", "dr_amt", "dr", "debitamount"),
    "Credit Amount": ("credit_amount", "credit_amt", "credit", "cr_amount", "cr_amt", "cr", "creditamount"),
    "Department": ("department", "dept", "cost_center", "cost_centre", "cc", "division", "business_unit", "bu"),
    "Reference Number": ("reference_number", "ref_number", "ref_no", "ref_num", "reference", "ref", "invoice_number", "invoice_no", "document_number", "doc_no"),
    "Created By": ("created_by", "created_user", "user", "username", "entered_by", "posted_by", "modified_by", "last_modified_by"),
}
HEADER_DICTIONARY = {name: canonical for canonical, names in HEADER_NAMES.items() for name in names}


def normalized_headers(c: Column) -> Column:
    """Without quotes, words apart and begun in upper case, synonyms replaced."""
    words = F.initcap(squeezed(F.translate(F.btrim(c, F.lit("\"'")), "_-", "  ")))
    return F.coalesce(looked_up(F.lower(words), {k.lower(): v for k, v in HEADER_SYNONYMS.items()}), words)


def mapped_headers(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    """A probe of a dictionary (``HEADER_DICTIONARY``, unless given) after folding;
    names that it does not have stay as they are."""
    probe = F.regexp_replace(F.lower(squeezed(c)), r"[\s-]+", "_")
    probe = F.regexp_replace(F.regexp_replace(probe, "^(tbl_|col_|fld_)", ""), "(_col|_fld|_field)$", "")
    return F.coalesce(looked_up(probe, HEADER_DICTIONARY if synonyms is None else synonyms), c)


def missing_by_file(headers: DataFrame, contract: TableContract, fold_case: bool = True) -> DataFrame:
    """(file, missing): the required columns of a contract that each file of a table
    (file, header) does not have, in any case unless ``fold_case`` is off."""
    spark = headers.sparkSession
    key = (lambda c: F.lower(F.trim(c))) if fold_case else (lambda c: F.col(c) if isinstance(c, str) else c)
    required = spark.createDataFrame([(c.name,) for c in contract.columns if c.required], "missing string")  # a contract's columns
    wanted = headers.select("file").distinct().crossJoin(F.broadcast(required))
    there = headers.select("file", key("header").alias("key")).distinct()
    return wanted.withColumn("key", key("missing")).join(there, ["file", "key"], "left_anti").select("file", "missing")
