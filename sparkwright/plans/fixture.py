"""A messy ledger made from ``orders``: one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwright.contract import DATE, DECIMAL, ColumnSpec, TableContract
from sparkwright.functions.identifiers import row_uuid
from sparkwright.sources.tabular import spread

#: Short name in SQL -> column of the ledger.
COLUMNS = {
    "txn": "Transaction ID", "date": "Date", "code": "Account Code", "acct": "Account Name", "descr": "Description",
    "debit": "Debit Amount", "credit": "Credit Amount", "dept": "Department", "ref": "Reference Number", "creator": "Created By",
}

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_Y, _M, _D = "cast(year(o_orderdate) AS STRING)", "cast(month(o_orderdate) AS STRING)", "cast(day(o_orderdate) AS STRING)"
_MON = f"substr('{_MONTHS}', cast(month(o_orderdate) AS INT) * 3 - 2, 3)"
_AMOUNT = "cast(cast(o_totalprice AS DECIMAL(18,2)) AS STRING)"

#: ``{orders}`` stands for the table; k is its key.
SQL = f"""
SELECT k AS row_number,
  CASE WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN 'duplicate' WHEN k % 47 = 0 THEN 'TXN-7' WHEN k % 5 = 0 THEN concat('TXN', ks)
       WHEN k % 5 = 1 THEN concat('txn_', ks) WHEN k % 5 = 2 THEN ks WHEN k % 5 = 3 THEN concat('TXN ', ks) ELSE concat('TXN-', lpad(ks, 7, '0')) END AS txn,
  CASE k % 7 WHEN 0 THEN concat({_Y}, '-', lpad({_M}, 2, '0'), '-', lpad({_D}, 2, '0')) WHEN 1 THEN concat(lpad({_M}, 2, '0'), '/', lpad({_D}, 2, '0'), '/', {_Y})
       WHEN 2 THEN concat({_Y}, '/', {_M}, '/', {_D}) WHEN 3 THEN concat({_MON}, ' ', {_D}, ' ', {_Y}) WHEN 4 THEN concat(lpad({_D}, 2, '0'), '-', {_MON}, '-', {_Y})
       WHEN 5 THEN concat({_Y}, '.', lpad({_M}, 2, '0'), '.', lpad({_D}, 2, '0')) ELSE 'not-a-date' END AS date,
  concat(CASE WHEN k % 3 = 0 THEN ' ac' ELSE 'AC' END, cast(k % 50 AS STRING)) AS code,
  CASE k % 12 WHEN 0 THEN 'cash' WHEN 1 THEN 'A/R' WHEN 2 THEN 'accounts payable' WHEN 3 THEN 'COGS' WHEN 4 THEN 'Revenue' WHEN 5 THEN 'Office Supplies'
       WHEN 6 THEN 'freight  expense' WHEN 7 THEN 'Petty Cash' WHEN 8 THEN 'COST OF THE SALES' WHEN 9 THEN NULL WHEN 10 THEN 'Inventory' ELSE 'o''brien e-mail 3d' END AS acct,
  CASE k % 4 WHEN 0 THEN '  paid   by card!! ' WHEN 1 THEN 'Ø total μ ∞ due' WHEN 2 THEN 'plain text' ELSE NULL END AS descr,
  CASE WHEN k % 2 = 1 THEN NULL WHEN k % 6 = 0 THEN {_AMOUNT} WHEN k % 6 = 2 THEN concat('$', {_AMOUNT}) ELSE concat('(', {_AMOUNT}, ')') END AS debit,
  CASE WHEN k % 2 = 1 OR k % 31 = 0 THEN {_AMOUNT} ELSE NULL END AS credit,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'SALES' WHEN '2-HIGH' THEN 'ops' WHEN '3-MEDIUM' THEN '  Human   Resources ' WHEN '4-NOT SPECIFIED' THEN 'Tech Support' ELSE 'UNKNOWN' END AS dept,
  CASE k % 3 WHEN 0 THEN concat('REF_', ks) WHEN 1 THEN concat('ref', ks) ELSE 'PENDING' END AS ref,
  concat('user  ', cast(o_custkey % 7 AS STRING), '!') AS creator
FROM (SELECT *, cast(o_orderkey AS BIGINT) AS k, cast(o_orderkey AS STRING) AS ks FROM {{orders}}) AS o
"""


def messy_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation with the ledger's column names, ``row_uuid`` and ``row_number``."""
    rows = spark.sql(SQL, orders=spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")))
    named = rows.withColumnsRenamed(COLUMNS)
    return named.withColumn("row_uuid", row_uuid([named[f"`{c}`"] for c in COLUMNS.values()]))


#: Account codes that the strict contract allows.
CODES = tuple(f"AC{k}" for k in range(40))


def strict_contract() -> TableContract:
    """A contract with every kind of check."""
    return TableContract(
        (
            ColumnSpec("Transaction ID"),
            ColumnSpec("Date", DATE, required=True),
            ColumnSpec("Account Code", enum=CODES),
            ColumnSpec("Account Name", required=True, mappable=True),
            ColumnSpec("Description", min_length=8, max_length=11),
            ColumnSpec("Debit Amount", DECIMAL),
            ColumnSpec("Credit Amount", DECIMAL),
            ColumnSpec("Department", required=True, enum=("Sales", "Operations", "HR"), mappable=True),
            ColumnSpec("Reference Number", pattern=r"REF-\d+$"),
            ColumnSpec("Created By", required=True),
        ),
        debit_xor_credit=True,
    )
