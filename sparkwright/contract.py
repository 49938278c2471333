"""Column contracts and run options."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

STRING, INTEGER, DECIMAL, DATE, BOOLEAN = "string", "integer", "decimal", "date", "boolean"
SYSTEM_COLUMNS = ("row_uuid", "row_number")

# Columns that may be mapped without force, and the canonical names.
MAPPABLE_COLUMNS = ("department", "account_name", "category", "type", "status")
CANONICAL_DEPARTMENTS = ("Sales", "Operations", "Admin", "IT", "Finance", "Marketing", "HR", "Legal", "Engineering", "Support")
CANONICAL_ACCOUNTS = ("Cash", "Accounts Receivable", "Accounts Payable", "Sales Revenue", "Cost of Goods Sold", "Operating Expenses", "Equipment", "Inventory", "Retained Earnings")


@dataclass(frozen=True)
class ColumnSpec:
    """What one column must be like.  The bounds, ``date_format`` and custom
    predicates are extra checks and off unless given."""

    name: str
    type: str = STRING
    required: bool = False
    mappable: bool = False
    enum: tuple[str, ...] = ()
    pattern: str | None = None
    min_length: int = 0
    max_length: int = 0
    min_value: str | None = None
    max_value: str | None = None
    primary_key: bool = False

    def field(self) -> T.StructField:
        """The column as Spark sees it; the contract travels in the metadata."""
        facts = {k: v for k, v in vars(self).items() if v not in (None, (), 0, False, "")}
        return T.StructField(self.name, T.StringType(), not self.required, {k: list(v) if isinstance(v, tuple) else v for k, v in facts.items()})


@dataclass(frozen=True)
class TableContract:
    columns: tuple[ColumnSpec, ...]
    debit_xor_credit: bool = False
    unique: tuple[tuple[str, ...], ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    departments: tuple[str, ...] = CANONICAL_DEPARTMENTS
    accounts: tuple[str, ...] = CANONICAL_ACCOUNTS
    version: str = "1.0.0"

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError("a contract names each column once")

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def get(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    def canonical(self, name: str) -> tuple[str, ...]:
        """Canonical values of a column: a fixed list by its name, else its enum."""
        folded = name.lower().replace("_", " ")
        if folded in ("department", "dept"):
            return self.departments
        if folded in ("account name", "account"):
            return self.accounts
        spec = self.get(name)
        return spec.enum if spec else ()


@dataclass(frozen=True)
class RunOptions:
    """Options of a run.  ``row_limit`` and ``byte_limit`` are off by default:
    they guarded a single machine."""

    use_inferred: bool = False
    acknowledge_experimental: bool = False
    force_map_columns: bool = False
    dry_run: bool = False
    map_columns: tuple[str, ...] = ("Department", "Account Name")
    edit_cap_pct: float = 20.0
    confidence_floor: float = 0.80
    row_limit: int | None = None
    byte_limit: int | None = None
    batch_size: int = 15
    log_all_numbers: bool = False
    empty_is_null: bool = False

    def problem(self) -> str | None:
        """Why the options may not be used together, if so: an inferred contract
        must be acknowledged, and columns that are not usually mapped be forced."""
        if self.use_inferred and not self.acknowledge_experimental:
            return "an inferred contract is experimental: set acknowledge_experimental"
        odd = [c for c in self.map_columns if re.sub(r"[\s-]+", "_", c.strip().lower()) not in MAPPABLE_COLUMNS]
        if odd and not self.force_map_columns:
            return f"columns that are not usually mapped: {', '.join(odd)}; set force_map_columns"
        return None


def ledger_contract() -> TableContract:
    """The ten ledger columns; nothing required, no rule across columns."""
    kinds = {"Date": DATE, "Debit Amount": DECIMAL, "Credit Amount": DECIMAL}
    names = ("Transaction ID", "Date", "Account Code", "Account Name", "Description", "Debit Amount", "Credit Amount", "Department", "Reference Number", "Created By")
    return TableContract(tuple(ColumnSpec(n, kinds.get(n, STRING), mappable=n in ("Department", "Account Name")) for n in names))
