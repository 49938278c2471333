"""Deterministic rules.  A rule is data: which columns it is for, what value it
gives, which changes it logs.  All rules fold into one projection; the log is an
array column beside the values, exploded once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.contract import STRING, SYSTEM_COLUMNS, TableContract
from sparkwright.functions import amounts, dates, identifiers, strings
from sparkwright.functions.memo import remembered

CHANGES = "__changes"
CHANGE = "array<struct<ord:int,column:string,before:string,after:string,rule_id:string,reason:string>>"

# Dictionaries, variant -> canonical name.
DEPARTMENTS = {
    "SALES": "Sales", "sales": "Sales",
    "operations": "Operations", "OPERATIONS": "Operations", "OPS": "Operations", "Ops": "Operations", "ops": "Operations", "Maintenance": "Operations", "Facilities": "Operations",
    "ADMIN": "Admin", "admin": "Admin", "Administration": "Admin", "General": "Admin",
    "It": "IT", "Information Technology": "IT", "Tech": "IT", "Technology": "IT",
    "FINANCE": "Finance", "finance": "Finance", "Treasury": "Finance",
    "marketing": "Marketing", "MARKETING": "Marketing", "MKT": "Marketing", "Mkt": "Marketing",
    "Hr": "HR", "hr": "HR", "Human Resources": "HR",
    "Legal": "Legal", "Engineering": "Engineering", "Support": "Support",
}
ACCOUNTS = {
    "Cash": "Cash", "cash": "Cash", "CASH": "Cash", "Bank": "Cash",
    "Accounts Receivable": "Accounts Receivable", "accounts receivable": "Accounts Receivable", "A/R": "Accounts Receivable",
    "Accounts Payable": "Accounts Payable", "accounts payable": "Accounts Payable", "A/P": "Accounts Payable",
    "Cost of Goods Sold": "Cost of Goods Sold", "COGS": "Cost of Goods Sold",
    "Sales Revenue": "Sales Revenue", "Revenue": "Sales Revenue",
    "Operating Expenses": "Operating Expenses", "Office Supplies": "Operating Expenses", "Utilities Expense": "Operating Expenses", "Rent Expense": "Operating Expenses", "Professional Fees": "Operating Expenses", "Travel & Entertainment": "Operating Expenses",
    "Equipment": "Equipment",
}
# Whole titles that become something else.
TITLES = {"It": "IT", "Hr": "HR", "Ops": "Operations", "Mkt": "Marketing"}


def _folded(name: str) -> str:
    return name.lower().replace("_", " ").replace("-", " ")


def _first(names: list[str], test: Callable[[str], bool]) -> list[str]:
    return next(([n] for n in names if test(n)), [])


def _department(c: Column) -> Column:
    return F.coalesce(strings.looked_up(c, DEPARTMENTS), c)


def _case(c: Column) -> Column:
    return strings.let(strings.titled(strings.stripped(c)), lambda t: F.coalesce(strings.looked_up(t, TITLES), t))


def _account_title(c: Column) -> Column:
    return strings.small_words(strings.titled(strings.stripped(c)))


def _differs(before: Column, after: Column) -> Column:
    return before.isNotNull() & ~before.eqNullSafe(after)


def _was_blank(before: Column, after: Column) -> Column:
    return before.isNull() | (before == "")


@dataclass(frozen=True)
class Rule:
    """``columns`` picks the targets from (names, contract); ``value`` gives the
    new value; ``logged`` says which changes of (old, new) are recorded, which
    need not be all that happen."""

    rule_id: str
    reason: str
    columns: Callable[[list[str], TableContract], list[str]]
    value: Callable[[Column], Column]
    logged: Callable[[Column, Column], Column] = _differs


def _is_string(name: str, contract: TableContract) -> bool:
    spec = contract.get(name)
    return spec is not None and spec.type == STRING


def _only(*wanted: str) -> Callable[[list[str], TableContract], list[str]]:
    return lambda names, _: [n for n in wanted if n in names]


_ACCOUNT = lambda names, _: _first(names, lambda n: _folded(n).replace(" ", "_") in ("account_name", "account"))

#: The rules in their order, which matters: each sees what the ones before left.
#: The sign rule, which moves values between two columns, comes at its place.
RULES: tuple[Rule | str, ...] = (
    Rule("trim_whitespace", "Removed extra whitespace", lambda names, contract: [n for n in names if _is_string(n, contract)], strings.squeezed),
    Rule("case_normalization", "Normalized to title case", _only("Department", "Account Name"), _case),
    Rule("uppercase_codes", "Converted to uppercase", _only("Account Code", "Transaction ID"), lambda c: F.upper(strings.stripped(c))),
    Rule("numeric_cleaning", "Cleaned numeric formatting", lambda names, _: [n for n in names if any(k in _folded(n) for k in ("debit", "credit", "amount"))], amounts.cleaned, _was_blank),
    Rule("date_normalization", "Normalized to ISO date format", lambda names, _: [n for n in names if n.lower() == "date"], lambda c: F.coalesce(dates.iso_date(c), c)),
    Rule("department_mapping", "Mapped department variant to canonical form", lambda names, _: _first(names, lambda n: n.lower() in ("department", "dept")), _department),
    Rule("account_mapping", "Mapped account variant to canonical form", _ACCOUNT, lambda c: F.coalesce(strings.looked_up(c, ACCOUNTS), c)),
    Rule("account_title_case", "Applied title case to account name", _ACCOUNT, lambda c: F.when(c.isin(*ACCOUNTS.values()), c).otherwise(_account_title(c))),
    Rule("transaction_id_format", "Standardized Transaction ID format", _only("Transaction ID"), identifiers.transaction_id),
    "sign_fix",
    Rule("text_cleaning", "Removed special characters", _only("Description", "Created By"), strings.without_symbols),
    Rule("reference_number_format", "Standardized reference number format", lambda names, _: _first(names, lambda n: "reference" in _folded(n)), identifiers.reference_number),
)

SIGN_RULES = (("debit_sign_fix", "Moved negative debit to credit"), ("credit_sign_fix", "Moved negative credit to debit"))


def _change(order: int, column: str, before: Column, after: Column, rule_id: str, reason: str) -> Column:
    return F.struct(F.lit(order).alias("ord"), F.lit(column).alias("column"), before.cast("string").alias("before"), after.cast("string").alias("after"), F.lit(rule_id).alias("rule_id"), F.lit(reason).alias("reason"))


def _none() -> Column:
    return F.array().cast(CHANGE)


class _Fold:
    """The rules as a few projections.  Every new value is a column of its own,
    one step above the value that it is made from, so a step holds the work of
    all columns; the log compares the versions at the end."""

    def __init__(self, names: list[str]):
        self.now = {n: (F.col(f"`{n}`"), 0) for n in names}
        self.steps: list[dict[str, Column]] = []
        self.log: list[Column] = []

    def put(self, step: int, value: Column) -> Column:
        while len(self.steps) < step:
            self.steps.append({})
        name = f"__v{step}_{len(self.steps[step - 1])}"
        self.steps[step - 1][name] = value
        return F.col(name)

    def rule(self, order: int, rule: Rule, columns: list[str], log_all: bool) -> None:
        logged = (lambda a, b: ~a.eqNullSafe(b)) if log_all and rule.rule_id == "numeric_cleaning" else rule.logged
        for k, name in enumerate(columns):
            old, step = self.now[name]
            new = self.put(step + 1, rule.value(old))
            self.now[name] = new, step + 1
            self.log.append(F.when(logged(old, new), F.array(_change(100 * order + k, name, old, new, rule.rule_id, rule.reason))).otherwise(_none()))

    def sign_fix(self, order: int) -> None:
        """A negative debit becomes a credit and overwrites what stood there; else
        a negative credit becomes a debit.  The emptied side is an empty text."""
        names = "Debit Amount", "Credit Amount"
        if not any(n in self.now for n in names):
            return
        (d, c), step = (self.now.get(n, (F.lit(None).cast("string"), 0))[0] for n in names), max(self.now.get(n, (None, 0))[1] for n in names) + 1
        negative = lambda x: F.coalesce(amounts.parsed(x) < 0, F.lit(False))
        minus_d, minus_c = self.put(step, negative(d)), self.put(step, negative(c))
        flip_d, flip_c = (self.put(step, F.regexp_replace(amounts.cleaned(x), "^-", "")) for x in (d, c))
        minus_c = ~minus_d & minus_c
        pair = lambda k, one, other, flip, name, to: F.array(_change(100 * order, name, one, F.lit(""), *SIGN_RULES[k]), _change(100 * order + 1, to, F.coalesce(other, F.lit("")), flip, *SIGN_RULES[k]))
        self.log.append(F.when(minus_d, pair(0, d, c, flip_d, *names)).when(minus_c, pair(1, c, d, flip_c, *names[::-1])).otherwise(_none()))
        for name, value in zip(names, (F.when(minus_d, "").when(minus_c, flip_c).otherwise(d), F.when(minus_d, flip_d).when(minus_c, "").otherwise(c))):
            if name in self.now:
                self.now[name] = self.put(step + 1, value), step + 1


@remembered
def folded(names: tuple[str, ...], contract: TableContract, rules: tuple[Rule | str, ...], log_all_numbers: bool) -> tuple[list[dict[str, Column]], dict[str, Column], Column]:
    """The projections of all rules, the final value of each column, the log."""
    fold = _Fold(list(names))
    for order, rule in enumerate(rules):
        if rule == "sign_fix":
            fold.sign_fix(order)
        elif columns := rule.columns(list(names), contract):
            fold.rule(order, rule, columns, log_all_numbers)
    log = F.concat(*fold.log) if fold.log else _none()
    return fold.steps, {n: c.alias(n) for n, (c, _) in fold.now.items()}, log.alias(CHANGES)


def apply_rules(df: DataFrame, contract: TableContract, rules: tuple[Rule | str, ...] = RULES, log_all_numbers: bool = False) -> DataFrame:
    """``df`` with its values normalised and its changes in ``__changes``.

    A few projections, without shuffle, UDF or second pass.  Two rules work on
    the account column: where the dictionary has the value, only the first counts.
    """
    names = tuple(c for c in df.columns if c not in SYSTEM_COLUMNS and c != CHANGES)
    steps, now, log = folded(names, contract, rules, log_all_numbers)
    columns = [c for c in df.columns if c != CHANGES]
    for step in steps:
        df = df.withColumns(step)
    return df.select(*[now.get(c) if c in now else F.col(f"`{c}`") for c in columns], log)


def change_log(ruled: DataFrame, source: str = "rule") -> DataFrame:
    """One row per recorded change.  The outer form of explode: for the inner one
    the optimizer puts a test of the whole array, written out from the source
    columns, before all the rules."""
    ids = [c for c in SYSTEM_COLUMNS if c in ruled.columns]
    flat = ruled.select(*ids, F.explode_outer(CHANGES).alias("x")).filter("x is not null")
    return flat.select(*ids, "x.ord", "x.column", "x.before", "x.after", "x.rule_id", "x.reason", F.lit(1.0).alias("confidence"), F.lit(source).alias("source"))


def rules_summary(log: DataFrame) -> DataFrame:
    """Changes in all, by rule and by column, in one aggregation."""
    sets = log.groupingSets([["rule_id"], ["column"], []], "rule_id", "column")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    scope = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "rule").otherwise("column")
    return out.select(scope.alias("scope"), F.coalesce("rule_id", "column", F.lit("all")).alias("name"), "n")
