"""The same queries as DuckDB SQL, written apart from the Spark code."""

from __future__ import annotations

from sparkwright.operators.residual import ACCOUNT_TESTS, DEPARTMENT_TESTS
from sparkwright.operators.rules import ACCOUNTS, DEPARTMENTS, TITLES
from sparkwright.plans.fixture import CODES, COLUMNS, SQL

_ALL = tuple(COLUMNS)


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _title(c: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all(lower(trim({c})), '(\p{{L}}+|[^\p{{L}}]+)'), lambda x: upper(x[1]) || x[2:]), '')"


def _dictionary(c: str, table: dict[str, str]) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in table.items()) + " END"


def _bare(c: str) -> str:
    s = f"translate(trim({c}), '\"''$£€,', '')"
    return rf"CASE WHEN {s} LIKE '(%)' THEN '-' || substr({s}, 2, length({s}) - 2) ELSE {s} END"


def _money(c: str) -> str:
    b = _bare(c)
    return rf"coalesce(CASE WHEN regexp_full_match({b}, '[+-]?(\d+(\.\d*)?|\.\d+)') THEN cast(cast(round_even(cast({b} AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS VARCHAR) END, '0.00')"


def _iso(c: str) -> str:
    mon = "'(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    pairs = (
        (r"'\d{4}-\d{1,2}-\d{1,2}'", "%Y-%m-%d"), (r"'\d{1,2}/\d{1,2}/\d{4}'", "%m/%d/%Y"), (r"'\d{4}/\d{1,2}/\d{1,2}'", "%Y/%m/%d"), (r"'\d{4}\.\d{1,2}\.\d{1,2}'", "%Y.%m.%d"),
        (mon + r" \d{1,2} \d{4}'", "%b %d %Y"), (r"'\d{1,2}-" + mon[1:] + r"-\d{4}'", "%d-%b-%Y"),
    )
    return "CASE " + " ".join(f"WHEN regexp_full_match({c}, {rx}) THEN strftime(strptime({c}, '{f}'), '%Y-%m-%d')" for rx, f in pairs) + " END"


def _small(c: str) -> str:
    for w in ("Of", "And", "The", "A", "An"):
        c = f"replace({c}, ' {w} ', ' {w.lower()} ')"
    return c


def _txn(c: str) -> str:
    s = f"replace(upper(trim({c})), ' ', '')"
    number = rf"CASE WHEN regexp_matches({s}, '^TXN[-_]') THEN substr({s}, 5) WHEN {s} LIKE 'TXN%' THEN substr({s}, 4) WHEN regexp_matches({s}, '^\d') THEN {s} END"
    digits = rf"regexp_extract({number}, '(\d+)', 1)"
    return f"CASE WHEN {s} IN ('DUPLICATE', 'INVALID', 'N/A', 'NULL', 'NA') OR coalesce({digits}, '') = '' THEN {c} ELSE 'TXN-' || lpad({digits}, greatest(3, length({digits}))::INT, '0') END"


def _reference(c: str) -> str:
    s = f"regexp_replace(translate(upper(trim({c})), '_ ', '--'), '-+', '-', 'g')"
    return rf"CASE WHEN lower({c}) LIKE '%ref%' OR regexp_full_match(upper({c}), '[A-Z0-9]+[-_]?\d+') THEN CASE WHEN regexp_matches({s}, '^REF[^-]') THEN 'REF-' || substr({s}, 4) ELSE {s} END ELSE {c} END"


def _clean_text(c: str) -> str:
    return _squeeze(f"regexp_replace({c}, '[μ∞Ø!]+', '', 'g')")


def _stage(n: int, new: dict[str, str]) -> str:
    return f"s{n} AS MATERIALIZED (SELECT row_number, " + ", ".join(f"{new[c]} AS {c}" if c in new else c for c in _ALL) + f" FROM s{n - 1})"


_CASED = {c: f"coalesce({_dictionary(_title(c), TITLES)}, {_title(c)})" for c in ("acct", "dept")}
_STEPS = (
    ("trim_whitespace", {c: _squeeze(c) for c in ("txn", "code", "acct", "descr", "dept", "ref", "creator")}),
    ("case_normalization", _CASED),
    ("uppercase_codes", {c: f"upper(trim({c}))" for c in ("txn", "code")}),
    ("numeric_cleaning", {c: _money(c) for c in ("debit", "credit")}),
    ("date_normalization", {"date": f"coalesce({_iso('date')}, date)"}),
    ("department_mapping", {"dept": f"coalesce({_dictionary('dept', DEPARTMENTS)}, dept)"}),
    ("account_mapping", {"acct": f"coalesce({_dictionary('acct', ACCOUNTS)}, acct)"}),
    ("account_title_case", {"acct": f"CASE WHEN acct IN ({', '.join(sorted(map(_text, set(ACCOUNTS.values()))))}) THEN acct ELSE {_small(_title('acct'))} END"}),
    ("transaction_id_format", {"txn": _txn("txn")}),
    ("sign_fix", {"debit": "CASE WHEN debit LIKE '-%' THEN '' WHEN credit LIKE '-%' THEN substr(credit, 2) ELSE debit END", "credit": "CASE WHEN debit LIKE '-%' THEN substr(debit, 2) WHEN credit LIKE '-%' THEN '' ELSE credit END"}),
    ("text_cleaning", {c: _clean_text(c) for c in ("descr", "creator")}),
    ("reference_number_format", {"ref": _reference("ref")}),
)
N = len(_STEPS)
STAGES = "f AS MATERIALIZED (" + SQL.format(orders="orders") + "), s0 AS MATERIALIZED (SELECT * FROM f), " + ", ".join(_stage(k + 1, new) for k, (_, new) in enumerate(_STEPS))


def _log() -> str:
    parts = []
    for k, (rule, new) in enumerate(_STEPS):
        for c in new:
            name = _text(COLUMNS[c])
            if rule == "sign_fix":
                continue
            test = f"a.{c} IS NULL OR a.{c} = ''" if rule == "numeric_cleaning" else f"a.{c} IS NOT NULL AND a.{c} IS DISTINCT FROM b.{c}"
            parts.append(f"SELECT a.row_number, {name} AS \"column\", a.{c} AS before, b.{c} AS after, '{rule}' AS rule_id FROM s{k} a JOIN s{k + 1} b USING (row_number) WHERE {test}")
        if rule == "sign_fix":
            for side, other, rid in (("debit", "credit", "debit_sign_fix"), ("credit", "debit", "credit_sign_fix")):
                test = f"a.{side} LIKE '-%'" + (" AND a.debit NOT LIKE '-%'" if side == "credit" else "")
                parts.append(f"SELECT a.row_number, {_text(COLUMNS[side])}, a.{side}, '', '{rid}' FROM s{k} a WHERE {test}")
                parts.append(f"SELECT a.row_number, {_text(COLUMNS[other])}, coalesce(a.{other}, ''), substr(a.{side}, 2), '{rid}' FROM s{k} a WHERE {test}")
    return " UNION ALL ".join(parts)


LOG = f"log AS MATERIALIZED ({_log()})"

_POSITIVE = "coalesce(try_cast(nullif({0}, '') AS DECIMAL(38,2)) > 0, false)"
_DECIMAL = r"regexp_full_match({0}, '[+-]?(\d+(\.\d*)?|\.\d+)')"
_VALID_TXN = r"coalesce(regexp_full_match(upper(trim(txn)), 'TXN-\d+'), false)"


def _errors(source: str, strict: bool) -> str:
    out = []

    def add(order: int, column: str, value: str, kind: str, message: str, test: str) -> None:
        out.append(f"SELECT row_number, {order} AS ord, {_text(column)} AS \"column\", {value} AS value, '{kind}' AS error_type, {message} AS message FROM {source} WHERE {test}")

    at = {c: 1000 + 10 * k for k, c in enumerate(_ALL)}
    required = ("date", "acct", "dept", "creator") if strict else ()
    for c in required:
        add(at[c], COLUMNS[c], c, "required_field", _text(f"Required field '{COLUMNS[c]}' is empty"), f"{c} IS NULL OR {c} = ''")
    there = lambda c: f"{c} IS NOT NULL" + (f" AND {c} <> ''" if c in required else "")
    for c, kind, valid in (("date", "date", f"{_iso('date')} IS NOT NULL"), ("debit", "decimal", _DECIMAL.format("debit")), ("credit", "decimal", _DECIMAL.format("credit"))):
        add(at[c] + 1, COLUMNS[c], c, "type_mismatch", f"'Value ''' || {c} || ''' is not a valid {kind}'", f"{there(c)} AND NOT ({valid})")
    if strict:
        add(at["code"] + 2, COLUMNS["code"], "code", "enum_violation", "'Value ''' || code || ''' not in allowed values'", f"{there('code')} AND code NOT IN ({', '.join(map(_text, CODES))})")
        add(at["ref"] + 3, COLUMNS["ref"], "ref", "pattern_violation", r"'Value ''' || ref || ''' doesn''t match pattern REF-\d+$'", rf"{there('ref')} AND NOT regexp_matches(ref, '^(?:REF-\d+$)')")
        add(at["descr"] + 4, COLUMNS["descr"], "descr", "length_violation", "'Value too short (min: 8)'", f"{there('descr')} AND length(descr) < 8")
        add(at["descr"] + 5, COLUMNS["descr"], "descr", "length_violation", "'Value too long (max: 11)'", f"{there('descr')} AND length(descr) > 11")
        add(100_000, "Debit Amount/Credit Amount", "'Debit=' || coalesce(debit, 'nan') || ', Credit=' || coalesce(credit, 'nan')", "debit_xor_credit", "'Exactly one of Debit or Credit must be positive'", f"{_POSITIVE.format('debit')} = {_POSITIVE.format('credit')}")
    add(100_001, COLUMNS["txn"], "txn", "transaction_id_format", "'Invalid Transaction ID format: ''' || txn || '''. Must be TXN-<digits>'", f"txn IS NOT NULL AND NOT {_VALID_TXN}")
    majority = f"(SELECT count_if({_VALID_TXN}) * 2 > count(*) FROM {source})"
    add(100_002, COLUMNS["txn"], "NULL", "missing_primary_key", "'Transaction ID is missing (required when majority have it)'", f"NOT {_VALID_TXN} AND {majority}")
    add(100_003, COLUMNS["txn"], "txn", "duplicate_primary_key", "'Duplicate Transaction ID: ' || txn", f"{_VALID_TXN} AND {majority} AND txn IN (SELECT txn FROM {source} WHERE {_VALID_TXN} GROUP BY txn HAVING count(*) > 1)")
    return " UNION ALL ".join(out)


ERRORS = f"e AS MATERIALIZED ({_errors(f's{N}', True)})"
LOOSE = f"e AS MATERIALIZED ({_errors(f's{N}', False)})"
CATEGORY = """
    first_kind AS (SELECT row_number, arg_min(error_type, ord) FILTER (WHERE error_type IN ('debit_xor_credit', 'missing_column', 'required_field', 'type_mismatch', 'missing_primary_key', 'duplicate_primary_key')) AS k,
        bool_or(error_type IN ('debit_xor_credit', 'missing_column', 'required_field')) AS hard, bool_or(error_type = 'type_mismatch') AS typed, count(*)::BIGINT AS n FROM e GROUP BY row_number),
    q AS (SELECT row_number, n, CASE WHEN k = 'type_mismatch' THEN 'parse_error' ELSE 'validation_failure' END AS error_category,
        CASE WHEN hard THEN 'validation_failure' WHEN typed THEN 'parse_error' ELSE 'validation_failure' END AS validator_category FROM first_kind)"""


def rules_mapper(value: str, tests: tuple) -> str:
    arms = []
    for names, never, target in tests:
        hit = " OR ".join(f"contains(lower({value}), {_text(n)})" for n in names)
        miss = "".join(f" AND NOT contains(lower({value}), {_text(n)})" for n in never)
        arms.append(f"WHEN ({hit}){miss} THEN {_text(target)}")
    return "CASE " + " ".join(arms) + " END"


_CANON = {"Department": "('Sales','Operations','Admin','IT','Finance','Marketing','HR','Legal','Engineering','Support')", "Account Name": "('Cash','Accounts Receivable','Accounts Payable','Sales Revenue','Cost of Goods Sold','Operating Expenses','Equipment','Inventory','Retained Earnings')"}
RESIDUAL = "cells AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT row_number, {_text(COLUMNS[c])} AS \"column\", {c} AS value FROM s{N} WHERE {c} IS NOT NULL AND {c} NOT IN {_CANON[COLUMNS[c]]}" for c in ("dept", "acct")) + "), r AS MATERIALIZED (SELECT \"column\", value, count(*)::BIGINT AS n_rows, min(row_number) AS first_row FROM cells GROUP BY ALL)"
MAPPED = f"m AS MATERIALIZED (SELECT \"column\", value, n_rows, first_row, CASE \"column\" WHEN 'Department' THEN {rules_mapper('value', DEPARTMENT_TESTS)} ELSE {rules_mapper('value', ACCOUNT_TESTS)} END AS mapped, 0.9 AS confidence FROM r)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
