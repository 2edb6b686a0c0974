"""SQL of the error classes and of their injection, for comparison: each class as text over a value and draws, each step as a query over the step before."""

from __future__ import annotations

from collections.abc import Callable

from kinloom.functions import text
from kinloom.functions.draws import uniform_sql
from kinloom.operators import errors

Draw = Callable[[int], str]


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def pick(u: str, values) -> str:
    return f"{_list(values)}[CAST(floor({u} * {len(values)}) + 1 AS INTEGER)]"


def _place(c: str, u: str, first: int = 1, last: int = 0) -> str:
    return f"CAST(floor({u} * greatest(length({c}) - {last + first - 1}, 1)) + {first} AS INTEGER)"


def _put(c: str, at: str, new: str, width: int = 1) -> str:
    return f"(substr({c}, 1, {at} - 1) || {new} || substr({c}, {at} + {width}))"


_KEYS = "CASE upper({ch}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in errors.NEIGHBOURS.items()) + " END"


def _typo(ch: str, kind: str, which: str) -> str:
    keys = _KEYS.format(ch=ch)
    new = f"substr({keys}, CAST(floor({which} * length({keys})) + 1 AS INTEGER), 1)"
    others = f"replace('{errors.ALPHABET}', {ch}, '')"
    other = f"substr({others}, CAST(floor({which} * length({others})) + 1 AS INTEGER), 1)"
    return f"CASE WHEN {kind} < 0.5 THEN coalesce(CASE WHEN {ch} = upper({ch}) THEN {new} ELSE lower({new}) END, {ch}) ELSE {other} END"


def name_typo(c: str, d: Draw) -> str:
    at = _place(c, d(0), 2)
    return f"CASE WHEN length({c}) >= 2 THEN {_put(c, at, _typo(f'substr({c}, {at}, 1)', d(1), d(2)))} ELSE {c} END"


def many_typos(c: str, d: Draw) -> str:
    n = f"greatest(least(CASE WHEN {d(0)} < 0.5 THEN 2 ELSE 3 END, length({c}) - 1), 1)"
    salt = f"CAST(CAST(floor({d(1)} * {1 << 30}) AS BIGINT) AS VARCHAR)"
    order = f"list_sort(list_transform(range(2, length({c}) + 1), lambda i: struct_pack(h := md5({salt} || '|' || CAST(i AS VARCHAR)), i := i)))"
    places = f"list_transform(list_slice({order}, 1, {n}), lambda x: x.i)"
    u = lambda k: f"(CAST('0x' || substr(md5({salt} || '|{k}|' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT)::DOUBLE / {float(1 << 32)!r}::DOUBLE)"
    ch = f"substr({c}, CAST(i AS INTEGER), 1)"
    changed = f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN list_contains({places}, i) THEN {_typo(ch, u(0), u(1))} ELSE {ch} END), '')"
    return f"CASE WHEN length({c}) >= 4 THEN {changed} ELSE {c} END"


def abbreviation(c: str, d: Draw) -> str:
    a, cases = f"upper({c})", []
    for full, short in errors.SHORT.items():
        cases.append((full, f"replace({a}, '{full}', {pick(d(0), short)})"))
        for s in short:
            other = pick(d(0), [x for x in short if x != s])
            cases.append((s, f"replace({a}, '{s}', CASE WHEN {d(1)} < 0.5 THEN '{full}' ELSE {other} END)"))
    return "CASE " + " ".join(f"WHEN contains({a}, '{k}') THEN {new}" for k, new in cases) + f" ELSE {c} END"


def apartment(c: str, d: Draw) -> str:
    a, cases = f"upper({c})", []
    for pattern, formats in ((r"APT\.?\s*(\d+)", ("APARTMENT ", "UNIT ", "#", "NO. ")), (r"APARTMENT\s*(\d+)", ("APT ", "APT. ", "UNIT ", "#", "NO. ")), (r"UNIT\s*(\d+)", ("APT ", "APARTMENT ", "#", "NO. ")), (r"#(\d+)", ("APT ", "UNIT ", "APARTMENT ", "NO. "))):
        cases.append(f"WHEN regexp_matches({a}, '{pattern}') THEN regexp_replace({a}, '{pattern}', {pick(d(0), formats)} || '\\1', 'g')")
    return f"CASE {' '.join(cases)} ELSE {c} END"


def _dashed(d: str, like: str | None = None) -> str:
    dashed = f"concat_ws('-', substr({d}, 1, 3), substr({d}, 4, 2), substr({d}, 6, 4))"
    return f"CASE WHEN contains({like}, '-') THEN {dashed} ELSE {d} END" if like else dashed


_digits = lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"


def ssn_swap(c: str, d: Draw) -> str:
    s = _digits(c)
    at = _place(s, d(0), 1, 1)
    return f"CASE WHEN length({s}) = 9 THEN {_dashed(_put(s, at, f'substr({s}, {at} + 1, 1) || substr({s}, {at}, 1)', 2), c)} ELSE {c} END"


def ssn_digit(c: str, d: Draw) -> str:
    s = _digits(c)
    at = _place(s, d(0))
    new = f"CAST((CAST(substr({s}, {at}, 1) AS INTEGER) + 1 + CAST(floor({d(1)} * 9) AS INTEGER)) % 10 AS VARCHAR)"
    return f"CASE WHEN length({s}) = 9 THEN {_dashed(_put(s, at, new), c)} ELSE {c} END"


def ssn_format(c: str, d: Draw) -> str:
    s = _digits(c)
    return f"CASE WHEN length({s}) <> 9 THEN {c} WHEN contains({c}, '-') THEN {s} ELSE {_dashed(s)} END"


def date_off(c: str, d: Draw) -> str:
    return f"strftime(CAST(try_strptime({c}, '%Y-%m-%d') AS DATE) + CAST({pick(d(0), [1, -1, 30, -30, 365, -365])} AS INTEGER), '%Y-%m-%d')"


def date_swap(c: str, d: Draw) -> str:
    y, m, day = f"substr({c}, 1, 4)", f"substr({c}, 6, 2)", f"substr({c}, 9, 2)"
    year = f"(substr({c}, 1, 2) || substr({c}, 4, 1) || substr({c}, 3, 1))"
    other = f"concat_ws('-', {year}, {m}, {day})"
    return f"CASE WHEN {day} <= '12' AND {day} <> {m} THEN concat_ws('-', {y}, {day}, {m}) WHEN {year} >= '1900' AND {year} <= '2025' AND try_strptime({other}, '%Y-%m-%d') IS NOT NULL THEN {other} ELSE {c} END"


def document_digit(c: str, d: Draw) -> str:
    at = _place(c, d(0))
    ch = f"substr({c}, {at}, 1)"
    digit = f"CAST((try_cast({ch} AS INTEGER) + 1 + CAST(floor({d(1)} * 9) AS INTEGER)) % 10 AS VARCHAR)"
    letter = f"chr(CAST(65 + (ascii(upper({ch})) - 65 + 1 + CAST(floor({d(1)} * 25) AS INTEGER)) % 26 AS INTEGER))"
    new = f"CASE WHEN regexp_matches({ch}, '[0-9]') THEN {digit} WHEN regexp_matches({ch}, '[A-Za-z]') THEN {letter} ELSE {ch} END"
    return f"CASE WHEN length({c}) < 1 THEN {c} ELSE {_put(c, at, new)} END"


def _title(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def capitals(c: str, d: Draw) -> str:
    mixed = f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN upper(substr({c}, CAST(i AS INTEGER), 1)) ELSE lower(substr({c}, CAST(i AS INTEGER), 1)) END), '')"
    return f"CASE WHEN {d(0)} < 0.25 THEN upper({c}) WHEN {d(0)} < 0.5 THEN lower({c}) WHEN {d(0)} < 0.75 THEN {_title(c)} ELSE {mixed} END"


def outer_space(c: str, d: Draw) -> str:
    pad = pick(d(0), [" ", "  ", "   "])
    return f"CASE WHEN {d(1)} < {1 / 3!r}::DOUBLE THEN {pad} || {c} WHEN {d(1)} < {2 / 3!r}::DOUBLE THEN {c} || {pad} ELSE {pad} || {c} || {pad} END"


CLASSES: dict[str, Callable[[str, Draw], str]] = {
    "nickname_substitution": lambda c, d: "CASE trim(regexp_replace(upper(trim({c})), '[0-9]+', '', 'g')) ".format(c=c) + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.NICKNAME.items()) + f" ELSE {c} END",
    "name_typo": name_typo,
    "maiden_name_usage": lambda c, d: f"coalesce(CASE WHEN trim(MAIDEN) <> '' THEN MAIDEN END, {c})",
    "multi_character_typo": many_typos,
    "address_abbreviation": abbreviation,
    "apartment_format_variation": apartment,
    "full_address_change": lambda c, d: f"concat_ws(' ', CAST(1 + CAST(floor({d(0)} * 9998) AS BIGINT) AS VARCHAR), {pick(d(1), errors.STREETS)}, {pick(d(2), errors.KINDS)})",
    "date_off_by_one": date_off,
    "date_digit_transposition": date_swap,
    "ssn_transposition": ssn_swap,
    "ssn_digit_error": ssn_digit,
    "ssn_format_variation": ssn_format,
    "capitalization_error": capitals,
    "extra_whitespace": lambda c, d: f"regexp_replace(trim({c}), '\\s+', {pick(d(0), ['  ', '   ', '    '])}, 'g')",
    "leading_trailing_whitespace": outer_space,
    "special_character_variation": lambda c, d: f"CASE WHEN {d(0)} < 0.5 THEN {c} || '.' ELSE regexp_replace({c}, '[.''-]', '', 'g') END",
    "missing_field_value": lambda c, d: "CAST(NULL AS VARCHAR)",
    "drivers_license_error": document_digit,
    "passport_error": document_digit,
    "missing_whitespace": lambda c, d: f"regexp_replace({c}, '\\s+', '', 'g')",
}


def injected(source: str, columns: list[str], seed: int = 42, least: int = 1, most: int = 3, several: float = 0.7) -> str:
    """CTEs up to ``injected``: source (Id, facility_id and columns) with all steps of errors.inject at a rate of 1, and error_log, a list of (step, field, error_type, original, errored)."""
    u = lambda step, k: uniform_sql(seed, "Id", "facility_id", f"'{step}'", f"'{k}'")
    n = f"CASE WHEN {u(-1, 1)} < {several}::DOUBLE THEN {least} + CAST(floor({u(-1, 2)} * {most - least + 1}) AS INTEGER) ELSE 1 END"
    options = errors._options(columns, errors.WEIGHTS, errors.REGISTRY)
    fields = list(dict.fromkeys(o[4] for o in options))
    draws = 1 + max(3, 2)
    ctes = [f"v0 AS MATERIALIZED (SELECT *, {n} AS n_errors, CAST([] AS STRUCT(step INTEGER, field VARCHAR, error_type VARCHAR, original VARCHAR, errored VARCHAR)[]) AS error_log FROM {source})"]
    for step in range(most):
        drawn = ", ".join(f"{u(step, k)} AS d{k}" for k in range(draws))
        ctes.append(f"u{step} AS MATERIALIZED (SELECT *, {drawn} FROM v{step})")
        at = f"CASE WHEN n_errors > {step} THEN d0 * {options[-1][1]!r}::DOUBLE END"
        which = "CASE " + " ".join(f"WHEN x >= {o[0]!r}::DOUBLE AND x < {o[1]!r}::DOUBLE THEN {i}" for i, o in enumerate(options)) + " END"
        ctes.append(f"w{step} AS MATERIALIZED (SELECT *, {which} AS which FROM (SELECT *, {at} AS x FROM u{step}))")
        d = lambda k: f"d{k + 1}"
        new = "CASE which " + " ".join(f"WHEN {i} THEN CASE WHEN {f} IS NULL OR trim({f}) = '' THEN {f} ELSE {CLASSES[name](f, d)} END" for i, (_, _, name, _, f) in enumerate(options)) + " END"
        old = "CASE which " + " ".join(f"WHEN {i} THEN {o[4]}" for i, o in enumerate(options)) + " END"
        ctes.append(f"n{step} AS MATERIALIZED (SELECT *, {old} AS old_value, {new} AS new_value FROM w{step})")
        label = lambda k: f"{_list([o[k] for o in options])}[which + 1]"
        entry = f"struct_pack(step := {step}, field := {label(4)}, error_type := {label(2)}, original := old_value, errored := new_value)"
        values = [f"CASE WHEN which IN ({', '.join(str(i) for i, o in enumerate(options) if o[4] == f)}) THEN new_value ELSE {f} END AS {f}" if f in fields else f for f in columns]
        ctes.append(f"v{step + 1} AS MATERIALIZED (SELECT Id, facility_id, {', '.join(values)}, n_errors, CASE WHEN which IS NOT NULL AND old_value IS DISTINCT FROM new_value THEN list_append(error_log, {entry}) ELSE error_log END AS error_log FROM n{step})")
    return ", ".join(ctes) + f", injected AS (SELECT * EXCLUDE (n_errors) FROM v{most})"
