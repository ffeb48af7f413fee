"""Formulas in a form that does not depend on where they stand.

A formula is cut into tokens: texts in quotes, quoted sheet names, bracketed parts, cell references,
whole columns and rows, names (with the ``!`` of a sheet or the bracket of a function), numbers, single signs. :func:`relative` rewrites every cell
reference as its distance from the formula's own cell (``R[-1]C[0]``; parts fixed by ``$`` keep their number), so
a formula that was filled down, moved or stored as shared equals its written-out form.
:func:`shift` moves the relative references of a formula, which is how a shared formula is written out.

Quoted texts and sheet names are never taken for references, nor are names such as ``LOG10`` or
``AB1_x``, nor columns beyond XFD. Null formulas stay null; formulas of a cell without row or column stay as they
are. Letters of references count as upper case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ROWS, MOST_COLUMNS = 1 << 20, 1 << 14  # fixed values of the file format

_END = r"(?![A-Za-z0-9_.(!])"
CELL = r"\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6}"
COLUMNS = r"\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}"
ROWS = r"\$?[0-9]+:\$?[0-9]+"
#: The same pattern serves Java's engine and Python's.
TOKENS = "|".join((r'"(?:[^"]|"")*"', r"'(?:[^']|'')*'!?", r"\[[^\]]*\]", CELL + _END, COLUMNS + _END, ROWS, r"[A-Za-z_\\À-ÿ][A-Za-z0-9_.À-ÿ]*[(!]?", r"[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?", r"[\s\S]"))
_PARTS = r"^(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)$"
TOKEN, _CELL = re.compile(TOKENS), re.compile(_PARTS)


def _number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def shift(formula: str, rows: int, columns: int) -> str:
    """``formula`` as it reads when it is filled ``rows`` down and ``columns`` to the right."""

    def moved(token: str) -> str:
        m = _CELL.match(token)
        if m and _number(m[2]) <= MOST_COLUMNS and int(m[4]) <= MOST_ROWS:
            row, column = int(m[4]) + (0 if m[3] else rows), _number(m[2]) + (0 if m[1] else columns)
            return f"{m[1]}{_letters(column)}{m[3]}{row}" if 0 < row <= MOST_ROWS and 0 < column <= MOST_COLUMNS else "#REF!"
        if ":" in token and token[0] not in "\"'[":
            ends = [re.fullmatch(r"(\$?)(\w+)", end) for end in token.split(":")]
            if all(ends) and all(e[2].isdigit() for e in ends):
                return ":".join(f"{e[1]}{int(e[2]) + (0 if e[1] else rows)}" for e in ends)
            if all(ends):
                return ":".join(f"{e[1]}{_letters(_number(e[2]) + (0 if e[1] else columns))}" for e in ends)
        return token

    return "".join(moved(t) for t in TOKEN.findall(formula))


# ---------------------------------------------------------------- the same as column expressions


# SQL text, which the JVM parses at once: built operator by operator these take longer than small queries.


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with(value: str, name: str, made: str) -> str:
    """``made`` of a value that is worked out once under ``name``, however often it is used there."""
    return f"get(transform(array({value}), {name} -> {made}), 0)"


def _column_sql(letters: str) -> str:
    at = lambda i: f"(ascii(substring(up_, {i}, 1)) - 64)"
    return _with(f"upper({letters})", "up_", f"CASE length(up_) WHEN 1 THEN {at(1)} WHEN 2 THEN {at(1)} * 26 + {at(2)} ELSE ({at(1)} * 26 + {at(2)}) * 26 + {at(3)} END")


def _reference_sql(token: str) -> str:
    part = lambda i: f"regexp_extract({token}, {_quoted(_PARTS)}, {i})"
    made = f"struct({part(1)} <> '' AS fixed_column, {_column_sql(part(2))} AS column, {part(3)} <> '' AS fixed_row, try_cast({part(4)} AS INT) AS row)"
    inside = f"IF(ref_.column <= {MOST_COLUMNS} AND ref_.row <= {MOST_ROWS}, ref_, NULL)"
    return f"CASE WHEN length({token}) > 1 AND {token} RLIKE {_quoted(_PARTS)} THEN {_with(made, 'ref_', inside)} END"


def tokens(formula: str) -> Column:
    """The tokens of the column named ``formula``."""
    return F.expr(f"regexp_extract_all({formula}, {_quoted(TOKENS)}, 0)")


def column_number(letters: str) -> Column:
    """The number of a column by an SQL text for its letters, up to three of them."""
    return F.expr(_column_sql(letters))


def reference(token: str) -> Column:
    """``fixed_column, column, fixed_row, row`` of the cell reference in the column named ``token``; null for any other token."""
    return F.expr(_reference_sql(token))


def relative(formula: str = "formula", row: str = "row", column: str = "col") -> Column:
    """The formula of that column with every cell reference relative to the cell at ``row`` and ``column``."""
    apart = lambda fixed, place, own: f"if({fixed}, string({place}), concat('[', {place} - {own}, ']'))"
    cell = f"get(transform(array({_reference_sql('tok_')}), ref_ -> concat('R', {apart('ref_.fixed_row', 'ref_.row', row)}, 'C', {apart('ref_.fixed_column', 'ref_.column', column)})), 0)"
    ends = lambda number, own: f"array_join(transform(split(tok_, ':'), end_ -> CASE WHEN end_ LIKE '$%' THEN upper(end_) ELSE concat('[', {number} - {own}, ']') END), ':')"
    whole = f"CASE WHEN NOT contains(tok_, ':') THEN NULL WHEN tok_ RLIKE {_quoted(f'^{COLUMNS}$')} THEN concat('C', {ends(_column_sql('end_'), column)}) WHEN tok_ RLIKE {_quoted(f'^{ROWS}$')} THEN concat('R', {ends('try_cast(end_ AS INT)', row)}) END"
    each = f"transform(regexp_extract_all({formula}, {_quoted(TOKENS)}, 0), tok_ -> IF(length(tok_) < 2, tok_, coalesce({cell}, {whole}, tok_)))"
    return F.expr(f"CASE WHEN {formula} IS NOT NULL AND {row} IS NOT NULL AND {column} IS NOT NULL THEN array_join({each}, '') ELSE {formula} END")
