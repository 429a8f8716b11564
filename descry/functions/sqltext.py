"""SQL fragments for expressions that are generated once per column of a wide table.

A generated SELECT reaches the JVM in one call, whereas a Column tree of the same size takes one call per node.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import types as T

from descry.functions import predicates as P

INFINITY = "double('Infinity')"


def quoted(text: str | None) -> str:
    """A string literal."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def named(column: str) -> str:
    """A column reference."""
    return "`" + column.replace("`", "``") + "`"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{key}', {value}" for key, value in fields.items()) + ")"


def missing(column: str, dtype: T.DataType) -> str:
    value = named(column)
    return f"({value} IS NULL OR isnan({value}))" if P.is_floating(dtype) else f"({value} IS NULL)"


def number(column: str) -> str:
    """DOUBLE with NaN as NULL."""
    return f"nanvl(CAST({named(column)} AS DOUBLE), NULL)"


def finite(column: str) -> str:
    """DOUBLE where finite, else NULL."""
    value = f"CAST({named(column)} AS DOUBLE)"
    return f"IF(abs({value}) < {INFINITY}, {value}, CAST(NULL AS DOUBLE))"


def infinite(column: str) -> str:
    return f"(abs(CAST({named(column)} AS DOUBLE)) = {INFINITY})"


def label(column: str, dtype: T.DataType) -> str:
    """The text of a category; booleans print capitalised, missing ones are NULL."""
    text = f"CAST({named(column)} AS STRING)"
    text = f"initcap({text})" if isinstance(dtype, T.BooleanType) else text
    return f"IF({missing(column, dtype)}, NULL, {text})"


def percent(part: str, whole: str) -> str:
    return f"(try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE)) * 100D)"


def statistic_text(value: str) -> str:
    """A DOUBLE statistic: dash if NULL, scientific below 0.01, else two decimals.

    ``format_number`` with a pattern rounds the exact binary value half-even; ``format_string`` would round the
    shortest decimal half-up.
    """
    return (
        f"CASE WHEN {value} IS NULL THEN '—' WHEN {value} <> 0 AND abs({value}) < 0.01D "
        f"THEN replace(format_number({value}, '0.000E00'), 'E', 'e') ELSE format_number({value}, '0.00') END"
    )


def count_text(value: str) -> str:
    return f"coalesce(CAST({value} AS STRING), '—')"


def percent_text(value: str) -> str:
    return f"format_number({value}, '0.0')"


def display_label(label_column: str, units: Mapping[str, str] | None = None) -> str:
    """The label, followed by its unit in parentheses where one was given."""
    shown = {name: unit.strip() for name, unit in (units or {}).items() if unit.strip()}
    if not shown:
        return label_column
    cases = " ".join(f"WHEN {quoted(name)} THEN {quoted(f'{name} ({unit})')}" for name, unit in shown.items())
    return f"CASE {label_column} {cases} ELSE {label_column} END"


def choice(column: str, entries: Mapping[str, str]) -> str:
    """The entry of a small fixed table."""
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in entries.items()) + " END"


def filled(template: str, texts: Mapping[str, str]) -> str:
    """A template with its ``{name}`` parts replaced, as a concatenation; ``template`` is fixed wording."""
    pieces: list[str] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [quoted(before), f"coalesce({texts[name]}, '')"]
    return "concat(" + ", ".join([*pieces, quoted(rest)]) + ")"
