"""Table profile: missing / distinct / non-finite counts, roles, duplicates, constants, ranges, fingerprint.

The profile is one scan and one shuffle whatever the number of columns: every row is turned into one
(column, value) entry per column, entries are counted with map-side combining on (column, value), and the
distinct entries are counted per column. A value shared by a third of the table collapses before the shuffle,
and no column is ever held by one task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry import wording
from descry.errors import AnalysisError
from descry.functions import predicates as P
from descry.functions import sqltext as Q
from descry.functions import text
from descry.functions.wide import aggregate_rows, entries, literal_table


def column_id(position: int) -> str:
    """Stable column id by 1-based position."""
    return f"c{position:03d}"


def column_ids(df: DataFrame) -> dict[str, str]:
    return {name: column_id(i) for i, name in enumerate(df.columns, 1)}


def validate_table(df: DataFrame, *, check_rows: bool = True) -> DataFrame:
    """Reject tables without columns, with blank names, or (one cheap job) without rows."""
    if not df.columns:
        raise AnalysisError("The table must contain at least one column.")
    if any(not name.strip() for name in df.columns):
        raise AnalysisError("Every column must have a non-blank name.")
    if check_rows and df.isEmpty():
        raise AnalysisError("The table must contain at least one data row.")
    return df


# --- one pass over (column, value) ----------------------------------------------------------------------------


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "flag"
    if P.is_temporal(dtype):
        return "instant"
    if isinstance(dtype, T.IntegralType):
        return "whole"
    if P.is_floating(dtype):
        return "real"
    if isinstance(dtype, T.DecimalType):
        return "real" if dtype.precision <= 15 else "decimal"
    if P.is_nested(dtype):
        return "nested"
    return "text"


_SLOTS = {"whole": "BIGINT", "real": "DOUBLE", "instant": "TIMESTAMP_NTZ", "words": "STRING"}


def _is_iso_date(value: str) -> str:
    return f"{value} RLIKE {Q.quoted(text.PADDED_ISO_DATE)}"


def _entry(name: str, dtype: T.DataType, position: int) -> str:
    """One (position, whole, real, instant, words) entry; one of the four slots holds the value, none if missing."""
    kind, column = _kind(dtype), Q.named(name)
    slots = {slot: f"CAST(NULL AS {type_})" for slot, type_ in _SLOTS.items()}
    if kind == "whole":
        slots["whole"] = f"CAST({column} AS BIGINT)"
    elif kind == "flag":
        slots["whole"] = f"CAST(CAST({column} AS INT) AS BIGINT)"
    elif isinstance(dtype, T.TimestampType):
        slots["whole"] = f"unix_micros({column})"
    elif kind == "instant":
        slots["instant"] = f"CAST({column} AS TIMESTAMP_NTZ)"
    elif kind == "real":
        slots["real"] = Q.number(name)
    elif kind == "nested":
        slots["whole"] = f"IF({column} IS NULL, NULL, 0L)"
    elif kind == "decimal":
        slots["words"] = f"CAST({column} AS STRING)"
    else:
        # Long texts travel as the SHA-256 of the whole text; the leading letter keeps whether it is a date.
        plain = f"hex({column})" if isinstance(dtype, T.BinaryType) else f"CAST({column} AS STRING)"
        digest = f"concat(IF({_is_iso_date(plain)}, 'D', '#'), sha2({plain}, 256))"
        slots["words"] = f"IF(octet_length({plain}) > {P.VERBATIM_BYTES}, {digest}, {plain})"
    return Q.struct(position=str(position), **slots)


def value_counts(df: DataFrame) -> DataFrame:
    """Count of every distinct value of every column: position, one value slot filled, n (missing: no slot filled)."""
    long = entries(df, [_entry(f.name, f.dataType, i) for i, f in enumerate(df.schema.fields, 1)])
    return long.groupBy("position", *_SLOTS).agg(F.count(F.lit(1)).alias("n"))


def _column_facts(df: DataFrame, overrides: Mapping[str, str]) -> DataFrame:
    """What the schema alone says about each column."""
    rows = [
        {
            "position": i, "column_id": column_id(i), "label": f.name, "dtype": f.dataType.simpleString(),
            "kind": _kind(f.dataType), "override": overrides.get(f.name),
        }
        for i, f in enumerate(df.schema.fields, 1)
    ]
    schema = "position int, column_id string, label string, dtype string, kind string, override string"
    return literal_table(df.sparkSession, rows, schema)


def _exact_counts(df: DataFrame) -> DataFrame:
    """Counts per column from the distinct (column, value) entries."""
    has_value = f"({' OR '.join(f'{slot} IS NOT NULL' for slot in _SLOTS)})"
    is_date = f"IF(length(words) > {P.VERBATIM_BYTES}, startswith(words, 'D'), {_is_iso_date('words')})"
    # Wide decimals travel as text, so their wholeness is read from the text.
    wide = any(_kind(f.dataType) == "decimal" for f in df.schema.fields)
    text_is_whole = "words RLIKE '^-?[0-9]+([.]0*)?$'" if wide else "true"
    whole = f"CASE WHEN real IS NOT NULL THEN pmod(real, 1D) <= 1e-8D WHEN words IS NOT NULL THEN {text_is_whole} ELSE true END"
    aggregates = [
        f"sum(IF({has_value}, n, 0L)) AS nonmissing",
        f"sum(IF({has_value}, 0L, n)) AS missing",
        f"count_if({has_value}) AS unique_nonmissing",
        f"sum(IF(abs(real) = {Q.INFINITY}, n, 0L)) AS nonfinite",
        f"coalesce(bool_and({whole}), true) AS whole_numbers",
        f"sum(IF({is_date}, n, 0L)) AS iso_dates",
    ]
    return value_counts(df).groupBy("position").agg(*[F.expr(aggregate) for aggregate in aggregates])


def _estimated_counts(df: DataFrame) -> DataFrame:
    """The same counts in one wide aggregate, with HyperLogLog instead of exact distinct counts."""
    rows = []
    for i, field in enumerate(df.schema.fields, 1):
        column, kind, dtype = Q.named(field.name), _kind(field.dataType), field.dataType
        numeric = P.is_numeric(dtype)
        value = Q.number(field.name) if kind == "real" else column
        whole = f"coalesce(bool_and(IF({Q.number(field.name)} IS NULL, NULL, pmod({Q.number(field.name)}, 1D) <= 1e-8D)), true)"
        rows.append(
            Q.struct(
                position=str(i),
                nonmissing=f"count_if(NOT {Q.missing(field.name, dtype)})",
                missing=f"count_if({Q.missing(field.name, dtype)})",
                unique_nonmissing="0L" if kind == "nested" else f"approx_count_distinct({value})",
                nonfinite=f"count_if({Q.infinite(field.name)})" if numeric else "0L",
                whole_numbers=whole if numeric else "true",
                iso_dates=f"count_if({_is_iso_date(column)})" if isinstance(dtype, T.StringType) else "0L",
            )
        )
    return aggregate_rows(df, rows)


_ID_NAME = f"(label RLIKE {Q.quoted(text.ID_NAME)})"
_IS_NUMBER = "kind IN ('whole', 'real', 'decimal')"

#: The decision list of roles by type, distinct count and name.
_ROLE = f"""coalesce(override, CASE
    WHEN kind = 'flag' THEN 'categorical'
    WHEN kind = 'instant' THEN 'date'
    WHEN kind = 'nested' THEN 'text'
    WHEN {_IS_NUMBER} THEN CASE
        WHEN {_ID_NAME} AND unique_nonmissing >= greatest(2L, floor(nonmissing * 0.8D)) THEN 'identifier'
        WHEN unique_nonmissing <= 10 AND nonmissing >= 5 AND whole_numbers THEN 'ordinal'
        ELSE 'numeric' END
    WHEN nonmissing >= 2 AND iso_dates / nonmissing >= 0.9D THEN 'date'
    WHEN {_ID_NAME} AND unique_nonmissing / greatest(1L, nonmissing) >= 0.8D THEN 'identifier'
    WHEN unique_nonmissing <= 20 OR unique_nonmissing / greatest(1L, nonmissing) <= 0.2D THEN 'categorical'
    ELSE 'text' END)"""
_UNSURE_SCALE = f"(override IS NULL AND {_IS_NUMBER} AND role = 'ordinal')"
_UNSURE_DATE = "(override IS NULL AND kind = 'text' AND role = 'date')"
_NOTES = f"""CASE
    WHEN override IS NOT NULL THEN array({Q.quoted(wording.NOTE_OVERRIDE)})
    WHEN {_UNSURE_SCALE} THEN array({Q.quoted(wording.NOTE_ORDINAL)})
    WHEN {_UNSURE_DATE} THEN array({Q.quoted(wording.NOTE_DATE)})
    ELSE CAST(array() AS ARRAY<STRING>) END"""


def profile(
    df: DataFrame, overrides: Mapping[str, str] | None = None, *, approximate_distinct: bool = False
) -> DataFrame:
    """One row per column with counts and the inferred role.

    ``position, column_id, label, role, role_uncertain, dtype, nonmissing, unique_nonmissing, missing, nonfinite,
    notes``. ``approximate_distinct`` swaps the exact distinct counts (a shuffle of distinct values) for
    HyperLogLog estimates (no shuffle to speak of); roles then follow the estimates.
    """
    overrides = dict(overrides or {})
    for role in overrides.values():
        if role not in wording.ROLES:
            raise AnalysisError(f"Unknown role '{role}'.")
    counts = _estimated_counts(df) if approximate_distinct else _exact_counts(df)
    # One row per column on both sides; columns of an empty table have no counts.
    known = _column_facts(df, overrides).join(F.broadcast(counts), "position", "left")
    return (
        known.selectExpr(
            "position", "column_id", "label", "dtype", "kind", "override",
            *[f"coalesce({name}, 0L) AS {name}" for name in ("nonmissing", "unique_nonmissing", "missing", "nonfinite", "iso_dates")],
            "coalesce(whole_numbers, true) AS whole_numbers",
        )
        .selectExpr("*", f"{_ROLE} AS role")
        .selectExpr(
            "position", "column_id", "label", "role", f"{_UNSURE_SCALE} OR {_UNSURE_DATE} AS role_uncertain", "dtype", "nonmissing",
            "IF(kind = 'nested', NULL, unique_nonmissing) AS unique_nonmissing", "missing", "nonfinite", f"{_NOTES} AS notes",
        )
    )


infer_roles = profile


# --- single aggregates ----------------------------------------------------------------------------------------


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and rows beyond the first of each identical row (missing equals missing).

    Groups by all columns with long texts replaced by their SHA-256, so the shuffle carries at most 65 bytes per
    text cell and copies collapse before it.
    """
    keys = [P.identity_key(P.ref(f.name), f.dataType).alias(f"k{i}") for i, f in enumerate(df.schema.fields)]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def missingness(df: DataFrame) -> DataFrame:
    """Missing count and percentage of all rows per column: one scan, no shuffle beyond one row per task."""
    rows = []
    for i, field in enumerate(df.schema.fields, 1):
        gaps = f"count_if({Q.missing(field.name, field.dataType)})"
        rows.append(
            Q.struct(
                position=str(i), variable=Q.quoted(field.name), missing_count=gaps, missing_percent=Q.percent(gaps, "count(1)")
            )
        )
    return aggregate_rows(df, rows)


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, variable_names, data_types, missing_values, duplicate_rows."""
    fields = df.schema.fields
    names = f"array({', '.join(Q.quoted(f.name) for f in fields)})"
    types = f"array({', '.join(Q.quoted(f.dataType.simpleString()) for f in fields)})"
    gaps = f"array({', '.join(f'count_if({Q.missing(f.name, f.dataType)})' for f in fields)})"
    duplicates = duplicate_rows(df).select("duplicate_rows").scalar()
    return (
        df.agg(F.count(F.lit(1)).alias("rows"), F.expr(gaps).alias("_gaps"))
        .selectExpr(
            "rows", f"{len(fields)} AS columns", f"{names} AS variable_names", f"map_from_arrays({names}, {types}) AS data_types",
            f"map_from_arrays({names}, _gaps) AS missing_values",
        )
        .withColumn("duplicate_rows", duplicates)
    )


def _required(names: list[str], what: str) -> list[str]:
    if not names:
        raise AnalysisError(f"The table has no {what} column.")
    return names


def nonfinite_counts(df: DataFrame) -> DataFrame:
    """Finite, missing and non-finite counts per numeric column in one aggregate."""
    rows = [
        Q.struct(
            variable=Q.quoted(name), n=f"count({Q.finite(name)})",
            missing_count=f"count_if({Q.missing(name, P.type_of(df, name))})", nonfinite_count=f"count_if({Q.infinite(name)})",
        )
        for name in _required(P.numeric_columns(df), "numeric")
    ]
    return aggregate_rows(df, rows)


def iso_date_share(df: DataFrame) -> DataFrame:
    """Share of ISO-date-like values per text column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    rows = [
        Q.struct(
            variable=Q.quoted(name), nonmissing=f"count({Q.named(name)})",
            iso_share=f"avg(CAST({_is_iso_date(Q.named(name))} AS INT))",
        )
        for name in _required(names, "text")
    ]
    return aggregate_rows(df, rows)


def integer_scale(df: DataFrame) -> DataFrame:
    """Whether all non-missing values of each numeric column are whole numbers (infinities are not)."""
    rows = []
    for name in _required(P.numeric_columns(df), "numeric"):
        whole = f"IF({Q.number(name)} IS NULL, NULL, pmod({Q.number(name)}, 1D) <= 1e-8D)"
        rows.append(Q.struct(variable=Q.quoted(name), whole_numbers=f"coalesce(bool_and({whole}), true)"))
    return aggregate_rows(df, rows)


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Finite values outside the user's bounds per column; values are flagged, never removed."""
    rows = []
    for name, (low, high) in ranges.items():
        P.require_numeric(df, name)
        if low is not None and high is not None and low > high:
            raise AnalysisError(f"The supplied minimum exceeds the maximum for '{name}'.")
        minimum, maximum = [f"CAST({'NULL' if b is None else repr(float(b))} AS DOUBLE)" for b in (low, high)]
        outside = [f"{Q.finite(name)} < {minimum}"] * (low is not None) + [f"{Q.finite(name)} > {maximum}"] * (high is not None)
        rows.append(
            Q.struct(
                variable=Q.quoted(name), minimum=minimum, maximum=maximum,
                outside_n=f"count_if({' OR '.join(outside) or 'false'})",
            )
        )
    if not rows:
        raise AnalysisError("No valid range was supplied.")
    return aggregate_rows(df, rows)


# --- views of a profile ---------------------------------------------------------------------------------------


def constant_columns(profiled: DataFrame) -> DataFrame:
    """Columns with at most one distinct non-missing value."""
    return profiled.where(F.col("unique_nonmissing") <= 1).select("column_id", "label", "unique_nonmissing")


def identifier_duplicates(profiled: DataFrame) -> DataFrame:
    """Identifier columns that hold a repeated non-missing value."""
    return profiled.where(
        (F.col("role") == "identifier") & (F.col("unique_nonmissing") < F.col("nonmissing"))
    ).select("column_id", "label", "nonmissing", "unique_nonmissing")


def eligible_variables(profiled: DataFrame) -> DataFrame:
    """Which columns may serve as outcome, group or date of an analysis."""
    use = (
        F.when(F.col("role") == "numeric", F.lit("outcome"))
        .when(F.col("role").isin("categorical", "ordinal") & F.col("unique_nonmissing").between(2, 20), F.lit("group"))
        .when(F.col("role") == "date", F.lit("date"))
    )
    return profiled.select("column_id", "label", "role", use.alias("eligible_as")).where(F.col("eligible_as").isNotNull())


def overview_table(profiled: DataFrame, language: str = "en", units: Mapping[str, str] | None = None) -> DataFrame:
    """Variable, localized role (marked when uncertain), valid n, missing n."""
    return profiled.selectExpr(
        "position", f"{Q.display_label('label', units)} AS variable",
        f"concat({Q.choice('role', wording.ROLE_LABELS[language])}, IF(role_uncertain, ' ?', '')) AS role",
        "nonmissing AS valid_n", "missing AS missing_n",
    )


def quality_table(
    profiled: DataFrame, outside: Mapping[str, int] | None = None, units: Mapping[str, str] | None = None
) -> DataFrame:
    """Variable, missing n and %, non-finite n and, when ranges were given, the count outside them."""
    columns = [
        "position", f"{Q.display_label('label', units)} AS variable", "missing AS missing_n",
        f"{Q.percent_text(Q.percent('missing', 'missing + nonmissing'))} AS missing_pct", "nonfinite AS excluded_n",
    ]
    if outside is not None:
        cases = "".join(f" WHEN label = {Q.quoted(name)} THEN {n}L" for name, n in outside.items())
        columns.append(f"CASE{cases} ELSE 0L END AS outside_range_n" if cases else "0L AS outside_range_n")
    return profiled.selectExpr(*columns)


# --- fingerprint ----------------------------------------------------------------------------------------------


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of the content of a row. The position of a missing cell counts, because xxhash64 skips NULLs."""
    keys = [P.identity_key(P.ref(f.name), f.dataType) for f in df.schema.fields]
    return F.xxhash64(F.array(*[key.isNull() for key in keys]), *keys)


def combined_hashes(rows: Column, hash_xor: Column, hash_sum: Column) -> list[Column]:
    """Totals of the counts, XORs and exact sums of parts of a table; those of the parts give those of the whole."""
    zero = F.lit(0).cast("decimal(38,0)")
    return [F.coalesce(F.sum(rows), F.lit(0)).alias("rows"), F.coalesce(F.bit_xor(hash_xor), F.lit(0)).alias("hash_xor"),
            F.coalesce(F.sum(hash_sum).cast("decimal(38,0)"), zero).alias("hash_sum")]


def fingerprint_of(totals: DataFrame, schema: T.StructType, settings: Mapping[str, object] | None = None) -> DataFrame:
    """(rows, fingerprint) from the totals of row hashes (rows, hash_xor, hash_sum), the columns and the settings."""
    declared = json.dumps(
        {"columns": [[f.name, f.dataType.simpleString()] for f in schema.fields], "settings": dict(settings or {})},
        sort_keys=True, ensure_ascii=False, default=str,
    )
    prefix = hashlib.sha256(declared.encode("utf-8")).hexdigest()
    text = F.concat_ws("|", F.lit(prefix), F.col("rows"), F.col("hash_xor"), F.col("hash_sum"))
    return totals.select("rows", F.sha2(text, 256).alias("fingerprint"))


def dataset_fingerprint(df: DataFrame, settings: Mapping[str, object] | None = None) -> DataFrame:
    """An order-insensitive key of content, included columns and settings, for reuse of stored results.

    Row hashes are combined by XOR and by an exact sum, next to the row count, in one aggregate without a shuffle
    of rows; the three are hashed with the settings by SHA-256. ``folder_fingerprint`` keeps the parts of a growing folder.
    """
    hashed = row_hash(df)
    totals = df.select(hashed.alias("_hash")).agg(*combined_hashes(F.lit(1).cast("bigint"), F.col("_hash"), F.col("_hash").cast("decimal(20,0)")))
    return fingerprint_of(totals, df.schema, settings)
