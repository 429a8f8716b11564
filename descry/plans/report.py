"""One call that computes every result table of a report.

``report(df, settings)`` runs the profile as its only mandatory job and brings back one row per column. Everything
else is returned as DataFrames that have not run yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cache, reduce
from math import prod

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from descry import wording
from descry.errors import AnalysisError
from descry.functions import predicates as P
from descry.functions import sqltext as Q
from descry.functions.wide import literal_table
from descry.operators import charts, compare, describe, facts, profile
from descry.operators.quantiles import FEW_VALUES
from descry.plans.settings import REQUIRED_SECTIONS, ReportSettings

#: Fixed value: rows per printed part of a table.
ROWS_PER_PART = 35

_STATISTICS = ("mean", "sd", "median", "min", "max")
_STATISTIC_LABELS = ("mean", "sd", "median", "minimum", "maximum")


def relabel(df: DataFrame, overrides: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns to display labels; returns the table and the old-to-new names. Labels must stay unique."""
    renames = {old: new.strip() for old, new in overrides.items() if old in df.columns and new.strip() not in ("", old)}
    labels = [renames.get(name, name) for name in df.columns]
    if len(set(labels)) < len(labels):
        raise AnalysisError("Display labels must remain unique.")
    return df.select(*[P.ref(name).alias(label) for name, label in zip(df.columns, labels)]), renames


def _rekeyed(settings: ReportSettings, renames: Mapping[str, str]) -> ReportSettings:
    """The settings with every column name replaced by its display label."""

    def by_label(entries: Mapping[str, object]) -> dict:
        return {renames.get(name, name): value for name, value in entries.items()}

    single = ("outcome", "group", "relationship_first", "relationship_second", "pre", "post", "date_variable", "time_outcome")
    return replace(
        settings,
        role_overrides=by_label(settings.role_overrides),
        units={name: unit.strip() for name, unit in by_label(settings.units).items() if unit.strip()},
        valid_ranges=by_label(settings.valid_ranges),
        **{name: renames.get(getattr(settings, name), getattr(settings, name)) for name in single},
    )


class Tables(Mapping[str, DataFrame]):
    """Result tables by name; each is planned when first asked for."""

    def __init__(self, plans: dict[str, Callable[[], DataFrame]]):
        self._plans, self._tables = plans, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._plans[name]()
        return self._tables[name]

    def __contains__(self, name: object) -> bool:
        return name in self._plans

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


def report(df: DataFrame, settings: ReportSettings | None = None, *, parsing: Mapping[str, object] | None = None) -> Tables:
    """All result tables of a report.

    Always: ``profile, quality, quality_counts, constants, identifier_duplicates, overview, facts, chart_specs,
    fingerprint, sections``; where there are such columns ``numeric, numeric_text, categorical, categorical_text,
    range_violations``; and by report type ``group, group_coverage, effect``, ``relationship``, ``change`` or
    ``time, time_coverage``.
    """
    settings = settings or ReportSettings()
    settings.check_selectors()
    order_keys = list(settings.order_by)
    kept = list(settings.columns) if settings.columns is not None else df.columns
    absent = [name for name in (*kept, *order_keys) if name not in df.columns]
    if absent:
        raise AnalysisError(f"Unknown columns: {', '.join(absent)}.")
    original_ids = profile.column_ids(df)
    included = df.select(*[P.ref(name) for name in kept])
    profile.validate_table(included, check_rows=False)
    data, renames = relabel(included, settings.label_overrides)
    ids = {renames.get(name, name): original_ids[name] for name in kept}
    settings = _rekeyed(settings, renames)
    # The order columns need not be part of the report; they travel under names of their own.
    order_names = [f"__order_{i}" for i in range(len(order_keys))]
    with_order = df.select(
        *[P.ref(name).alias(renames.get(name, name)) for name in kept],
        *[P.ref(name).alias(alias) for name, alias in zip(order_keys, order_names)],
    )

    profiled, rows = _materialized_profile(data, settings, ids)
    by_label = {row["label"]: row for row in rows}
    numeric = [row["label"] for row in rows if row["role"] == "numeric"]
    categorical = [row["label"] for row in rows if row["role"] in ("categorical", "ordinal")]
    if numeric:
        P.require_numeric(data, *numeric)
    plans: dict[str, Callable[[], DataFrame]] = {}
    tables = Tables(plans)

    plans["profile"] = lambda: profiled
    ranges = {n: b for n, b in settings.valid_ranges.items() if n in by_label and by_label[n]["role"] == "numeric"}
    if ranges:
        violations = profile.range_violations(data, ranges)
        plans["range_violations"] = lambda: violations
    plans["quality"] = lambda: _quality(tables, settings)
    plans["quality_counts"] = lambda: profile.duplicate_rows(data)
    plans["overview"] = lambda: profile.overview_table(profiled, settings.language, settings.units)
    plans["constants"] = lambda: profile.constant_columns(profiled)
    plans["identifier_duplicates"] = lambda: profile.identifier_duplicates(profiled)
    plans["fingerprint"] = lambda: profile.dataset_fingerprint(data, settings.as_dict() | {"parsing": dict(parsing or {})})
    if numeric:
        distinct = {} if settings.approximate_distinct else {n: by_label[n]["unique_nonmissing"] for n in numeric}
        plans["numeric"] = lambda: describe.numeric_profile(data, numeric, distinct_counts=distinct, reproducible=settings.reproducible)
        plans["numeric_text"] = lambda: numeric_table(tables["numeric"], settings.units)
    if categorical:
        plans["categorical"] = lambda: describe.categorical_profile(data, categorical)
        plans["categorical_text"] = lambda: categorical_tables(tables["categorical"], settings.language)

    analysis = _selected_analysis(with_order, data, settings, by_label, order_names, plans)

    def found_facts() -> DataFrame:
        found = [facts.dataset_fact(profiled), facts.missing_facts(profiled, settings.units)]
        if numeric:
            found.append(facts.numeric_facts(tables["numeric"], ids, settings.units))
        if analysis is not None and analysis.fact is not None:
            found.append(analysis.fact())
        return facts.with_sentences(reduce(DataFrame.unionByName, found), [settings.language])

    def chart_specs() -> DataFrame:
        primary = analysis.chart() if analysis is not None else None
        if primary is not None:
            primary["labels"] = [_shown(name, settings.units) for name in primary["labels"]]
        return charts.select_charts(
            profiled, depth=settings.depth, primary=primary, preferred_kind=settings.preferred_chart,
            language=settings.language, units=settings.units,
        )

    plans["facts"] = found_facts
    plans["chart_specs"] = chart_specs
    plans["sections"] = lambda: section_filter(section_table(tables, settings), settings.sections)
    return tables


def _quality(tables: Mapping[str, DataFrame], settings: ReportSettings) -> DataFrame:
    """The quality table; counts outside ranges are one small row per checked column."""
    outside = None
    if settings.valid_ranges:
        checked = tables["range_violations"].collect() if "range_violations" in tables else []
        outside = {row["variable"]: row["outside_n"] for row in checked}
    return profile.quality_table(tables["profile"], outside, settings.units)


def _shown(name: str, units: Mapping[str, str]) -> str:
    return f"{name} ({units[name]})" if name in units else name


def _materialized_profile(
    data: DataFrame, settings: ReportSettings, ids: Mapping[str, str]
) -> tuple[DataFrame, list[Row]]:
    """Run the profile once and keep its few rows, with ids by position in the whole table."""
    lazy = profile.profile(data, settings.role_overrides, approximate_distinct=settings.approximate_distinct)
    rows = sorted(lazy.collect(), key=lambda row: row["position"])
    if all(row["nonmissing"] + row["missing"] == 0 for row in rows):
        raise AnalysisError("The table must contain at least one data row.")
    rows = [Row(**{**row.asDict(), "column_id": ids[row["label"]]}) for row in rows]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lazy.schema.fields)
    return literal_table(data.sparkSession, [row.asDict() for row in rows], schema), rows


@dataclass(frozen=True)
class _Analysis:
    """What a selected analysis adds to the facts and charts, planned on demand."""

    chart: Callable[[], dict[str, object]]
    fact: Callable[[], DataFrame] | None


def _selected_analysis(
    with_order: DataFrame,
    data: DataFrame,
    settings: ReportSettings,
    by_label: Mapping[str, Row],
    order_names: Sequence[str],
    plans: dict[str, Callable[[], DataFrame]],
) -> _Analysis | None:
    """Check the variables of the report type and plan its tables."""

    def need(roles: tuple[str, ...], *names: str) -> None:
        for name in names:
            if name not in by_label or by_label[name]["role"] not in roles:
                raise AnalysisError(f"'{name}' is not an eligible variable: its role must be {' or '.join(roles)}.")

    def small(*names: str) -> bool:
        counts = [by_label[name]["unique_nonmissing"] for name in names]
        return not settings.approximate_distinct and prod(counts) <= FEW_VALUES

    def chart(kind: str, topic: str, names: Sequence[str], valid_n: Callable[[], int]) -> Callable[[], dict[str, object]]:
        return lambda: {
            "chart_id": f"chart_primary_{topic}", "kind": kind, "variable_ids": [by_label[n]["column_id"] for n in names],
            "labels": list(names), "valid_n": valid_n(),
        }

    if settings.report_type == "group":
        outcome, group = settings.outcome, settings.group
        need(("numeric",), outcome)
        need(("categorical", "ordinal"), group)
        k = by_label[group]["unique_nonmissing"]
        if settings.approximate_distinct:
            k = compare.require_group_count(data, group, high=settings.max_groups)
        if not 2 <= k <= settings.max_groups:
            raise AnalysisError(f"{k} groups were observed; a group report takes 2–{settings.max_groups}.")
        distinct = by_label[outcome]["unique_nonmissing"] if small(outcome) else None
        plans["group"] = lambda: compare.group_statistics_detailed(
            with_order, outcome, group, order_by=order_names, few_groups=k <= compare.FEW_GROUPS, outcome_distinct=distinct,
            reproducible=settings.reproducible,
        )
        plans["group_coverage"] = lambda: compare.group_coverage(data, outcome, group)
        covered = cache(lambda: compare.group_coverage(data, outcome, group).head()["valid_n"])
        fact = None
        if settings.independent_groups and k == 2:
            effect = cache(lambda: compare.cohens_d(with_order, outcome, group, order_by=order_names, reproducible=settings.reproducible))
            plans["effect"] = effect
            fact = lambda: facts.difference_fact(effect(), covered())
        return _Analysis(chart("box", "group", [outcome, group], covered), fact)
    if settings.report_type == "relationships":
        pair = [settings.relationship_first, settings.relationship_second]
        need(("numeric",), *pair)
        P.require_distinct(*pair)
        relationship = cache(lambda: compare.pearson_relationship(data, *pair, reproducible=settings.reproducible))
        plans["relationship"] = relationship
        return _Analysis(
            chart("scatter", "relationship", pair, lambda: relationship().head()["n"]),
            lambda: facts.relationship_fact(relationship()),
        )
    if settings.report_type == "change":
        pair = [settings.pre, settings.post]
        need(("numeric",), *pair)
        P.require_distinct(*pair)
        # The difference may have as many values as there are pairs of values, so only tiny columns count as few.
        change = cache(lambda: compare.paired_change_statistics(data, *pair, few_values=small(*pair), reproducible=settings.reproducible))
        plans["change"] = change
        n = lambda: data.agg(F.count_if(P.finite(P.ref(pair[0])).isNotNull() & P.finite(P.ref(pair[1])).isNotNull())).head()[0]
        return _Analysis(chart("paired", "change", pair, n), lambda: facts.change_fact(change()))
    if settings.report_type == "time":
        date, outcome = settings.date_variable, settings.time_outcome
        need(("date",), date)
        need(("numeric",), outcome)
        plans["time"] = lambda: compare.date_mean_series(data, date, outcome, reproducible=settings.reproducible)
        coverage = cache(lambda: compare.date_series_coverage(data, date, outcome))
        plans["time_coverage"] = coverage
        return _Analysis(
            chart("date_line", "time", [date, outcome], lambda: coverage().head()["valid_n"]), lambda: facts.time_fact(coverage())
        )
    return None


# --- text tables ----------------------------------------------------------------------------------------------


def _statistic_columns() -> list[str]:
    return [f"{Q.statistic_text(name)} AS {text}" for name, text in zip(_STATISTICS, _STATISTIC_LABELS)]


def numeric_table(numeric: DataFrame, units: Mapping[str, str] | None = None) -> DataFrame:
    """Formatted statistics per numeric column."""
    return numeric.selectExpr(
        "position", f"{Q.display_label('variable', units)} AS variable", f"{Q.count_text('n')} AS valid_n", *_statistic_columns()
    )


def categorical_tables(categorical: DataFrame, language: str = "en", *, tables: int | None = None) -> DataFrame:
    """Formatted frequencies; the remainder row carries the localized 'Other'. ``tables`` limits the display."""
    shown = categorical if tables is None else categorical.where(F.col("position") < tables)
    return shown.selectExpr(
        "concat('categorical_', position + 1) AS table_id", "variable", "rank AS row_no",
        f"IF(is_remainder, {Q.quoted(wording.label(language, 'other'))}, label) AS category", f"{Q.count_text('count')} AS count",
        f"{Q.percent_text('percent')} AS percent",
    )


def group_table(group: DataFrame) -> DataFrame:
    """Formatted statistics per group."""
    return group.selectExpr("group", "first_seen", f"{Q.count_text('n')} AS valid_n", *_statistic_columns())


def with_parts(table: DataFrame, row_no: str = "row_no", rows: int = ROWS_PER_PART) -> DataFrame:
    """Number the printed parts of a table by its row numbers, 35 rows each."""
    return table.withColumn("part", (F.floor((F.col(row_no) - 1) / rows) + 1).cast("int"))


def _cells(table: DataFrame, section: str, table_id: str, row_no: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """A text table as one row per cell; ``table_id`` and ``row_no`` are SQL."""
    cells = [
        Q.struct(column_no=str(i), column_label=Q.quoted(label), value=f"CAST({Q.named(name)} AS STRING)")
        for i, (name, label) in enumerate(columns, 1)
    ]
    return table.selectExpr(
        f"'{section}' AS section", f"{table_id} AS table_id", f"CAST({row_no} AS BIGINT) AS row_no", f"inline(array({', '.join(cells)}))"
    )


def section_table(results: Mapping[str, DataFrame], settings: ReportSettings) -> DataFrame:
    """Sentences and text tables of a report in one long table: section, table_id, row_no, column_no, column_label, value."""
    language = settings.language

    def labelled(*names: str) -> list[tuple[str, str]]:
        keys = {"missing_pct": "missing_pct", "outside_range_n": "outside_range"}
        return [(name, wording.label(language, keys.get(name, name))) for name in names]

    sentences = results["facts"].select("ordinal", "kind", "sentence")
    section_of = {
        "overview": ["dataset"], "quality": ["missingness"], "descriptive": ["numeric_descriptive"],
        "primary": ["group_difference", "relationship", "paired_change", "date_series"],
    }
    section_cases = {kind: section for section, kinds in section_of.items() for kind in kinds}
    placed = sentences.selectExpr("*", f"{Q.choice('kind', section_cases)} AS place")
    parts = [
        placed.selectExpr(
            "place AS section", "'sentences' AS table_id", "ordinal + 1 AS row_no", "1 AS column_no", "'' AS column_label", "sentence AS value"
        ),
        _cells(sentences.where("kind = 'dataset'"), "executive", "'sentences'", "ordinal + 1", [("sentence", "")]),
        _cells(
            results["overview"], "overview", "'overview_variables'", "position", labelled("variable", "role", "valid_n", "missing_n")
        ),
    ]
    quality_columns = ["variable", "missing_n", "missing_pct", "excluded_n"]
    if "outside_range_n" in results["quality"].columns:
        quality_columns.append("outside_range_n")
    parts.append(_cells(results["quality"], "quality", "'quality_missing'", "position", labelled(*quality_columns)))
    if "range_violations" in results:
        order = ", ".join(map(Q.quoted, settings.valid_ranges))
        ranges = facts.range_sentences(results["range_violations"], language, settings.units)
        parts.append(_cells(ranges, "quality", "'range_sentences'", f"array_position(array({order}), variable)", [("sentence", "")]))
    if "numeric" in results:
        columns = labelled("variable", "valid_n", *_STATISTIC_LABELS)
        parts.append(_cells(results["numeric_text"], "descriptive", "'numeric_descriptives'", "position + 1", columns))
    if "categorical" in results:
        shown = categorical_tables(results["categorical"], language, tables=settings.max_categorical_tables)
        parts.append(_cells(shown, "descriptive", "table_id", "row_no", labelled("category", "count", "percent")))
        if settings.max_categorical_tables is not None:
            omitted = results["categorical"].where(F.col("position") >= settings.max_categorical_tables).select("position", "variable").distinct()
            parts.append(_cells(omitted, "descriptive", "'omitted_tables'", "position + 1", [("variable", "")]))
    if "group" in results:
        # At most ``max_groups`` groups: their order is their place in the sorted list of all.
        rows = group_table(results["group"])
        order = rows.agg(F.expr("array_sort(collect_list(struct(first_seen, `group`)))")).scalar()
        numbered = rows.withColumn("row_no", F.array_position(order, F.struct("first_seen", "group")))
        columns = [("group", wording.label(language, "group")), *labelled("valid_n", *_STATISTIC_LABELS)]
        parts.append(_cells(numbered, "primary", "'group_summary'", "row_no", columns))
        if "effect" not in results:
            reason = {"sentence": wording.sentence(language, "effect_unavailable")}
            reason = literal_table(rows.sparkSession, [reason], "sentence string")
            parts.append(_cells(reason, "primary", "'sentences'", "1", [("sentence", "")]))
    return reduce(DataFrame.unionByName, parts)


def section_filter(table: DataFrame, chosen: Sequence[str], *, with_narrative: bool = False) -> DataFrame:
    """Keep the chosen sections and those every report has."""
    kept = set(chosen) | set(REQUIRED_SECTIONS) | ({"interpretation"} if with_narrative else set())
    return table.where(F.col("section").isin(*sorted(kept)))
