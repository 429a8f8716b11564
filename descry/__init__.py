"""Descriptive profiling and reporting of evaluation data on Spark."""

from descry.errors import AnalysisError
from descry.operators.charts import (
    box_data, box_outliers, compatible_chart_kinds, histogram, missingness_chart, scatter_sample, select_charts,
)
from descry.operators.compare import (
    cohens_d, date_mean_series, date_series_coverage, group_coverage, group_statistics, group_statistics_detailed,
    paired_change_statistics, pearson_relationship, require_group_count,
)
from descry.operators.describe import (
    categorical_profile, categorical_summary, descriptive_statistics, numeric_profile, numeric_summary,
)
from descry.operators.facts import fact_payload, payload_json, suppress_small_cells, with_sentences
from descry.operators.narrative import (
    check_response_schema, expand_fact_tokens, has_broken_token, parse_responses, unknown_facts, validate_narratives,
)
from descry.operators.profile import (
    constant_columns, dataset_fingerprint, dataset_summary, duplicate_rows, eligible_variables, identifier_duplicates,
    infer_roles, integer_scale, iso_date_share, missingness, nonfinite_counts, overview_table, profile, quality_table,
    range_violations, validate_table,
)
from descry.operators.quantiles import exact_quantiles
from descry.plans.report import relabel, report, section_filter
from descry.plans.settings import ReportSettings
from descry.plans.sinks import json_safe, materialized, read_results, result_json, reuse_or_compute, write_results
from descry.sources.delimited import (
    header_audit, infer_text_types, lenient_scan, ragged_audit, separator_audit, strict_scan,
)
from descry.sources.tables import preview, size_gate, trim_trailing_blank

__version__ = "0.1.0"
