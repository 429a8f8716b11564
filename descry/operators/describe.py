"""Descriptive statistics of numeric columns and frequencies of categorical ones, whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.errors import AnalysisError
from descry.functions import predicates as P
from descry.functions import sqltext as Q
from descry.functions.wide import aggregate_rows, entries
from descry.operators.exact_sums import exact_moments
from descry.operators.quantiles import FEW_VALUES, exact_quantiles, quantiles_of_few_values

#: Categories shown, and the label of the remainder.
MAX_CATEGORIES = 20
REMAINDER = "Other"


def defined(statistic: Column) -> Column:
    """NULL instead of NaN for an undefined statistic."""
    return F.nanvl(statistic, F.lit(None).cast("double"))


def _exact_means(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """(position, mean, sd) of each of the SQL ``values`` from exact sums; one row per value."""
    long = entries(df, [Q.struct(position=str(i), value=value) for i, value in enumerate(values)]).where("value IS NOT NULL")
    return exact_moments(long, ["position"], "value", few_keys=True).selectExpr("position", "mean", "sqrt(variance) AS sd")


def descriptive_statistics(df: DataFrame, *, reproducible: bool = False) -> DataFrame:
    """N, mean, sample SD, min, max of the non-missing values of every numeric column; infinities take part.

    ``reproducible`` takes mean and SD from exact sums, so that their bits do not depend on partitioning.
    """
    names = P.numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "variable string, N bigint, mean double, std double, min double, max double")
    rows = []
    for name in names:
        value = Q.number(name)
        rows.append(
            Q.struct(
                variable=Q.quoted(name), N=f"count({value})", mean=f"nanvl(avg({value}), NULL)",
                std=f"nanvl(stddev_samp({value}), NULL)", min=f"min({value})", max=f"max({value})",
            )
        )
    table = aggregate_rows(df, rows)
    if reproducible:
        places = f"array_position(array({', '.join(map(Q.quoted, names))}), variable) - 1"
        moments = F.broadcast(_exact_means(df, [Q.number(name) for name in names]).toDF("position", "mean", "std"))  # one row per column
        table = table.drop("mean", "std").join(moments, F.expr(places) == F.col("position"), "left")
    return table.select("variable", "N", "mean", "std", "min", "max")


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    distinct_counts: Mapping[str, int] | None = None,
    approximate_median: bool = False,
    reproducible: bool = False,
) -> DataFrame:
    """n, missing, non-finite, mean, sd, median, min, max on finite values, one row per numeric column.

    The median is exact. Columns whose distinct count is known (from a profile) and small get it from the counts of
    their values; all others by narrowing ranks, for all columns in the same passes. ``approximate_median`` uses a
    quantile sketch inside the one aggregate instead. ``reproducible`` takes mean and sd from exact sums, in two more passes,
    so that their bits do not depend on partitioning.
    """
    names = list(columns) if columns is not None else P.numeric_columns(df)
    if not names:
        raise AnalysisError("The table has no numeric column.")
    P.require_numeric(df, *names)
    known = distinct_counts or {}

    rows = []
    for i, name in enumerate(names):
        value = Q.finite(name)
        median = f"percentile_approx({value}, 0.5D, 10000)" if approximate_median else "CAST(NULL AS DOUBLE)"
        rows.append(
            Q.struct(
                position=str(i), variable=Q.quoted(name), n=f"count({value})", mean=f"avg({value})", sd=f"stddev_samp({value})",
                median=median, min=f"min({value})", max=f"max({value})",
                missing_count=f"count_if({Q.missing(name, P.type_of(df, name))})", nonfinite_count=f"count_if({Q.infinite(name)})",
            )
        )
    table = aggregate_rows(df, rows)
    if not approximate_median:
        few = [n for n in names if 0 <= known.get(n, -1) <= FEW_VALUES]
        many = [n for n in names if n not in few]
        parts = []
        for chosen, quantiles in ((few, quantiles_of_few_values), (many, partial(exact_quantiles, few_keys=True))):
            if chosen:
                long = entries(df, [Q.struct(position=str(names.index(n)), value=Q.finite(n)) for n in chosen])
                parts.append(quantiles(long, ["position"], "value", [0.5]).select("position", "q0"))
        # At most one row per column on either side.
        medians = F.broadcast(reduce(DataFrame.unionByName, parts))
        table = table.join(medians, "position", "left").withColumn("median", F.col("q0"))
    if reproducible:
        table = table.drop("mean", "sd").join(F.broadcast(_exact_means(df, [Q.finite(name) for name in names])), "position", "left")
    return table.select(
        "position", "variable", "n", "missing_count", "nonfinite_count", "mean", "sd", "median", "min", "max"
    )


def numeric_summary(df: DataFrame, column: str, *, approximate_median: bool = False, reproducible: bool = False) -> DataFrame:
    """The row of ``numeric_profile`` for one column."""
    return numeric_profile(df, [column], approximate_median=approximate_median, reproducible=reproducible).drop("position")


def categorical_profile(
    df: DataFrame, columns: Sequence[str], *, max_categories: int | None = MAX_CATEGORIES
) -> DataFrame:
    """Frequencies per column, count descending then label ascending, percentages of all valid rows.

    Columns with more than ``max_categories`` labels show the most frequent ``max_categories - 1`` and one remainder
    row (``is_remainder``, label ``Other``, a real category of that name stays apart).

    ``position, variable, rank, label, count, percent, valid_n, missing_count, aggregated, is_remainder``. Labels
    are counted with map-side combining; the ranking keeps only the top labels of each task before its shuffle, and
    the remainder comes from the totals, so no task ever holds all labels of a column.
    """
    if not columns:
        raise AnalysisError("No categorical column was selected.")
    if max_categories is None:  # no limit
        max_categories = (1 << 31) - 1
    if max_categories < 1:
        raise AnalysisError("max_categories must be at least 1.")
    long = entries(df, [Q.struct(position=str(i), label=Q.label(n, P.type_of(df, n))) for i, n in enumerate(columns)])
    counts = long.groupBy("position", "label").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("position").agg(
        F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("count"))), F.lit(0)).alias("valid_n"),
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("count"))), F.lit(0)).alias("missing_count"),
        F.count("label").alias("n_labels"),
    )
    # Missing labels rank last; each task keeps only its first labels per column before the ranking shuffle.
    order = Window.partitionBy("position").orderBy(F.col("label").isNull(), F.col("count").desc(), F.col("label"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_categories)
    above = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1))
    top = top.withColumn("_above", F.coalesce(above, F.lit(0))).where("label IS NOT NULL")
    names = f"array({', '.join(Q.quoted(name) for name in columns)})"
    last = f"(n_labels > {max_categories} AND rank = {max_categories})"
    # One row per column, so the broadcast is bounded by the width of the table.
    return top.join(F.broadcast(totals), "position").selectExpr(
        "position", f"{names}[position] AS variable", "rank", f"IF({last}, {Q.quoted(REMAINDER)}, label) AS label",
        f"IF({last}, valid_n - _above, count) AS count", "valid_n", "missing_count",
        f"n_labels > {max_categories} AS aggregated", f"{last} AS is_remainder",
    ).selectExpr(
        "position", "variable", "rank", "label", "count", f"{Q.percent('count', 'valid_n')} AS percent", "valid_n", "missing_count",
        "aggregated", "is_remainder",
    )


def categorical_summary(df: DataFrame, column: str, *, max_categories: int | None = MAX_CATEGORIES) -> DataFrame:
    """The rows of ``categorical_profile`` for one column."""
    return categorical_profile(df, [column], max_categories=max_categories).drop("position")
