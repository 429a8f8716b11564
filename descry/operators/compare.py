"""Group statistics, effect size, correlation, paired change and date series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.errors import AnalysisError
from descry.functions import predicates as P
from descry.functions.dates import as_instant, iso_text
from descry.functions import sqltext as Q
from descry.functions.wide import aggregate_rows, entries
from descry.operators.describe import defined
from descry.operators.exact_sums import exact_moments, exact_totals
from descry.operators.quantiles import FEW_VALUES, exact_quantiles, quantiles_of_few_values
from descry.sources.positions import row_position

#: Groups up to which per-group bounds may be broadcast.
FEW_GROUPS = 1_000


def _order_key(df: DataFrame, order_by: Sequence[str] | None) -> Column:
    """What 'first' means: the given order columns, else the place in the files that the rows come from, else nothing (then
    groups are ordered by label). One order column comes as it is: its least value is found by hashing, that of structs by
    sorting."""
    if not order_by:
        position = row_position(df)
        return F.lit(None).cast("string") if position is None else position
    if len(order_by) == 1:
        return P.ref(order_by[0])
    return F.struct(*[P.ref(name).alias(f"o{i}") for i, name in enumerate(order_by)])


def _first_seen(order_by: Sequence[str] | None) -> Column:
    """The least order key of a group (column ``_order``): a struct, or null where there is no order."""
    least = F.min("_order")
    return (F.struct(least.alias("o0")) if order_by and len(order_by) == 1 else least).alias("first_seen")


def _check_outcome_and_group(df: DataFrame, outcome: str, group: str) -> None:
    P.require_distinct(outcome, group)
    P.type_of(df, group)
    P.require_numeric(df, outcome)


def count_groups(df: DataFrame, group: str, limit: int) -> int:
    """Number of distinct non-missing groups, counted up to ``limit + 1``. Runs one small job."""
    present = P.present(P.ref(group), P.type_of(df, group))
    return df.where(present).select(P.ref(group)).distinct().limit(limit + 1).count()


def require_group_count(df: DataFrame, group: str, low: int = 2, high: int = 20) -> int:
    """Reject grouping variables without 2 to 20 observed groups; returns the number."""
    found = count_groups(df, group, high)
    if not low <= found <= high:
        raise AnalysisError(f"The number of observed groups is not within {low}–{high}.")
    return found


def _with_moments(statistics: DataFrame, rows: DataFrame, few_groups: bool) -> DataFrame:
    """``statistics`` (_group, ...) with mean and variance of ``_value`` from exact sums."""
    moments = exact_moments(rows, ["_group"], "_value", few_keys=few_groups).select(F.col("_group").alias("_of"), "mean", "variance")
    # At most FEW_GROUPS rows where it is broadcast.
    return statistics.join(F.broadcast(moments) if few_groups else moments, F.col("_group").eqNullSafe(F.col("_of")), "left").drop("_of")


def group_statistics(
    df: DataFrame, outcome: str, group: str, *, order_by: Sequence[str] | None = None, reproducible: bool = False
) -> DataFrame:
    """N, mean, std, min, max per group over rows with both values; infinities take part.

    ``first_seen`` holds the smallest order key of the group; sort by it for first-seen order. Without ``order_by`` the key is
    the row's place in its file (see ``row_position``), and null where the rows come from no file. ``reproducible`` takes
    mean and std from exact sums, so that their bits do not depend on partitioning.
    """
    _check_outcome_and_group(df, outcome, group)
    group_type = P.type_of(df, group)
    value = P.as_number(P.ref(outcome))
    rows = df.where(P.present(P.ref(group), group_type) & value.isNotNull()).select(
        P.ref(group).alias("_group"), value.alias("_value"), _order_key(df, order_by).alias("_order")
    )
    found = rows.groupBy("_group").agg(
        F.count("_value").alias("N"), F.min("_value").alias("min"), F.max("_value").alias("max"), _first_seen(order_by),
        *[] if reproducible else [F.avg("_value").alias("mean"), F.stddev_samp("_value").alias("std")],
    )
    if reproducible:
        found = _with_moments(found, rows, False).withColumn("std", F.sqrt("variance"))
    return found.select(
        P.label_text(F.col("_group"), group_type).alias("group"), "N", defined(F.col("mean")).alias("mean"), defined(F.col("std")).alias("std"),
        "min", "max", "first_seen",
    )


def group_statistics_detailed(
    df: DataFrame,
    outcome: str,
    group: str,
    *,
    order_by: Sequence[str] | None = None,
    outcome_distinct: int | None = None,
    few_groups: bool | None = None,
    reproducible: bool = False,
) -> DataFrame:
    """n, mean, sd, median, min, max of finite outcomes per group; groups without any are kept.

    ``reproducible`` takes mean and sd from exact sums, so that their bits do not depend on partitioning.
    ``outcome_distinct`` is the outcome's distinct count where a profile knows it; when small, medians come from the
    counts of its values. Otherwise ranks are narrowed; ``few_groups`` then says whether the number of groups is
    known to be small, and when it is None, a job counts them up to 1,000.
    """
    _check_outcome_and_group(df, outcome, group)
    group_type = P.type_of(df, group)
    rows = df.where(P.present(P.ref(group), group_type)).select(
        P.ref(group).alias("_group"), P.finite(P.ref(outcome)).alias("_value"), _order_key(df, order_by).alias("_order")
    )
    statistics = rows.groupBy("_group").agg(
        F.count("_value").alias("n"), F.min("_value").alias("min"), F.max("_value").alias("max"), _first_seen(order_by),
        *[] if reproducible else [F.avg("_value").alias("mean"), F.stddev_samp("_value").alias("sd")],
    )
    if outcome_distinct is not None and outcome_distinct <= FEW_VALUES:
        medians = quantiles_of_few_values(rows, ["_group"], "_value", [0.5])
    else:
        if few_groups is None:
            few_groups = count_groups(df, group, FEW_GROUPS) <= FEW_GROUPS
        medians = exact_quantiles(rows, ["_group"], "_value", [0.5], few_keys=few_groups)
    if reproducible:
        statistics = _with_moments(statistics, rows, bool(few_groups)).withColumn("sd", F.sqrt("variance"))
    medians = medians.select(F.col("_group").alias("_g"), F.col("q0").alias("median"))
    if few_groups:
        medians = F.broadcast(medians)
    statistics = statistics.join(medians, F.col("_group") == F.col("_g"), "left")
    return statistics.select(
        P.label_text(F.col("_group"), group_type).alias("group"),
        "n", "mean", "sd", "median", "min", "max", "first_seen",
    )


def group_coverage(df: DataFrame, outcome: str, group: str) -> DataFrame:
    """valid_n and excluded_count of a group analysis."""
    _check_outcome_and_group(df, outcome, group)
    usable = P.present(P.ref(group), P.type_of(df, group)) & P.finite(P.ref(outcome)).isNotNull()
    return df.agg(F.count_if(usable).alias("valid_n"), F.count_if(~usable).alias("excluded_count"))


def cohens_d(
    df: DataFrame,
    outcome: str,
    group: str,
    *,
    order_by: Sequence[str] | None = None,
    infinite_as_missing: bool = True,
    reproducible: bool = False,
) -> DataFrame:
    """First-seen minus second group: mean difference and pooled-SD Cohen's d, one row.

    Groups follow their first appearance among complete cases: by ``order_by``, else by the place in the files that the rows
    come from, else by label. ``reproducible`` takes the moments from exact sums. Where d is undefined, ``reason`` says why:
    ``not_two_groups``, ``group_too_small`` (fewer than two values) or ``zero_pooled_variance``.
    """
    _check_outcome_and_group(df, outcome, group)
    group_type = P.type_of(df, group)
    value = P.finite(P.ref(outcome)) if infinite_as_missing else P.as_number(P.ref(outcome))
    rows = df.where(P.present(P.ref(group), group_type) & value.isNotNull()).select(
        P.ref(group).alias("_group"), value.alias("_value"), _order_key(df, order_by).alias("_order")
    )
    groups = rows.groupBy("_group").agg(
        F.count("_value").alias("n"), _first_seen(order_by),
        *[] if reproducible else [F.avg("_value").alias("mean"), F.var_samp("_value").alias("variance")],
    )
    if reproducible:
        groups = _with_moments(groups, rows, False)
    described = F.struct(
        "first_seen", P.label_text(F.col("_group"), group_type).alias("label"), "n", "mean", "variance"
    )
    ends = groups.agg(
        F.count(F.lit(1)).alias("k"), F.min(described).alias("a"), F.max(described).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    degrees = a["n"] + b["n"] - 2
    pooled = defined(F.try_divide((a["n"] - 1) * a["variance"] + (b["n"] - 1) * b["variance"], degrees))
    difference = a["mean"] - b["mean"]
    reason = (
        F.when(F.col("k") != 2, F.lit("not_two_groups"))
        .when((a["n"] < 2) | (b["n"] < 2), F.lit("group_too_small"))
        .when(pooled.isNull() | (pooled <= 0) | (pooled == F.lit(P.INFINITY)), F.lit("zero_pooled_variance"))
    )
    two = F.col("k") == 2
    return ends.withColumn("reason", reason).select(
        F.when(two, a["label"]).alias("group_1"), F.when(two, b["label"]).alias("group_2"),
        F.when(two, a["n"]).alias("n_1"), F.when(two, b["n"]).alias("n_2"),
        F.when(F.col("reason").isNull(), difference).alias("mean_difference"),
        F.when(F.col("reason").isNull(), difference / F.sqrt(pooled)).alias("cohens_d"),
        "reason",
    )


def _exact_covariance(pairs: DataFrame) -> DataFrame:
    """One row (covariance, sd_x, sd_y) of the complete pairs (x, y), from exact sums."""
    long = entries(pairs, [Q.struct(position=str(i), value=name) for i, name in enumerate(("x", "y"))])
    moments = exact_moments(long, ["position"], "value", few_keys=True)
    both = moments.agg(*[
        F.max(F.when(F.col("position") == i, F.col(part))).alias(f"{part}_{name}") for part in ("n", "mean", "variance") for i, name in enumerate("xy")
    ])
    products = pairs.join(F.broadcast(both), F.lit(True)).selectExpr("(x - mean_x) * (y - mean_y) AS product")  # one row
    total = exact_totals(products, [], f"IF(abs(product) < {Q.INFINITY}, product, NULL)")
    return both.join(F.broadcast(total), F.lit(True), "left").selectExpr(
        "IF(n_x > 1, coalesce(total, 0D) / (n_x - 1), NULL) AS covariance", "sqrt(variance_x) AS sd_x", "sqrt(variance_y) AS sd_y")


def pearson_relationship(df: DataFrame, first: str, second: str, *, reproducible: bool = False) -> DataFrame:
    """Pearson r on pairwise finite rows with n, excluded_count and the reason where r is undefined.

    ``reproducible`` takes r from exact sums, so that its bits do not depend on partitioning.
    """
    P.require_distinct(first, second)
    P.require_numeric(df, first, second)
    x, y = P.finite(P.ref(first)), P.finite(P.ref(second))
    pair = x.isNotNull() & y.isNotNull()
    px, py = F.when(pair, x), F.when(pair, y)
    sums = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(px).alias("n"),
        *[] if reproducible else [F.covar_samp(px, py).alias("covariance"), F.stddev_samp(px).alias("sd_x"), F.stddev_samp(py).alias("sd_y")],
        (F.min(px) == F.max(px)).alias("flat_x"), (F.min(py) == F.max(py)).alias("flat_y"),
    )
    if reproducible:
        sums = sums.join(F.broadcast(_exact_covariance(df.where(pair).select(x.alias("x"), y.alias("y")))), F.lit(True), "left")  # one row each
    reason = F.when(F.col("n") < 3, F.lit("fewer_than_three_pairs")).when(
        F.col("flat_x") | F.col("flat_y"), F.lit("zero_variance")
    )
    r = F.try_divide(F.col("covariance"), F.col("sd_x") * F.col("sd_y"))
    return sums.withColumn("reason", reason).select(
        F.lit(first).alias("first"), F.lit(second).alias("second"), "n",
        (F.col("rows") - F.col("n")).alias("excluded_count"),
        F.when(F.col("reason").isNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
        "reason",
    )


def paired_change_statistics(
    df: DataFrame, pre: str, post: str, *, few_values: bool = False, reproducible: bool = False
) -> DataFrame:
    """n, mean, sd, median of pre, post and post minus pre on the identical finite pairs: three rows.

    ``reproducible`` takes means and sds from exact sums. ``few_values`` states that pre, post and their difference are known to have few distinct values.
    """
    P.require_distinct(pre, post)
    P.require_numeric(df, pre, post)
    pairs = df.select(P.finite(P.ref(pre)).alias("pre"), P.finite(P.ref(post)).alias("post"))
    paired = "(pre IS NOT NULL AND post IS NOT NULL)"
    measures = {"pre": "pre", "post": "post", "change": "post - pre"}
    rows = []
    for i, (name, value) in enumerate(measures.items()):
        value = f"IF({paired}, {value}, NULL)"
        rows.append(
            Q.struct(
                position=str(i), measure=Q.quoted(name), n=f"count({value})", mean=f"avg({value})", sd=f"stddev_samp({value})",
                excluded_count=f"count_if(NOT {paired})",
            )
        )
    table = aggregate_rows(pairs, rows)
    long = entries(pairs.where(paired), [Q.struct(position=str(i), value=value) for i, value in enumerate(measures.values())])
    quantiles = quantiles_of_few_values if few_values else partial(exact_quantiles, few_keys=True)
    medians = quantiles(long, ["position"], "value", [0.5]).select("position", F.col("q0").alias("median"))
    # Three rows on either side.
    table = table.join(F.broadcast(medians), "position", "left")
    if reproducible:
        moments = exact_moments(long, ["position"], "value", few_keys=True).selectExpr("position", "mean", "sqrt(variance) AS sd")
        table = table.drop("mean", "sd").join(F.broadcast(moments), "position", "left")
    return table.select(
        "measure", "n", "mean", "sd", "median", "excluded_count", F.lit("post_minus_pre").alias("direction")
    )


def _dated(df: DataFrame, date: str, outcome: str) -> DataFrame:
    P.require_distinct(date, outcome)
    P.require_numeric(df, outcome)
    return df.select(
        as_instant(P.ref(date), P.type_of(df, date)).alias("instant"), P.finite(P.ref(outcome)).alias("value")
    )


def date_mean_series(df: DataFrame, date: str, outcome: str, *, reproducible: bool = False) -> DataFrame:
    """Mean and count of finite outcomes by date, ascending; times are not truncated, nothing is interpolated.

    ``reproducible`` takes the means from exact sums.
    """
    rows = _dated(df, date, outcome).where(F.col("instant").isNotNull() & F.col("value").isNotNull())
    if reproducible:
        counts = rows.groupBy("instant").agg(F.count("value").alias("count"))
        totals = exact_totals(rows, ["instant"], "value").toDF("_of", "total")
        means = counts.join(totals, F.col("instant") == F.col("_of"), "left").selectExpr("instant", "coalesce(total, 0D) / count AS mean", "count")
    else:
        means = rows.groupBy("instant").agg(F.avg("value").alias("mean"), F.count("value").alias("count"))
    return means.orderBy("instant").select(iso_text(F.col("instant")).alias("date"), "mean", "count")


def date_series_coverage(df: DataFrame, date: str, outcome: str) -> DataFrame:
    """valid_n, excluded_count and the number of dates of a date series."""
    usable = F.col("instant").isNotNull() & F.col("value").isNotNull()
    per_date = _dated(df, date, outcome).select(F.when(usable, F.col("instant")).alias("instant"), usable.alias("ok")).groupBy(
        "instant", "ok"
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_date.agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("valid_n"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("excluded_count"),
        F.count_if("ok").alias("dates"),
    )
