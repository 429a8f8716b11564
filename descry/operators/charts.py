"""The data behind charts, and the choice of charts. Nothing is drawn here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descry import wording
from descry.errors import AnalysisError
from descry.functions import predicates as P
from descry.functions import sqltext as Q
from descry.functions.wide import literal_table
from descry.operators.compare import FEW_GROUPS, _first_seen, _order_key, require_group_count
from descry.operators.quantiles import exact_quantiles

# Sizes of the displays and the seed of the scatter sample.
SCATTER_POINTS = 5_000
SCATTER_SEED = 20261001
MISSINGNESS_BARS = 30
MAX_BAR_CATEGORIES = 20
CHART_KINDS = ("histogram", "bar", "missingness", "box", "scatter", "date_line", "paired")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins over the finite values, the last one closed: bin, lower, upper, count.

    The number of bins is the square root of n, kept between 5 and 20. A first job brings back one row (n, minimum,
    maximum); the second pass counts by bin in every task. Constant data get the range value +/- 0.5.
    """
    P.require_numeric(df, column)
    values = df.select(P.finite(P.ref(column)).alias("x")).where("x IS NOT NULL")
    found = values.selectExpr("count(1) AS n", "min(x) AS low", "max(x) AS high").head()
    bins = min(20, max(5, isqrt(max(1, found["n"]))))
    low, high = (0.0, 1.0) if found["n"] == 0 else (found["low"], found["high"])
    if low == high:
        low, high = low - 0.5, high + 0.5
    edges = [low + i * ((high - low) / bins) for i in range(bins)] + [high]
    # Rounding may put a value next to its bin; the stated edges decide.
    known = "array(" + ", ".join(f"{edge!r}D" for edge in edges) + ")"
    guess = f"CAST(least({bins - 1}, floor((x - {low!r}D) / {high - low!r}D * {bins}D)) AS INT)"
    settled = f"guess + CASE WHEN x < {known}[guess] THEN -1 WHEN x >= {known}[guess + 1] AND guess < {bins - 1} THEN 1 ELSE 0 END"
    counts = values.selectExpr("x", f"{guess} AS guess").groupBy(F.expr(settled).alias("bin")).agg(F.expr("count(1) AS count"))
    # At most 20 rows on either side.
    every = literal_table(
        df.sparkSession, [{"bin": i, "lower": edges[i], "upper": edges[i + 1]} for i in range(bins)], "bin int, lower double, upper double"
    )
    return every.join(F.broadcast(counts), "bin", "left").selectExpr("bin", "lower", "upper", "coalesce(count, 0L) AS count")


def _box_parts(df: DataFrame, outcome: str, group: str, order_by: Sequence[str] | None, max_groups: int) -> tuple[DataFrame, DataFrame]:
    """Rows (group, value) and one row per group with quartiles and fences; more than ``max_groups`` groups are refused."""
    P.require_distinct(outcome, group)
    P.require_numeric(df, outcome)
    count = require_group_count(df, group, low=1, high=max_groups)
    group_type = P.type_of(df, group)
    rows = df.where(P.present(P.ref(group), group_type)).select(
        P.label_text(P.ref(group), group_type).alias("group"),
        P.finite(P.ref(outcome)).alias("value"),
        _order_key(df, order_by).alias("_order"),
    )
    groups = rows.groupBy("group").agg(F.count("value").alias("n"), _first_seen(order_by))
    quartiles = exact_quantiles(rows, ["group"], "value", [0.25, 0.5, 0.75], few_keys=count <= FEW_GROUPS)
    reach = F.lit(1.5) * (F.col("q2") - F.col("q0"))
    few = count <= FEW_GROUPS  # else Spark decides by size
    fences = groups.join(F.broadcast(quartiles) if few else quartiles, "group", "left").select(
        "group", "n", "first_seen", "q0", "q1", "q2",
        (F.col("q0") - reach).alias("low_fence"), (F.col("q2") + reach).alias("high_fence"),
    )
    return rows.select("group", "value"), fences


def box_data(
    df: DataFrame, outcome: str, group: str, *, order_by: Sequence[str] | None = None, max_groups: int = 20
) -> DataFrame:
    """Quartiles, whiskers at the most extreme values within 1.5 IQR, and the number of outliers per group."""
    rows, fences = _box_parts(df, outcome, group, order_by, max_groups)
    value = F.col("value")
    inside = F.when(value.between(F.col("low_fence"), F.col("high_fence")), value)
    marked = rows.join(fences, "group")
    return (
        marked.groupBy("group", "n", "first_seen", "q0", "q1", "q2", "low_fence", "high_fence")
        .agg(
            F.min(inside).alias("_low"), F.max(inside).alias("_high"),
            F.count_if((value < F.col("low_fence")) | (value > F.col("high_fence"))).alias("outliers"),
        )
        .select(
            "group", "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
            F.least(F.col("_low"), F.col("q0")).alias("whisker_low"),
            F.greatest(F.col("_high"), F.col("q2")).alias("whisker_high"),
            "outliers", "first_seen",
        )
    )


def box_outliers(df: DataFrame, outcome: str, group: str, *, max_groups: int = 20) -> DataFrame:
    """The values outside the fences, one row each."""
    rows, fences = _box_parts(df, outcome, group, None, max_groups)
    marked = rows.join(fences.select("group", "low_fence", "high_fence"), "group")
    return marked.where((F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence"))).select("group", "value")


def scatter_sample(
    df: DataFrame, first: str, second: str, key: Sequence[str], *, points: int = SCATTER_POINTS, seed: int = SCATTER_SEED,
    portable: bool = False,
) -> DataFrame:
    """At most ``points`` finite pairs for display, chosen by a seeded hash of ``key`` and the pair; with ``portable`` by the
    MD5 of seed and key, which other engines have too.

    The choice does not depend on partitioning. A first pass counts pairs by the leading 20 bits of the hash, which
    tells the bits that suffice; only those pairs are then ordered, so one task never receives ``points`` rows from
    every other task.
    """
    P.require_distinct(first, second)
    P.require_numeric(df, first, second)
    keys = [f"_k{i}" for i in range(len(key))]
    pairs = df.select(
        *[P.ref(name).alias(alias) for name, alias in zip(key, keys)],
        P.finite(P.ref(first)).alias("x"), P.finite(P.ref(second)).alias("y"),
    ).where("x IS NOT NULL AND y IS NOT NULL")
    if portable:
        parts = ", ".join(f"coalesce(CAST({name} AS STRING), '')" for name in keys)
        hashed, bits = f"md5(CAST(concat_ws('|', '{seed}', {parts}) AS BINARY))", "left(_hash, 5)"  # hex digits compare as text
    else:
        hashed, bits = f"shiftrightunsigned(xxhash64({', '.join([str(seed), *keys, 'x', 'y'])}), 1)", "shiftright(_hash, 43)"
    pairs = pairs.selectExpr("*", f"{hashed} AS _hash").selectExpr("*", f"{bits} AS _bits")
    # At most 2**20 counts meet in the running sum.
    counts = pairs.groupBy("_bits").agg(F.expr("count(1) AS n")).selectExpr("_bits", "sum(n) OVER (ORDER BY _bits) AS upto")
    enough = counts.selectExpr(f"coalesce(min(_bits) FILTER (WHERE upto >= {points}), max(_bits))").scalar()
    return pairs.where(F.col("_bits") <= enough).orderBy("_hash", *keys, "x", "y").limit(points).select("x", "y")


def missingness_chart(profiled: DataFrame, *, bars: int = MISSINGNESS_BARS) -> DataFrame:
    """Missing percentages of the first 30 columns that have missing values."""
    share = P.percent(F.col("missing"), F.col("missing") + F.col("nonmissing"))
    return (
        profiled.where(F.col("missing") > 0)
        .orderBy("position")
        .limit(bars)
        .select("column_id", "label", share.alias("missing_percent"))
    )


def compatible_chart_kinds(profiled: DataFrame) -> DataFrame:
    """Chart kinds the roles allow."""
    return profiled.agg(
        F.array_compact(
            F.array(
                F.lit("missingness"),
                F.when(F.bool_or(F.col("role") == "numeric"), F.lit("histogram")),
                F.when(F.bool_or(F.col("role").isin("categorical", "ordinal")), F.lit("bar")),
            )
        ).alias("kinds")
    ).select(F.explode("kinds").alias("kind"))


def select_charts(
    profiled: DataFrame,
    *,
    depth: str = "standard",
    primary: Mapping[str, object] | None = None,
    preferred_kind: str | None = None,
    language: str = "en",
    units: Mapping[str, str] | None = None,
) -> DataFrame:
    """Ranked chart candidates: the primary chart, missingness, then one chart per column; ``selected`` marks
    those within the budget of the depth (3, 5 or 8).

    ``primary`` has the keys chart_id, kind, variable_ids, labels, valid_n. The profile has one row per column, so
    ranking needs no distribution.
    """
    budget = wording.CHART_BUDGETS.get(depth, wording.CHART_BUDGETS["standard"])
    if preferred_kind is not None and preferred_kind not in CHART_KINDS:
        raise AnalysisError(f"Unknown chart kind '{preferred_kind}'.")
    titles = wording.CHART_TITLES[language]
    shown = Q.display_label("label", units)
    is_bar = f"(role IN ('categorical', 'ordinal') AND unique_nonmissing <= {MAX_BAR_CATEGORIES})"
    later = f"kind <> {Q.quoted(preferred_kind)}" if preferred_kind else "false"
    per_column = profiled.selectExpr(
        "*", f"CASE WHEN role = 'numeric' THEN 'histogram' WHEN {is_bar} THEN 'bar' END AS kind"
    ).where("kind IS NOT NULL").selectExpr(
        "2 AS stage", f"{later} AS later", "position",
        "concat(IF(kind = 'histogram', 'chart_hist_', 'chart_bar_'), column_id) AS chart_id", "kind", "array(column_id) AS variable_ids",
        f"IF(kind = 'histogram', {Q.filled(titles['histogram'], {'a': shown})}, {Q.filled(titles['bar'], {'a': shown})}) AS title",
        f"{shown} AS x_label", f"{Q.quoted(wording.label(language, 'count'))} AS y_label",
        "IF(kind = 'histogram', nonmissing - nonfinite, nonmissing) AS valid_n",
    )
    missing_chart = profiled.selectExpr(
        "sum(missing) AS missing", "max(missing + nonmissing) AS rows", "array_sort(collect_list(struct(position, column_id))) AS ids"
    ).where("missing > 0").selectExpr(
        "1 AS stage", "false AS later", "0 AS position", "'chart_missingness' AS chart_id", "'missingness' AS kind",
        "ids.column_id AS variable_ids", f"{Q.quoted(titles['missingness'])} AS title",
        f"{Q.quoted(wording.label(language, 'missing_pct'))} AS x_label", f"{Q.quoted(wording.label(language, 'variable'))} AS y_label",
        "rows AS valid_n",
    )
    charts = per_column.unionByName(missing_chart)
    if primary:
        first, second = ([*primary["labels"], ""])[:2]
        title = titles[primary["kind"]].format(a=first, b=second)
        chosen = {
            "stage": 0, "later": False, "position": 0, "chart_id": primary["chart_id"], "kind": primary["kind"],
            "variable_ids": list(primary["variable_ids"]), "title": title, "x_label": first, "y_label": second,
            "valid_n": primary["valid_n"],
        }
        schema = (
            "stage int, later boolean, position int, chart_id string, kind string, variable_ids array<string>, title string, "
            "x_label string, y_label string, valid_n bigint"
        )
        charts = charts.unionByName(literal_table(profiled.sparkSession, [chosen], schema))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("stage", "later", "position"))
    return charts.withColumn("rank", rank).select(
        "rank", "chart_id", "kind", "variable_ids", "title", "x_label", "y_label", "valid_n",
        (F.col("rank") <= budget).alias("selected"),
    )
