"""Descriptive queries."""

from pyspark.sql import functions as F

from catalogue.registry import DIRTY_SQL, KINDS, events_dirty, query, rounded, statistic_sql, table
from descry.functions.formatting import count_text, percent_text, statistic_text
from descry.operators import describe
from descry.plans import report

LINE_NUMBERS = [name for name, kind in KINDS["lineitem"].items() if kind in ("whole", "real")]


def _statistics(df, digits=4):
    return df.withColumns({name: rounded(name, digits) for name in ("mean", "sd", "median", "min", "max")})


@query("descriptive_statistics", " UNION ALL ".join(
    f"""SELECT '{name}' AS variable, count({name}) AS N, round(avg({name}), 4) AS mean, round(stddev_samp({name}), 4) AS std,
    CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max FROM lineitem""" for name in LINE_NUMBERS))
def descriptive_statistics(spark, folder):
    found = describe.descriptive_statistics(table(spark, folder, "lineitem"))
    return found.withColumns({"mean": rounded("mean", 4), "std": rounded("std", 4)})


_SUMMARY = """'{name}' AS variable, count({v}) AS n, count(*) FILTER (WHERE {gap}) AS missing_count, {inf} AS nonfinite_count,
 round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS sd, round(CAST(quantile_cont({v}, 0.5) AS DOUBLE), 4) AS median,
 round(CAST(min({v}) AS DOUBLE), 4) AS min, round(CAST(max({v}) AS DOUBLE), 4) AS max"""
_VALUE = "SELECT " + _SUMMARY.format(
    name="value", v="fv", gap="value IS NULL OR isnan(value)", inf="count(*) FILTER (WHERE isinf(value))"
) + " FROM finite"


@query("numeric_summary", f"{DIRTY_SQL} {_VALUE}")
def numeric_summary(spark, folder):
    return _statistics(describe.numeric_summary(events_dirty(spark, folder), "value"))


_LINES = [
    f"SELECT {i} AS position, " + _SUMMARY.format(name=name, v=f"CAST({name} AS DOUBLE)", gap=f"{name} IS NULL", inf="CAST(0 AS BIGINT)")
    + " FROM lineitem" for i, name in enumerate(LINE_NUMBERS)
]


@query("profile_numeric_all", " UNION ALL ".join(_LINES))
def profile_numeric_all(spark, folder):
    """Exact medians of all columns by narrowing ranks, all columns in the same passes."""
    return _statistics(describe.numeric_profile(table(spark, folder, "lineitem")))


_FREQUENCIES = """counts AS (SELECT {position} AS position, '{name}' AS variable, CAST({name} AS VARCHAR) AS label, count(*) AS n
  FROM {source} WHERE {name} IS NOT NULL GROUP BY {name})"""


def frequency_sql(parts: list[tuple[str, str]], prefix: str = "WITH ") -> str:
    """CTEs up to ``shown``: the displayed frequencies of (source, column) pairs."""
    counts = " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS variable, CAST({name} AS VARCHAR) AS label, count(*) AS n FROM {source} WHERE {name} IS NOT NULL GROUP BY {name}"
        for i, (source, name) in enumerate(parts)
    )
    gaps = " UNION ALL ".join(
        f"SELECT {i} AS position, count(*) FILTER (WHERE {name} IS NULL) AS missing_count FROM {source}"
        for i, (source, name) in enumerate(parts)
    )
    return f"""{prefix}counts AS ({counts}), gaps AS ({gaps}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, label) AS rn, sum(n) OVER (PARTITION BY position) AS valid,
      count(*) OVER (PARTITION BY position) AS k FROM counts),
    shown AS (SELECT p.position, p.variable, CAST(least(CASE WHEN k > 20 AND rn >= 20 THEN 20 ELSE rn END, 20) AS INTEGER) AS rank,
      CASE WHEN k > 20 AND rn >= 20 THEN 'Other' ELSE label END AS label, k > 20 AND rn >= 20 AS is_remainder,
      CAST(sum(n) AS BIGINT) AS count, round(sum(n) / CAST(max(valid) AS DOUBLE) * 100, 6) AS percent,
      CAST(max(valid) AS BIGINT) AS valid_n, max(missing_count) AS missing_count, bool_or(k > 20) AS aggregated
      FROM placed p JOIN gaps g ON p.position = g.position GROUP BY 1, 2, 3, 4, 5)"""


def _percent(df):
    return df.withColumn("percent", rounded("percent"))


@query("categorical_summary", f"{frequency_sql([('dirty', 'event_type')], DIRTY_SQL + ', ')} SELECT * EXCLUDE (position) FROM shown")
def categorical_summary(spark, folder):
    return _percent(describe.categorical_summary(events_dirty(spark, folder), "event_type"))


@query("categorical_top_other", f"{frequency_sql([('part', 'p_brand')])} SELECT * EXCLUDE (position) FROM shown")
def categorical_top_other(spark, folder):
    return _percent(describe.categorical_summary(table(spark, folder, "part"), "p_brand"))


@query("categorical_many_labels", f"{frequency_sql([('lineitem', 'l_partkey')])} SELECT * EXCLUDE (position) FROM shown")
def categorical_many_labels(spark, folder):
    """A column with as many labels as the parts table has rows."""
    return _percent(describe.categorical_summary(table(spark, folder, "lineitem"), "l_partkey"))


@query("profile_categorical_all", frequency_sql([("lineitem", n) for n in ("l_linenumber", "l_returnflag", "l_linestatus")]) + " SELECT * FROM shown")
def profile_categorical_all(spark, folder):
    return _percent(describe.categorical_profile(table(spark, folder, "lineitem"), ["l_linenumber", "l_returnflag", "l_linestatus"]))


@query("categorical_tables_limited", frequency_sql([("part", n) for n in ("p_name", "p_brand", "p_type")]) + """
SELECT 'categorical_' || (position + 1) AS table_id, variable, rank AS row_no, CASE WHEN is_remainder THEN 'Muut' ELSE label END AS category,
  CAST(count AS VARCHAR) AS count, printf('%.1f', count / CAST(valid_n AS DOUBLE) * 100) AS percent FROM shown WHERE position < 2""")
def categorical_tables_limited(spark, folder):
    found = describe.categorical_profile(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])
    return report.categorical_tables(found, "fi", tables=2)


@query("numeric_table", DIRTY_SQL + ", s AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{label}' AS variable, count({v}) AS n, avg({v}) AS mean, stddev_samp({v}) AS sd, quantile_cont({v}, 0.5) AS median, min({v}) AS mn, max({v}) AS mx FROM finite"
    for i, (label, v) in enumerate([("value (points)", "fv"), ("post_value", "post_value")])) + f""")
SELECT position, variable, CAST(n AS VARCHAR) AS valid_n, {statistic_sql('mean')} AS mean, {statistic_sql('sd')} AS sd, {statistic_sql('median')} AS median,
  {statistic_sql('mn')} AS minimum, {statistic_sql('mx')} AS maximum FROM s""")
def numeric_table(spark, folder):
    found = describe.numeric_profile(events_dirty(spark, folder), ["value", "post_value"])
    return report.numeric_table(found, {"value": "points"})


@query("format_numbers", f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_totalprice / 1e8
  WHEN o_orderkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE -o_totalprice / 8 END AS x FROM orders)
SELECT o_orderkey, {statistic_sql('x')} AS statistic, printf('%.1f', x) AS percent, CAST(o_orderkey AS VARCHAR) AS count FROM t""")
def format_numbers(spark, folder):
    numbers = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_totalprice / 1e8D "
        "WHEN o_orderkey % 5 = 0 THEN 0D ELSE -o_totalprice / 8D END AS x"
    )
    return numbers.select(
        "o_orderkey", statistic_text("x").alias("statistic"), percent_text("x").alias("percent"), count_text("o_orderkey").alias("count")
    )


@query("table_chunks", """WITH c AS (SELECT p_name AS label, count(*) AS n FROM part GROUP BY p_name), r AS (
  SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS row_no FROM c)
SELECT CAST(row_no AS INTEGER) AS row_no, label, n AS count, CAST(floor((row_no - 1) / CAST(5 AS DOUBLE)) + 1 AS INTEGER) AS part FROM r""")
def table_chunks(spark, folder):
    """A frequency table in printed parts (5 rows each here, so that there are several)."""
    found = describe.categorical_summary(table(spark, folder, "part"), "p_name", max_categories=None)
    return report.with_parts(found.select(F.col("rank").alias("row_no"), "label", "count"), rows=5)
