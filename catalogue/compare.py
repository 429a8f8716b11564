"""Group, pair and date queries."""

from pyspark.sql import functions as F

from catalogue.registry import DIRTY_SQL, events_dirty, query, rounded, table
from descry.operators import compare
from descry.plans.sinks import materialized
from descry.session import scratch_path
from descry.sources.delimited import strict_scan

PAIRS_SQL = "pairs AS (SELECT l_extendedprice AS pre, l_extendedprice * (1 - l_discount) AS post FROM lineitem)"


def priced_lines(spark, folder):
    """Line items with the discounted price as a second measurement."""
    return table(spark, folder, "lineitem").selectExpr("l_extendedprice AS pre", "l_extendedprice * (1 - l_discount) AS post")


@query("group_statistics", f"""{DIRTY_SQL} SELECT event_type AS "group", count(*) AS N, round(avg(post_value), 6) AS mean,
  round(stddev_samp(post_value), 6) AS std, min(post_value) AS min, max(post_value) AS max, min(event_id) AS first_seen
FROM dirty WHERE event_type IS NOT NULL AND post_value IS NOT NULL GROUP BY event_type""")
def group_statistics(spark, folder):
    found = compare.group_statistics(events_dirty(spark, folder), "post_value", "event_type", order_by=["event_id"])
    return found.withColumns({"mean": rounded("mean"), "std": rounded("std"), "first_seen": F.col("first_seen.o0")})


def _detailed(group: str, label: str, source: str = "finite") -> str:
    return f"""SELECT {label} AS "group", count(fv) AS n, round(avg(fv), 6) AS mean, round(stddev_samp(fv), 6) AS sd,
  round(quantile_cont(fv, 0.5), 6) AS median, min(fv) AS min, max(fv) AS max, min(event_id) AS first_seen
FROM {source} WHERE {group} IS NOT NULL GROUP BY {group}"""


def _rounded_groups(found):
    return found.withColumns({
        "mean": rounded("mean"), "sd": rounded("sd"), "median": rounded("median"), "first_seen": F.col("first_seen.o0"),
    })


@query("group_statistics_detailed", f"{DIRTY_SQL} {_detailed('event_type', 'event_type')}")
def group_statistics_detailed(spark, folder):
    return _rounded_groups(
        compare.group_statistics_detailed(events_dirty(spark, folder), "value", "event_type", order_by=["event_id"])
    )


@query("group_statistics_many_groups", f"{DIRTY_SQL} {_detailed('user_id', 'CAST(user_id AS VARCHAR)')}")
def group_statistics_many_groups(spark, folder):
    """The same without any bound on the number of groups."""
    return _rounded_groups(
        compare.group_statistics_detailed(events_dirty(spark, folder), "value", "user_id", order_by=["event_id"], few_groups=False)
    )


_HOT = "CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END"


@query("group_statistics_hot_group", f"""{DIRTY_SQL}, hot AS (SELECT {_HOT} AS g, event_id, 1.7e9 + event_id * 0.5 AS fv FROM dirty)
SELECT * REPLACE (round(mean, 3) AS mean, round(sd, 3) AS sd) FROM ({_detailed('g', 'CAST(g AS VARCHAR)', 'hot')})""")
def group_statistics_hot_group(spark, folder):
    """Many groups, one with a third of the rows, and values that are close to each other relative to their size."""
    events = events_dirty(spark, folder).selectExpr(f"{_HOT} AS g", "event_id", "1.7e9D + event_id * 0.5D AS value")
    found = _rounded_groups(compare.group_statistics_detailed(events, "value", "g", order_by=["event_id"], few_groups=False))
    # Sums of such large values differ between engines in their last bits.
    return found.withColumns({"mean": rounded("mean", 3), "sd": rounded("sd", 3)})


@query("group_coverage", f"""{DIRTY_SQL} SELECT count(*) FILTER (WHERE event_type IS NOT NULL AND fv IS NOT NULL) AS valid_n,
  count(*) FILTER (WHERE event_type IS NULL OR fv IS NULL) AS excluded_count FROM finite""")
def group_coverage(spark, folder):
    return compare.group_coverage(events_dirty(spark, folder), "value", "event_type")


@query("cohens_d", """WITH g AS (SELECT l_linestatus AS label, count(l_quantity) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v,
  min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY l_linestatus),
r AS (SELECT *, row_number() OVER (ORDER BY o, label) AS rn FROM g),
p AS (SELECT max(label) FILTER (WHERE rn = 1) AS group_1, max(label) FILTER (WHERE rn = 2) AS group_2, max(n) FILTER (WHERE rn = 1) AS n_1,
  max(n) FILTER (WHERE rn = 2) AS n_2, max(m) FILTER (WHERE rn = 1) - max(m) FILTER (WHERE rn = 2) AS d,
  sqrt(sum((n - 1) * v) / (sum(n) - 2)) AS s FROM r)
SELECT group_1, group_2, n_1, n_2, round(d, 6) AS mean_difference, round(d / s, 6) AS cohens_d, CAST(NULL AS VARCHAR) AS reason FROM p""")
def cohens_d(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr("l_quantity", "l_linestatus", "l_orderkey * 10 + l_linenumber AS place")
    found = compare.cohens_d(lines, "l_quantity", "l_linestatus", order_by=["place"])
    return found.withColumns({"mean_difference": rounded("mean_difference"), "cohens_d": rounded("cohens_d")})


#: The place of a row in its file: DuckDB reads a file's rows in order.
_IN_FILE = "SELECT *, row_number() OVER () - 1 AS place FROM lineitem"


@query("cohens_d_file_order", f"""WITH l AS ({_IN_FILE}), g AS (SELECT l_linestatus AS label, count(l_quantity) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v,
  min(place) AS o FROM l GROUP BY l_linestatus),
r AS (SELECT *, row_number() OVER (ORDER BY o) AS rn FROM g),
p AS (SELECT max(label) FILTER (WHERE rn = 1) AS group_1, max(label) FILTER (WHERE rn = 2) AS group_2, max(n) FILTER (WHERE rn = 1) AS n_1,
  max(n) FILTER (WHERE rn = 2) AS n_2, max(m) FILTER (WHERE rn = 1) - max(m) FILTER (WHERE rn = 2) AS d,
  sqrt(sum((n - 1) * v) / (sum(n) - 2)) AS s FROM r)
SELECT group_1, group_2, n_1, n_2, round(d, 6) AS mean_difference, round(d / s, 6) AS cohens_d, CAST(NULL AS VARCHAR) AS reason FROM p""")
def cohens_d_file_order(spark, folder):
    """The first group is the one that the file shows first; no order column is named. Moments come from exact sums."""
    found = compare.cohens_d(table(spark, folder, "lineitem").repartition(5), "l_quantity", "l_linestatus", reproducible=True)
    return found.withColumns({"mean_difference": rounded("mean_difference"), "cohens_d": rounded("cohens_d")})


@query("group_statistics_file_order", f"""WITH l AS ({_IN_FILE}) SELECT l_returnflag AS "group", count(l_tax) AS "N", round(avg(l_tax), 6) AS mean,
  round(stddev_samp(l_tax), 6) AS std, min(l_tax) AS min, max(l_tax) AS max, min(place) AS first_seen FROM l GROUP BY l_returnflag""")
def group_statistics_file_order(spark, folder):
    found = compare.group_statistics(table(spark, folder, "lineitem"), "l_tax", "l_returnflag", reproducible=True)
    return found.withColumns({"mean": rounded("mean"), "std": rounded("std"), "first_seen": F.col("first_seen.row")})


@query("group_statistics_csv_order", f"""WITH l AS ({_IN_FILE}), d AS (SELECT l_shipdate::DATE::VARCHAR AS day, min(place) AS place, count(*) AS n FROM l GROUP BY 1)
SELECT day, CAST(rank() OVER (ORDER BY place) AS INTEGER) AS seen, n FROM d QUALIFY seen <= 50""")
def group_statistics_csv_order(spark, folder):
    """The first fifty days that the lines of CSV files show, read in small splits: the report's order of groups."""
    path = scratch_path(spark, "ordered")
    days = table(spark, folder, "lineitem").selectExpr("CAST(CAST(l_shipdate AS DATE) AS STRING) AS day", "l_tax")
    days.write.csv(path, header=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = compare.group_statistics(strict_scan(spark, path).typed(), "l_tax", "day")
        found = materialized(found.select("group", "N", "first_seen"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return found.orderBy("first_seen").limit(50).selectExpr("`group` AS day", "rank() OVER (ORDER BY first_seen) AS seen", "N AS n")


@query("reproducible_group_statistics", f"""{DIRTY_SQL}, g AS (SELECT event_type, fv, event_id FROM finite WHERE event_type IS NOT NULL)
SELECT event_type AS "group", count(fv) AS n, round(fsum(fv) / count(fv), 6) AS mean, round(stddev_samp(fv), 6) AS sd, 1 AS variants FROM g GROUP BY event_type""")
def reproducible_group_statistics(spark, folder):
    """Mean and sd of each group under three partitionings: how many different pairs of doubles come out."""
    events = events_dirty(spark, folder)
    parts = [events, events.repartition(7, "event_id"), events.repartition(29)]
    found = [compare.group_statistics_detailed(part, "value", "event_type", order_by=["event_id"], reproducible=True).select("group", "n", "mean", "sd") for part in parts]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("group").agg(
        F.max("n").alias("n"), F.round(F.max("mean"), 6).alias("mean"), F.round(F.max("sd"), 6).alias("sd"), F.count_distinct("mean", "sd").cast("int").alias("variants"))


@query("reproducible_pearson", f"""{DIRTY_SQL}, p AS (SELECT fv AS x, post_value AS y FROM finite WHERE fv IS NOT NULL AND post_value IS NOT NULL)
SELECT 'value' AS first, 'post_value' AS second, count(*) AS n, (SELECT count(*) FROM dirty) - count(*) AS excluded_count,
  round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) AS r, CAST(NULL AS VARCHAR) AS reason FROM p""")
def reproducible_pearson(spark, folder):
    return compare.pearson_relationship(events_dirty(spark, folder), "value", "post_value", reproducible=True).withColumn("r", rounded("r"))


@query("cohens_d_undefined", """SELECT CAST(NULL AS VARCHAR) AS group_1, CAST(NULL AS VARCHAR) AS group_2, CAST(NULL AS BIGINT) AS n_1,
  CAST(NULL AS BIGINT) AS n_2, CAST(NULL AS DOUBLE) AS mean_difference, CAST(NULL AS DOUBLE) AS cohens_d,
  CASE WHEN count(DISTINCT o_orderstatus) <> 2 THEN 'not_two_groups' ELSE 'unexpected' END AS reason FROM orders""")
def cohens_d_undefined(spark, folder):
    return compare.cohens_d(table(spark, folder, "orders"), "o_totalprice", "o_orderstatus", order_by=["o_orderkey"])


@query("pearson_relationship", f"""{DIRTY_SQL}, p AS (SELECT fv AS x, post_value AS y FROM finite WHERE fv IS NOT NULL AND post_value IS NOT NULL)
SELECT 'value' AS first, 'post_value' AS second, count(*) AS n, (SELECT count(*) FROM dirty) - count(*) AS excluded_count,
  round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) AS r, CAST(NULL AS VARCHAR) AS reason FROM p""")
def pearson_relationship(spark, folder):
    return compare.pearson_relationship(events_dirty(spark, folder), "value", "post_value").withColumn("r", rounded("r"))


@query("pearson_zero_variance", """SELECT 'o_totalprice' AS first, 'flat' AS second, count(*) AS n, CAST(0 AS BIGINT) AS excluded_count,
  CAST(NULL AS DOUBLE) AS r, CASE WHEN count(*) < 3 THEN 'fewer_than_three_pairs' ELSE 'zero_variance' END AS reason FROM orders""")
def pearson_zero_variance(spark, folder):
    flat = table(spark, folder, "orders").withColumn("flat", F.lit(3.5))
    return compare.pearson_relationship(flat, "o_totalprice", "flat")


def _change(measure: str, value: str) -> str:
    return f"""SELECT '{measure}' AS measure, count(*) AS n, round(avg({value}), 4) AS mean, round(stddev_samp({value}), 4) AS sd,
  round(quantile_cont({value}, 0.5), 4) AS median, CAST(0 AS BIGINT) AS excluded_count, 'post_minus_pre' AS direction FROM pairs"""


@query("paired_change", f"WITH {PAIRS_SQL} {_change('pre', 'pre')} UNION ALL {_change('post', 'post')} UNION ALL {_change('change', 'post - pre')}")
def paired_change(spark, folder):
    found = compare.paired_change_statistics(priced_lines(spark, folder), "pre", "post")
    return found.withColumns({name: rounded(name, 4) for name in ("mean", "sd", "median")})


@query("reproducible_paired_change", f"WITH {PAIRS_SQL} {_change('pre', 'pre')} UNION ALL {_change('post', 'post')} UNION ALL {_change('change', 'post - pre')}")
def reproducible_paired_change(spark, folder):
    found = compare.paired_change_statistics(priced_lines(spark, folder), "pre", "post", reproducible=True)
    return found.withColumns({name: rounded(name, 4) for name in ("mean", "sd", "median")})


@query("paired_change_incomplete", f"""{DIRTY_SQL}, p AS (SELECT fv AS pre, post_value AS post FROM finite WHERE fv IS NOT NULL AND post_value IS NOT NULL)
""" + " UNION ALL ".join(
    f"""SELECT '{name}' AS measure, count(*) AS n, round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS sd,
    round(quantile_cont({value}, 0.5), 6) AS median, (SELECT count(*) FROM dirty) - count(*) AS excluded_count, 'post_minus_pre' AS direction FROM p"""
    for name, value in [("pre", "pre"), ("post", "post"), ("change", "post - pre")]))
def paired_change_incomplete(spark, folder):
    found = compare.paired_change_statistics(events_dirty(spark, folder), "value", "post_value")
    return found.withColumns({name: rounded(name) for name in ("mean", "sd", "median")})


@query("date_mean_series", """SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date, round(avg(o_totalprice), 6) AS mean, count(*) AS count
FROM orders GROUP BY o_orderdate""")
def date_mean_series(spark, folder):
    return compare.date_mean_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice").withColumn("mean", rounded("mean"))


@query("date_mean_series_text", """WITH t AS (SELECT o_orderdate AS d, o_totalprice AS y FROM orders WHERE o_orderkey % 31 <> 0)
SELECT strftime(d, '%Y-%m-%dT%H:%M:%S') AS date, round(avg(y), 6) AS mean, count(*) AS count FROM t GROUP BY d""")
def date_mean_series_text(spark, folder):
    """Dates as text in two spellings, some of them no dates."""
    texts = table(spark, folder, "orders").selectExpr(
        "o_totalprice", "CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy/M/d') "
        "ELSE date_format(o_orderdate, ' yyyy-MM-dd ') END AS ordered"
    )
    return compare.date_mean_series(texts, "ordered", "o_totalprice").withColumn("mean", rounded("mean"))


@query("date_series_coverage", f"""{DIRTY_SQL} SELECT count(fv) AS valid_n, count(*) - count(fv) AS excluded_count,
  count(DISTINCT ts) FILTER (WHERE fv IS NOT NULL) AS dates FROM finite""")
def date_series_coverage(spark, folder):
    return compare.date_series_coverage(events_dirty(spark, folder), "ts", "value")
