"""Whole reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.compare import PAIRS_SQL
from catalogue.registry import DIRTY_SQL, KINDS, events_dirty, profile_sql, query, rounded, table
from descry import ReportSettings, report


def orders_profile(spark, folder) -> DataFrame:
    """Role, missing, distinct and the finite statistics of every column of the orders."""
    orders = table(spark, folder, "orders")
    results = report(orders, ReportSettings())
    numeric = results["numeric"].select(F.col("variable").alias("label"), "n", "mean", "sd", "median", "min", "max")
    # Both sides have one row per column.
    return results["profile"].join(F.broadcast(numeric), "label", "left").select(
        "column_id", "label", "role", "role_uncertain", "missing", "unique_nonmissing", "n",
        *[rounded(name, 4) for name in ("mean", "sd", "median", "min", "max")],
    )


_ORDER_NUMBERS = " UNION ALL ".join(
    f"""SELECT '{name}' AS label, count(*) AS n, round(avg({name}), 4) AS mean, round(stddev_samp({name}), 4) AS sd,
    round(CAST(quantile_cont(CAST({name} AS DOUBLE), 0.5) AS DOUBLE), 4) AS median, CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max FROM orders"""
    for name in ("o_orderkey", "o_custkey", "o_totalprice"))


@query("report_profile", f"""WITH p AS ({profile_sql('orders', KINDS['orders'])}), s AS ({_ORDER_NUMBERS})
SELECT column_id, p.label, role, role_uncertain, missing, unique_nonmissing, n, mean, sd, median, min, max FROM p LEFT JOIN s ON p.label = s.label AND role = 'numeric'""")
def report_profile(spark, folder):
    return orders_profile(spark, folder)


@query("report_group", f"""{DIRTY_SQL}, g AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'passive' ELSE 'active' END AS g, fv, event_id FROM finite WHERE event_type IS NOT NULL),
s AS (SELECT g, count(fv) AS n, avg(fv) AS m, var_samp(fv) AS v, min(event_id) FILTER (WHERE fv IS NOT NULL) AS o FROM g GROUP BY g), r AS (SELECT *, row_number() OVER (ORDER BY o) AS k FROM s),
e AS (SELECT max(m) FILTER (WHERE k = 1) - max(m) FILTER (WHERE k = 2) AS d, sqrt(sum((n - 1) * v) / (sum(n) - 2)) AS p,
  max(g) FILTER (WHERE k = 1) || ' minus ' || max(g) FILTER (WHERE k = 2) AS direction, CAST(sum(n) AS BIGINT) AS denominator FROM r)
SELECT 'group_difference_1' AS id, direction, denominator, round(d, 6) AS mean_difference, round(d / p, 6) AS cohens_d FROM e""")
def report_group(spark, folder):
    """The group report of the dirty events with two kinds of events, down to its fact."""
    events = events_dirty(spark, folder).withColumn(
        "kind", F.when(F.col("event_type").isin("click", "view"), "passive").when(F.col("event_type").isNotNull(), "active")
    )
    settings = ReportSettings(
        report_type="group", outcome="value", group="kind", independent_groups=True, order_by=["event_id"],
    )
    facts = report(events, settings)["facts"].where("kind = 'group_difference'")
    return facts.select(
        "id", "direction", "denominator", F.round(F.col("values")["mean_difference"], 6).alias("mean_difference"),
        F.round(F.col("values")["cohens_d"], 6).alias("cohens_d"),
    )


@query("report_change", f"""WITH {PAIRS_SQL} SELECT 'change_1' AS id, count(*) AS denominator, round(avg(post - pre), 4) AS mean,
  round(stddev_samp(post - pre), 4) AS sd, round(quantile_cont(post - pre, 0.5), 4) AS median FROM pairs""")
def report_change(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr("l_extendedprice AS pre", "l_extendedprice * (1 - l_discount) AS post")
    settings = ReportSettings(report_type="change", pre="pre", post="post", paired_confirmed=True)
    values = F.col("values")
    return report(lines, settings)["facts"].where("kind = 'paired_change'").select(
        "id", "denominator", *[F.round(values[name], 4).alias(name) for name in ("mean", "sd", "median")]
    )
