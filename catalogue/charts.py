"""Chart-data queries."""

from pyspark.sql import functions as F

from catalogue.registry import DIRTY_SQL, KINDS, dirty_profile_sql, events_dirty, profile_sql, query, rounded, table
from descry.operators import charts, profile


@query("chart_histogram", f"""{DIRTY_SQL}, b AS (SELECT count(fv) AS n, min(fv) AS lo, max(fv) AS hi,
  least(20, greatest(5, CAST(floor(sqrt(count(fv))) AS BIGINT))) AS k FROM finite),
placed AS (SELECT least(k - 1, CAST(floor((fv - lo) / (hi - lo) * k) AS BIGINT)) AS bin, count(*) AS c FROM finite, b WHERE fv IS NOT NULL GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, round(lo + r.bin * ((hi - lo) / k), 6) AS lower, round(CASE WHEN r.bin + 1 = k THEN hi ELSE lo + (r.bin + 1) * ((hi - lo) / k) END, 6) AS upper,
  coalesce(c, 0) AS count FROM b, (SELECT CAST(unnest(range(20)) AS BIGINT) AS bin) r LEFT JOIN placed p ON p.bin = r.bin WHERE r.bin < k""")
def chart_histogram(spark, folder):
    found = charts.histogram(events_dirty(spark, folder), "value")
    return found.withColumns({"lower": rounded("lower"), "upper": rounded("upper")})


@query("chart_box", """WITH q AS (SELECT o_orderstatus AS g, count(*) AS n, min(o_orderkey) AS first_seen, quantile_cont(o_totalprice, 0.25) AS q1,
  quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT g AS "group", max(n) AS n, max(first_seen) AS first_seen, round(max(q1), 4) AS q1, round(max(q2), 4) AS median, round(max(q3), 4) AS q3,
  least(min(o_totalprice) FILTER (WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), max(q1)) AS whisker_low,
  greatest(max(o_totalprice) FILTER (WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), max(q3)) AS whisker_high,
  count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers
FROM orders JOIN q ON o_orderstatus = g GROUP BY g""")
def chart_box(spark, folder):
    found = charts.box_data(table(spark, folder, "orders"), "o_totalprice", "o_orderstatus", order_by=["o_orderkey"])
    return found.withColumns({name: rounded(name, 4) for name in ("q1", "median", "q3")} | {"first_seen": F.col("first_seen.o0")})


@query("chart_box_many_groups", """WITH q AS (SELECT user_id AS g, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT CAST(g AS VARCHAR) AS "group", n, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3 FROM q""")
def chart_box_many_groups(spark, folder):
    """One box per user: far more groups than a chart shows, all of them in the result."""
    found = charts.box_data(table(spark, folder, "events"), "value", "user_id", order_by=["event_id"], max_groups=1 << 30)
    return found.select("group", "n", *[rounded(name, 4) for name in ("q1", "median", "q3")])


@query("chart_box_outliers", f"""{DIRTY_SQL}, q AS (SELECT event_type AS g, quantile_cont(fv, 0.25) AS q1, quantile_cont(fv, 0.75) AS q3
  FROM finite WHERE event_type IS NOT NULL GROUP BY 1)
SELECT g AS "group", fv AS value FROM finite JOIN q ON event_type = g WHERE fv < q1 - 1.5 * (q3 - q1) OR fv > q3 + 1.5 * (q3 - q1)""")
def chart_box_outliers(spark, folder):
    return charts.box_outliers(events_dirty(spark, folder), "value", "event_type")


@query("scatter_sample", f"""{DIRTY_SQL} SELECT fv AS x, fp AS y FROM (SELECT event_id, fv, CASE WHEN isfinite(post_value) THEN post_value END AS fp FROM finite)
WHERE fv IS NOT NULL AND fp IS NOT NULL ORDER BY md5('{charts.SCATTER_SEED}|' || event_id), event_id LIMIT {charts.SCATTER_POINTS}""")
def scatter_sample(spark, folder):
    return charts.scatter_sample(events_dirty(spark, folder), "value", "post_value", ["event_id"], portable=True)


@query("chart_missingness", f"""{dirty_profile_sql()} SELECT column_id, label, round(missing / CAST(missing + nonmissing AS DOUBLE) * 100, 6) AS missing_percent
FROM profiled WHERE missing > 0 ORDER BY position LIMIT 30""")
def chart_missingness(spark, folder):
    found = charts.missingness_chart(profile.profile(events_dirty(spark, folder)))
    return found.withColumn("missing_percent", rounded("missing_percent"))


_SELECTION = """candidates AS (
  SELECT 1 AS stage, 0 AS position, 'chart_missingness' AS chart_id, 'missingness' AS kind, max(missing + nonmissing) AS valid_n, false AS later
  FROM profiled HAVING sum(missing) > 0
  UNION ALL SELECT 2, position, CASE WHEN role = 'numeric' THEN 'chart_hist_' ELSE 'chart_bar_' END || column_id,
    CASE WHEN role = 'numeric' THEN 'histogram' ELSE 'bar' END, CASE WHEN role = 'numeric' THEN nonmissing - nonfinite ELSE nonmissing END,
    {later} FROM profiled WHERE role = 'numeric' OR (role IN ('categorical', 'ordinal') AND unique_nonmissing <= 20))
SELECT CAST(row_number() OVER (ORDER BY stage, later, position) AS INTEGER) AS rank, chart_id, kind, CAST(valid_n AS BIGINT) AS valid_n,
  row_number() OVER (ORDER BY stage, later, position) <= {budget} AS selected FROM candidates"""


@query("chart_selection", f"{dirty_profile_sql()}, {_SELECTION.format(later='false', budget=3)}")
def chart_selection(spark, folder):
    found = charts.select_charts(profile.profile(events_dirty(spark, folder)), depth="brief")
    return found.select("rank", "chart_id", "kind", "valid_n", "selected")


@query("chart_selection_preferred", f"WITH profiled AS ({profile_sql('lineitem', KINDS['lineitem'])}), "
       + _SELECTION.format(later="role = 'numeric'", budget=5))
def chart_selection_preferred(spark, folder):
    found = charts.select_charts(profile.profile(table(spark, folder, "lineitem")), preferred_kind="bar")
    return found.select("rank", "chart_id", "kind", "valid_n", "selected")
