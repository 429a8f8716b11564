"""Profiling queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import (
    DIRTY_KINDS, DIRTY_SQL, KINDS, dirty_profile_sql, events_dirty, profile_sql, query, rounded, table,
)
from descry.functions.sqltext import display_label
from descry.operators import charts, profile
from descry.plans import incremental
from descry.plans.report import relabel
from descry.session import scratch_path

ROLE_TABLES = ("orders", "events", "part", "documents", "labels", "customer", "conversations", "lineitem")
NUMERIC_DIRTY = ("event_id", "user_id", "value", "post_value")


@query("dataset_summary", f"""{DIRTY_SQL}, dup AS (SELECT CAST(sum(n - 1) AS BIGINT) AS d FROM (
  SELECT count(*) AS n FROM (SELECT event_id, ts, user_id, event_type, post_value, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM dirty)
  GROUP BY event_id, ts, user_id, event_type, value, post_value))
""" + " UNION ALL ".join(
    f"""SELECT (SELECT count(*) FROM dirty) AS rows, 6 AS columns, '{name}' AS variable, '{dtype}' AS data_type,
    (SELECT count(*) FROM dirty WHERE {name} IS NULL{f' OR isnan({name})' if dtype == 'double' else ''}) AS missing_count,
    (SELECT d FROM dup) AS duplicate_rows"""
    for name, dtype in [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
                        ("value", "double"), ("post_value", "double")]
))
def dataset_summary(spark, folder):
    summary = profile.dataset_summary(events_dirty(spark, folder))
    return summary.select(
        "rows", "columns", "duplicate_rows", F.explode("variable_names").alias("variable"), "data_types", "missing_values"
    ).select(
        "rows", "columns", "variable", F.col("data_types")[F.col("variable")].alias("data_type"),
        F.col("missing_values")[F.col("variable")].alias("missing_count"), "duplicate_rows",
    )


@query("duplicate_rows", f"""{DIRTY_SQL}, g AS (SELECT count(*) AS n FROM (
  SELECT event_id, ts, user_id, event_type, post_value, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM dirty)
  GROUP BY event_id, ts, user_id, event_type, value, post_value)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g""")
def duplicate_rows(spark, folder):
    return profile.duplicate_rows(events_dirty(spark, folder))


@query("duplicate_documents", """WITH g AS (SELECT text, lang, source, n_chars, count(*) AS n FROM documents GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g""")
def duplicate_documents(spark, folder):
    """Duplicate rows where one column is long text: whole texts decide."""
    return profile.duplicate_rows(table(spark, folder, "documents").drop("doc_id"))


@query("missingness", DIRTY_SQL + " " + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{name}' AS variable, count(*) FILTER (WHERE {gap}) AS missing_count,
    round(count(*) FILTER (WHERE {gap}) / CAST(count(*) AS DOUBLE) * 100, 6) AS missing_percent FROM dirty"""
    for i, (name, kind) in enumerate(DIRTY_KINDS.items(), 1)
    for gap in [f"{name} IS NULL" + (f" OR isnan({name})" if kind == "real" else "")]
))
def missingness(spark, folder):
    return profile.missingness(events_dirty(spark, folder)).withColumn("missing_percent", rounded("missing_percent"))


@query("column_cardinality", f"""{dirty_profile_sql()}
SELECT column_id, label, nonmissing, unique_nonmissing, missing, CAST(nonfinite AS BIGINT) AS nonfinite FROM profiled""")
def column_cardinality(spark, folder):
    return profile.profile(events_dirty(spark, folder)).select(
        "column_id", "label", "nonmissing", "unique_nonmissing", "missing", "nonfinite"
    )


def _with_constants(spark, folder) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "*", "'one' AS source", "IF(s_suppkey % 3 = 0, NULL, 7) AS seven", "CAST(NULL AS STRING) AS nothing"
    )


_CONSTANTS = f"""WITH s AS (SELECT *, 'one' AS source, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 7 END AS seven,
  CAST(NULL AS VARCHAR) AS nothing FROM supplier), profiled AS ({profile_sql('s', {
    's_suppkey': 'whole', 's_name': 'text', 's_nationkey': 'whole', 's_acctbal': 'real', 'source': 'text', 'seven': 'whole',
    'nothing': 'text'})})"""


@query("constant_columns", f"{_CONSTANTS} SELECT column_id, label, unique_nonmissing FROM profiled WHERE unique_nonmissing <= 1")
def constant_columns(spark, folder):
    return profile.constant_columns(profile.profile(_with_constants(spark, folder)))


@query("identifier_duplicates", f"""{dirty_profile_sql()} SELECT column_id, label, nonmissing, unique_nonmissing FROM profiled
WHERE role = 'identifier' AND unique_nonmissing < nonmissing""")
def identifier_duplicates(spark, folder):
    return profile.identifier_duplicates(profile.profile(events_dirty(spark, folder)))


@query("infer_roles", " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, column_id, label, role, role_uncertain, nonmissing, unique_nonmissing
    FROM ({profile_sql(name, KINDS[name])})""" for name in ROLE_TABLES))
def infer_roles(spark, folder):
    frames = [
        profile.infer_roles(table(spark, folder, name)).select(
            F.lit(name).alias("table_name"), "column_id", "label", "role", "role_uncertain", "nonmissing", "unique_nonmissing"
        )
        for name in ROLE_TABLES
    ]
    return reduce(DataFrame.unionByName, frames)


@query("infer_roles_overridden", f"""{dirty_profile_sql({'user_id': 'identifier', 'value': 'categorical'})}
SELECT column_id, label, role, role_uncertain, CAST(nonfinite AS BIGINT) AS nonfinite,
  CASE WHEN label IN ('user_id', 'value') THEN 'User override applied.' ELSE '' END AS notes FROM profiled""")
def infer_roles_overridden(spark, folder):
    overrides = {"user_id": "identifier", "value": "categorical"}
    return profile.infer_roles(events_dirty(spark, folder), overrides).select(
        "column_id", "label", "role", "role_uncertain", "nonfinite", F.array_join("notes", " ").alias("notes")
    )


@query("iso_date_share", """WITH t AS (SELECT o_orderpriority AS priority, o_orderstatus AS status,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'n/a'
       ELSE ' ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN ' 10:00' ELSE '' END END AS ordered
  FROM orders)
""" + " UNION ALL ".join(
    f"""SELECT '{name}' AS variable, count({name}) AS nonmissing,
    round(avg(CASE WHEN {name} IS NULL THEN NULL WHEN regexp_full_match(trim({name}), '[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}([ T].*)?') THEN 1.0 ELSE 0.0 END), 6) AS iso_share FROM t"""
    for name in ("priority", "status", "ordered")))
def iso_date_share(spark, folder):
    texts = table(spark, folder, "orders").selectExpr(
        "o_orderpriority AS priority", "o_orderstatus AS status",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'n/a' "
        "ELSE ' ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || IF(o_orderkey % 2 = 0, ' 10:00', '') END AS ordered",
    )
    return profile.iso_date_share(texts).withColumn("iso_share", rounded("iso_share"))


@query("integer_scale_test", " UNION ALL ".join(
    f"SELECT '{name}' AS variable, bool_and({name} - floor({name}) <= 1e-8) AS whole_numbers FROM lineitem"
    for name, kind in KINDS["lineitem"].items() if kind in ("whole", "real")))
def integer_scale_test(spark, folder):
    return profile.integer_scale(table(spark, folder, "lineitem"))


@query("nonfinite_counts", DIRTY_SQL + " " + " UNION ALL ".join(
    f"""SELECT '{name}' AS variable, count(*) FILTER (WHERE NOT ({gap}) AND NOT ({inf})) AS n, count(*) FILTER (WHERE {gap}) AS missing_count,
    count(*) FILTER (WHERE {inf}) AS nonfinite_count FROM dirty"""
    for name in NUMERIC_DIRTY
    for gap, inf in [(f"{name} IS NULL OR isnan(CAST({name} AS DOUBLE))", f"isinf(CAST({name} AS DOUBLE)) IS TRUE")]))
def nonfinite_counts(spark, folder):
    return profile.nonfinite_counts(events_dirty(spark, folder))


@query("range_violations", f"""{DIRTY_SQL}
SELECT 'value' AS variable, CAST(1 AS DOUBLE) AS minimum, CAST(100 AS DOUBLE) AS maximum, count(*) FILTER (WHERE fv < 1 OR fv > 100) AS outside_n FROM finite
UNION ALL SELECT 'post_value', NULL, CAST(50 AS DOUBLE), count(*) FILTER (WHERE post_value > 50) FROM finite
UNION ALL SELECT 'user_id', CAST(3 AS DOUBLE), NULL, count(*) FILTER (WHERE user_id < 3) FROM finite""")
def range_violations(spark, folder):
    ranges = {"value": (1, 100), "post_value": (None, 50), "user_id": (3, None)}
    return profile.range_violations(events_dirty(spark, folder), ranges)


@query("eligible_variables", f"""{dirty_profile_sql()} SELECT column_id, label, role, e AS eligible_as FROM (SELECT *, CASE WHEN role = 'numeric' THEN 'outcome'
  WHEN role IN ('categorical', 'ordinal') AND unique_nonmissing BETWEEN 2 AND 20 THEN 'group' WHEN role = 'date' THEN 'date' END AS e FROM profiled)
WHERE e IS NOT NULL""")
def eligible_variables(spark, folder):
    return profile.eligible_variables(profile.profile(events_dirty(spark, folder)))


_UNITS = {"Measured value": "points"}
_LABELS = {"value": "Measured value", "event_type": " Kind of event ", "ts": ""}


@query("relabel_profile", f"""{dirty_profile_sql()} SELECT position, column_id,
  CASE label WHEN 'value' THEN 'Measured value (points)' WHEN 'event_type' THEN 'Kind of event' ELSE label END AS variable, role, missing
FROM profiled""")
def relabel_profile(spark, folder):
    renamed, _ = relabel(events_dirty(spark, folder), _LABELS)
    return profile.profile(renamed).selectExpr(
        "position", "column_id", f"{display_label('label', _UNITS)} AS variable", "role", "missing"
    )


@query("quality_table", f"""{dirty_profile_sql()} SELECT position, label AS variable, missing AS missing_n,
  printf('%.1f', missing / CAST(missing + nonmissing AS DOUBLE) * 100) AS missing_pct, CAST(nonfinite AS BIGINT) AS excluded_n,
  CASE WHEN label = 'value' THEN (SELECT count(*) FILTER (WHERE fv > 100) FROM finite) ELSE 0 END AS outside_range_n FROM profiled""")
def quality_table(spark, folder):
    dirty = events_dirty(spark, folder)
    outside = {r["variable"]: r["outside_n"] for r in profile.range_violations(dirty, {"value": (None, 100)}).collect()}
    return profile.quality_table(profile.profile(dirty), outside)


@query("overview_table", f"""WITH p AS ({profile_sql('lineitem', KINDS['lineitem'])})
SELECT position, label AS variable, CASE role WHEN 'identifier' THEN 'tunniste' WHEN 'numeric' THEN 'numeerinen' WHEN 'categorical' THEN 'luokka'
  WHEN 'ordinal' THEN 'järjestysasteikko' WHEN 'date' THEN 'päivämäärä' ELSE 'teksti' END || CASE WHEN role_uncertain THEN ' ?' ELSE '' END AS role,
  nonmissing AS valid_n, missing AS missing_n FROM p""")
def overview_table(spark, folder):
    return profile.overview_table(profile.profile(table(spark, folder, "lineitem")), "fi")


@query("dataset_fingerprint", "SELECT count(*) AS rows, true AS reordered_is_same, true AS cell_differs, true AS column_differs, true AS setting_differs FROM lineitem")
def dataset_fingerprint(spark, folder):
    """What changes the fingerprint of the line items and what does not."""
    lines = table(spark, folder, "lineitem")
    last = lines.agg(F.max(F.struct("l_orderkey", "l_linenumber"))).scalar()
    changed = lines.withColumn(
        "l_quantity", F.when(F.struct("l_orderkey", "l_linenumber") == last, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).cast(lines.schema["l_quantity"].dataType)
    )
    settings = {"language": "en"}
    variants = {
        "base": (lines, settings), "reordered": (lines.repartition(7, "l_partkey"), settings), "cell": (changed, settings),
        "column": (lines.drop("l_comment"), settings) if "l_comment" in lines.columns else (lines.drop("l_tax"), settings), "setting": (lines, {"language": "fi"}),
    }
    rows = [profile.dataset_fingerprint(df, chosen).withColumn("variant", F.lit(name)) for name, (df, chosen) in variants.items()]
    found = reduce(DataFrame.unionByName, rows).agg(F.max("rows").alias("rows"), F.map_from_entries(F.collect_list(F.struct("variant", "fingerprint"))).alias("by"))
    same = F.col("by")["base"] == F.col("by")["reordered"]
    return found.select("rows", same.alias("reordered_is_same"), *[(F.col("by")["base"] != F.col("by")[name]).alias(f"{name}_differs") for name in ("cell", "column", "setting")])

@query("compatible_charts", f"""WITH p AS ({profile_sql('orders', KINDS['orders'])})
SELECT 'missingness' AS kind UNION ALL SELECT 'histogram' WHERE EXISTS (SELECT 1 FROM p WHERE role = 'numeric')
UNION ALL SELECT 'bar' WHERE EXISTS (SELECT 1 FROM p WHERE role IN ('categorical', 'ordinal'))""")
def compatible_charts(spark, folder):
    return charts.compatible_chart_kinds(profile.profile(table(spark, folder, "orders")))


def _growing(spark, folder, name: str):
    """A folder of orders that has been summarised once and then had files added, with what reads a list of its files."""
    orders = table(spark, folder, "orders")
    base = scratch_path(spark, name)
    orders.where("o_orderkey % 4 < 3").repartition(4, "o_custkey").write.parquet(f"{base}/data/first")

    def read(files):
        return spark.read.parquet(*files)

    def grow():
        orders.where("o_orderkey % 4 = 3").write.parquet(f"{base}/data/second")

    return f"{base}/data", f"{base}/store", read, grow


@query("folder_fingerprint", """SELECT count(*) AS rows, true AS same_as_whole, true AS only_new_read FROM orders""")
def folder_fingerprint(spark, folder):
    """The fingerprint of a folder that grew, from stored parts and the new files alone, against that of the whole."""
    data, store, read, grow = _growing(spark, folder, "growing")
    first = incremental.update_folder(spark, data, store, read, incremental.file_hashes)
    grow()
    second = incremental.update_folder(spark, data, store, read, incremental.file_hashes)
    whole = profile.dataset_fingerprint(read([row["file"] for row in second.rows.select("file").collect()]))
    parts = incremental.folder_fingerprint(spark, data, store, read)
    compared = parts.join(whole.toDF("whole_rows", "whole"), F.col("rows") == F.col("whole_rows"))  # one row each
    return compared.select("rows", (F.col("fingerprint") == F.col("whole")).alias("same_as_whole"), F.lit(second.files_kept == first.files_read).alias("only_new_read"))


@query("folder_distinct_counts", """SELECT 'o_custkey' AS variable, count(o_custkey) AS nonmissing, count(*) - count(o_custkey) AS missing, true AS within_bound FROM orders
UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(*) - count(o_orderpriority), true FROM orders""")
def folder_distinct_counts(spark, folder):
    """Distinct counts of a folder that grew, from sketches of its files; within the stated bound of the exact ones."""
    data, store, read, grow = _growing(spark, folder, "distinct")
    columns = ["o_custkey", "o_orderpriority"]
    incremental.folder_distinct_counts(spark, data, store, read, columns)
    grow()
    found = incremental.folder_distinct_counts(spark, data, store, read, columns)
    exact = profile.profile(table(spark, folder, "orders").select(*columns)).selectExpr("label", "unique_nonmissing AS exact")
    close = F.abs(F.col("unique_nonmissing") - F.col("exact")) <= incremental.HLL_ERROR * F.col("exact") + 1
    return found.join(exact, F.col("variable") == F.col("label")).select("variable", "nonmissing", "missing", close.alias("within_bound"))


@query("folder_quantiles", " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS probability, count(*) AS n, true AS within_bound FROM orders" for p in (0.05, 0.25, 0.5, 0.75, 0.95)))
def folder_quantiles(spark, folder):
    """Quantiles of a folder that grew, from sketches of its files; their exact ranks are within the stated bound."""
    data, store, read, grow = _growing(spark, folder, "quantiles")
    probabilities = [0.05, 0.25, 0.5, 0.75, 0.95]
    incremental.folder_quantiles(spark, data, store, read, ["o_totalprice"], probabilities)
    grow()
    found = incremental.folder_quantiles(spark, data, store, read, ["o_totalprice"], probabilities)
    ranks = table(spark, folder, "orders").join(F.broadcast(found), F.lit(True)).groupBy("probability", "n").agg(  # five rows
        F.avg((F.col("o_totalprice") < F.col("quantile")).cast("int")).alias("low"), F.avg((F.col("o_totalprice") <= F.col("quantile")).cast("int")).alias("high"))
    bound = incremental.KLL_RANK_ERROR
    return ranks.select("probability", "n", ((F.col("low") - bound <= F.col("probability")) & (F.col("probability") <= F.col("high") + bound)).alias("within_bound"))
