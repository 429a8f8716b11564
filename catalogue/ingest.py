"""Queries on delimited text. The files are written by Spark from the test tables into the shared folder."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import DIRTY_KINDS, DIRTY_SQL, events_dirty, query, table
from descry.session import scratch_path
from descry.sources import delimited, tables


def _coded_events(spark, folder) -> DataFrame:
    """Dirty events with the text NA as one of the codes."""
    return events_dirty(spark, folder).selectExpr(
        "event_id", "CASE WHEN event_id % 37 = 0 THEN 'NA' ELSE event_type END AS code", "CAST(ts AS STRING) AS ts", "post_value"
    )


_CODED = f"{DIRTY_SQL}, coded AS (SELECT event_id, CASE WHEN event_id % 37 = 0 THEN 'NA' ELSE event_type END AS code, post_value FROM dirty)"


def _written(spark, df: DataFrame, name: str, **options) -> str:
    path = scratch_path(spark, name)
    df.write.options(header=True, quote='"', escape='"', **options).csv(path)
    return path


def _by_code(df: DataFrame) -> DataFrame:
    return df.groupBy("code").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"), F.count("post_value").alias("filled"),
        F.round(F.sum("post_value"), 4).alias("total"),
    )


_BY_CODE = """count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids, count(post_value) AS filled, round(sum(post_value), 4) AS total FROM coded"""


@query("csv_strict_scan", f"{_CODED} SELECT code, {_BY_CODE} GROUP BY code")
def csv_strict_scan(spark, folder):
    path = _written(spark, _coded_events(spark, folder), "strict")
    return _by_code(delimited.strict_scan(spark, path).typed())


@query("csv_default_na_scan", f"{_CODED} SELECT CASE WHEN code <> 'NA' THEN code END AS code, {_BY_CODE} GROUP BY 1")
def csv_default_na_scan(spark, folder):
    path = _written(spark, _coded_events(spark, folder), "lenient")
    return _by_code(delimited.lenient_scan(spark, path).typed())


def _by_folder(found: DataFrame, *columns: str) -> DataFrame:
    """The audit's verdicts by the folder of the files, which the query has written; equal ones once, with the most lines."""
    return found.groupBy(F.element_at(F.split("file", "/"), -2).alias("folder"), *columns)


@query("csv_separator_audit", """WITH k AS (SELECT least(count(*) + 1, 12) AS n FROM orders), f(folder, comma, semicolon, tab, separator, verdict) AS (VALUES
  ('comma', 2, NULL, NULL, ',', 'detected'), ('semicolon', NULL, 2, NULL, ';', 'detected'), ('tab', NULL, NULL, 2, chr(9), 'detected'), ('single', NULL, NULL, NULL, NULL, 'ambiguous'))
SELECT folder, CAST(n AS BIGINT) AS lines, CAST(comma AS BIGINT) AS comma, CAST(semicolon AS BIGINT) AS semicolon, CAST(tab AS BIGINT) AS tab, separator, verdict FROM f, k""")
def csv_separator_audit(spark, folder):
    """Files of the same orders with each separator, and with one column only; every file of a folder must look alike."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    base = scratch_path(spark, "separators")
    for name, mark in zip(("comma", "semicolon", "tab"), delimited.SEPARATORS):
        orders.write.csv(f"{base}/{name}", sep=mark, header=True)
    orders.select("o_orderkey").write.csv(f"{base}/single", header=True)
    found = delimited.separator_audit(spark, [f"{base}/{name}" for name in ("comma", "semicolon", "tab", "single")])
    return _by_folder(found, "comma", "semicolon", "tab", "separator", "verdict").agg(F.max("lines").alias("lines"))


@query("csv_header_audit", """SELECT folder, columns, blank_labels, duplicate_labels, false AS has_nul, verdict, count(*) > 0 AS found FROM supplier, (VALUES
  ('good', 3, 0, 0, 'ok'), ('blank', 3, 1, 0, 'blank_label'), ('double', 3, 0, 1, 'duplicate_label'), ('folded', 3, 0, 1, 'duplicate_label'),
  ('tabbed', 3, 0, 0, 'ok')) AS t(folder, columns, blank_labels, duplicate_labels, verdict) GROUP BY ALL""")
def csv_header_audit(spark, folder):
    """Files of the same suppliers under good, blank and repeated labels (also by case folding), one with tabs."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    base = scratch_path(spark, "headers")
    headers = {"good": ("key", "name", "balance"), "blank": ("key", " ", "balance"), "double": ("key", "name", "name "), "folded": ("key", "Maß", "MASS")}
    for name, labels in headers.items():
        suppliers.toDF(*labels).write.csv(f"{base}/{name}", header=True)
    suppliers.toDF(*headers["good"]).write.csv(f"{base}/tabbed", header=True, sep="\t")
    found = delimited.header_audit(spark, [f"{base}/{name}" for name in (*headers, "tabbed")], separator=None)
    return _by_folder(found, "columns", "blank_labels", "duplicate_labels", "has_nul", "verdict").agg((F.count("*") > 0).alias("found"))


@query("csv_binary_audit", """SELECT 'part=' || event_id % 8 AS folder, 2 AS columns, event_id % 8 < 3 AS has_nul, CASE WHEN event_id % 8 < 3 THEN 'binary' ELSE 'ok' END AS verdict
FROM events GROUP BY ALL UNION ALL SELECT 'none', 0, false, 'empty'""")
def csv_binary_audit(spark, folder):
    """Files with NUL in their second line (the first three parts), with NUL only beyond the bytes looked at, and without any byte."""
    events = table(spark, folder, "events").selectExpr("event_id % 8 AS part", "event_id AS place", "row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) AS n")
    lines = events.selectExpr("part", "place", "concat(place, ',', IF(part < 3 AND n = 1 OR part = 3 AND n > 60, chr(0), 'x'), repeat('y', 90)) AS line")
    headers = events.selectExpr("part", "-1L AS place", "'key,fill' AS line").distinct()
    base = scratch_path(spark, "binary")
    files = lines.unionByName(headers).repartition("part").sortWithinPartitions("part", "place")
    files.select("part", "line").write.partitionBy("part").text(f"{base}/filled")
    table(spark, folder, "events").where("event_id < 0").select("event_type").write.text(f"{base}/none")
    found = delimited.header_audit(spark, [f"{base}/filled/part=*", f"{base}/none"])
    return _by_folder(found, "columns", "has_nul", "verdict").agg(F.count("*").alias("files")).drop("files")


@query("csv_gb18030_scan", """SELECT lang, count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(length(label)) AS BIGINT) AS letters, min(label) AS first_label FROM (
  SELECT doc_id, lang, '组别 €' || lang || ' ß;' || doc_id % 7 AS label FROM documents) GROUP BY lang""")
def csv_gb18030_scan(spark, folder):
    """Texts of many alphabets in an encoding that Spark's reader does not take."""
    labelled = table(spark, folder, "documents").selectExpr("doc_id", "lang", "concat('组别 €', lang, ' ß;', doc_id % 7) AS label")

    def encoded(batches):
        for batch in batches:
            columns = [pa.array([None if v is None else str(v).encode("gb18030").decode("latin-1") for v in c.to_pylist()], pa.string()) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    path = scratch_path(spark, "gb18030")
    octets = labelled.mapInArrow(encoded, "doc_id string, lang string, label string").toDF("doc_id", "lang", "标签".encode("gb18030").decode("latin-1"))
    octets.write.options(header=True, quote='"', escape='"', encoding="ISO-8859-1").csv(path)
    found = delimited.strict_scan(spark, path, encoding="GB18030").typed()
    return found.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"), F.sum(F.length("标签")).alias("letters"), F.min("标签").alias("first_label"))


@query("csv_blank_lines", "SELECT CAST(event_id % 8 AS VARCHAR) AS part, count(*) AS blank_lines FROM events WHERE event_id % 101 = 0 GROUP BY 1")
def csv_blank_lines(spark, folder):
    """Lines that a strict scan refuses, per file."""
    lines = table(spark, folder, "events").selectExpr(
        "event_id % 8 AS part", "CASE WHEN event_id % 101 = 0 THEN repeat(' ', CAST(event_id % 3 AS INT)) ELSE concat_ws(',', event_id, event_type) END AS line"
    )
    path = scratch_path(spark, "blank")
    lines.repartition("part").write.partitionBy("part").text(path)
    found = delimited.blank_lines(spark, path)
    return found.groupBy(F.regexp_extract("file", "part=([0-9]+)", 1).alias("part")).agg(F.sum("blank_lines").alias("blank_lines"))


@query("csv_ragged_audit", """SELECT CAST(3 AS INTEGER) AS columns, count(*) AS records,
  count(*) FILTER (WHERE event_id % 101 = 0 OR event_id % 77 = 0 OR event_id % 50 = 0) AS malformed,
  count(*) FILTER (WHERE event_id % 101 = 0) AS blank_lines FROM events""")
def csv_ragged_audit(spark, folder):
    """Lines with a field too few, a field too many, or none at all."""
    lines = table(spark, folder, "events").selectExpr(
        "event_id % 8 AS part", "1 AS place",
        "CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 77 = 0 THEN concat_ws(',', event_id, event_type, value, 'more') "
        "WHEN event_id % 50 = 0 THEN concat_ws(',', event_id, event_type) "
        "ELSE concat_ws(',', event_id, '\"' || event_type || ', quoted\"', value) END AS line",
    )
    headers = spark.range(8).selectExpr("id AS part", "0 AS place", "'event_id,event_type,value' AS line")
    path = scratch_path(spark, "ragged")
    # One file per part, its header first.
    files = lines.unionByName(headers).repartition("part").sortWithinPartitions("part", "place")
    files.select("part", "line").write.partitionBy("part").text(path)
    found = delimited.ragged_audit(spark, path)
    return found.groupBy("columns").agg(
        F.sum("records").alias("records"), F.sum("malformed").alias("malformed"), F.sum("blank_lines").alias("blank_lines")
    )


@query("csv_record_audit", """SELECT CAST(3 AS INTEGER) AS columns, count(*) AS records, count(*) FILTER (WHERE event_id % 101 = 0 OR event_id % 77 = 0) AS malformed,
  count(*) FILTER (WHERE event_id % 101 = 0) AS blank_lines, CAST(0 AS BIGINT) AS open_quotes FROM events""")
def csv_record_audit(spark, folder):
    """Records of which every third has line breaks and separators inside quotes; some have a field too many or none."""
    lines = table(spark, folder, "events").selectExpr(
        "event_id % 8 AS part", "1 AS place",
        "CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 77 = 0 THEN concat_ws(',', event_id, event_type, value, 'more') "
        "WHEN event_id % 3 = 0 THEN concat(event_id, ',\"', event_type, ',\n', event_id, ' \"\"again\"\"\n\",', value) ELSE concat_ws(',', event_id, event_type, value) END AS line",
    )
    headers = spark.range(8).selectExpr("id AS part", "0 AS place", "'event_id,event_type,value' AS line")
    path = scratch_path(spark, "records")
    files = lines.unionByName(headers).repartition("part").sortWithinPartitions("part", "place")
    files.select("part", "line").write.partitionBy("part").text(path)
    found = delimited.ragged_audit(spark, path, quoted_breaks=True)
    return found.groupBy("columns").agg(*[F.sum(name).alias(name) for name in ("records", "malformed", "blank_lines", "open_quotes")])


@query("size_gate", """WITH n AS (SELECT count(*) AS rows FROM lineitem)
SELECT 'rows' AS "check", CAST(100000 AS BIGINT) AS "limit", rows AS actual, rows <= 100000 AS passed FROM n
UNION ALL SELECT 'columns', 250, 11, true UNION ALL SELECT 'cells', 2000000, rows * 11, rows * 11 <= 2000000 FROM n""")
def size_gate(spark, folder):
    return tables.size_gate(table(spark, folder, "lineitem"), max_rows=100_000, max_columns=250, max_cells=2_000_000)


@query("decimal_comma_parse", f"""{DIRTY_SQL} SELECT event_type, count(*) AS rows, count(value) AS numbers, round(sum(fv), 4) AS total,
  count(*) FILTER (WHERE isinf(value)) AS infinite FROM finite GROUP BY event_type""")
def decimal_comma_parse(spark, folder):
    texts = events_dirty(spark, folder).selectExpr("event_type", "replace(CAST(value AS STRING), '.', ',') AS value")
    numbers = delimited.decimal_numbers(texts, ["value"])
    infinite = F.abs("value") == F.lit(float("inf"))
    return numbers.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("numbers"),
        F.round(F.sum(F.when(F.abs("value") < F.lit(float("inf")), F.col("value"))), 4).alias("total"),
        F.count_if(infinite).alias("infinite"),
    )


@query("infer_text_types", DIRTY_SQL + " " + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{name}' AS label, count({name}) AS nonmissing, {'count(' + name + ')' if kind == 'whole' else 'CAST(0 AS BIGINT)'} AS integers,
    {'count(' + name + ')' if kind in ('whole', 'real') else 'CAST(0 AS BIGINT)'} AS numbers, CAST(0 AS BIGINT) AS booleans,
    '{dict(whole='bigint', real='double').get(kind, 'string')}' AS inferred_type FROM dirty"""
    for i, (name, kind) in enumerate(DIRTY_KINDS.items(), 1)))
def infer_text_types(spark, folder):
    texts = events_dirty(spark, folder).selectExpr(*[f"CAST({name} AS STRING) AS {name}" for name in DIRTY_KINDS])
    return delimited.infer_text_types(texts)


_BLANK = """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id > (SELECT max(event_id) FROM {e}) * 9 / 10 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 OR event_id > (SELECT max(event_id) FROM {e}) * 9 / 10 THEN '' ELSE props END AS props FROM {e}"""


@query("trim_trailing_blank", f"""WITH b AS ({_BLANK.format(e='events')}) SELECT event_type, count(*) AS rows, min(event_id) AS first, max(event_id) AS last FROM b
WHERE event_id <= (SELECT max(event_id) FROM b WHERE event_type IS NOT NULL OR props <> '') GROUP BY event_type""")
def trim_trailing_blank(spark, folder):
    """The last tenth of the records, and every seventh of the others, is blank."""
    records = spark.sql(_BLANK, e=table(spark, folder, "events"))
    return tables.trim_trailing_blank(records, "event_id").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first"), F.max("event_id").alias("last")
    )


@query("preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def preview(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return tables.preview(orders, ["o_orderkey"])
