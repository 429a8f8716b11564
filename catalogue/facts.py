"""Evidence-fact queries."""

from pyspark.sql import functions as F

from catalogue.registry import DIRTY_SQL, dirty_profile_sql, events_dirty, query, statistic_sql, table
from descry import wording
from descry.operators import compare, describe, facts, profile
from descry.plans.report import section_filter, section_table
from descry.plans.settings import ReportSettings
from descry.plans.sinks import result_json

UNITS = {"value": "points"}


def evidence(spark, folder):
    """Facts of the dirty events: size, missingness, numeric columns, and a correlation."""
    dirty = events_dirty(spark, folder)
    profiled = profile.profile(dirty)
    numeric = describe.numeric_profile(dirty, ["value", "post_value"])
    found = facts.dataset_fact(profiled).unionByName(facts.missing_facts(profiled, UNITS))
    found = found.unionByName(facts.numeric_facts(numeric, profile.column_ids(dirty), UNITS))
    return found.unionByName(facts.relationship_fact(compare.pearson_relationship(dirty, "value", "post_value")))


_STATS = "count({v}) AS n, avg({v}) AS mean, stddev_samp({v}) AS sd, quantile_cont({v}, 0.5) AS median, min({v}) AS mn, max({v}) AS mx FROM finite"

EVIDENCE_SQL = f"""{dirty_profile_sql()}, size AS (SELECT count(*) AS rows FROM dirty),
numbers AS (SELECT 0 AS position, 'c005' AS column_id, 'value (points)' AS label, {_STATS.format(v='fv')}
  UNION ALL SELECT 1, 'c006', 'post_value', {_STATS.format(v='post_value')}),
pearson AS (SELECT count(*) AS n, covar_samp(fv, post_value) / (stddev_samp(fv) * stddev_samp(post_value)) AS r FROM finite
  WHERE fv IS NOT NULL AND post_value IS NOT NULL),
gaps AS (SELECT *, CASE WHEN label = 'value' THEN 'value (points)' ELSE label END AS shown, missing / CAST(rows AS DOUBLE) * 100 AS share
  FROM profiled, size WHERE missing > 0)"""


@query("evidence_facts", f"""{EVIDENCE_SQL}
SELECT CAST(0 AS BIGINT) AS ordinal, 'dataset_size' AS id, 'dataset' AS kind, '' AS variables, rows AS denominator, '' AS codes,
  CAST(rows AS DOUBLE) AS first_value, CAST(6 AS DOUBLE) AS second_value FROM size
UNION ALL SELECT 1000 + position, 'missing_' || column_id, 'missingness', column_id, rows, '', CAST(missing AS DOUBLE), round(share, 6) FROM gaps
UNION ALL SELECT 2000 + position, 'numeric_' || column_id, 'numeric_descriptive', column_id, n, '', round(mean, 6), round(median, 6) FROM numbers
UNION ALL SELECT 3000, 'relationship_1', 'relationship', '', n, 'linear_association', round(r, 6), CAST(n AS DOUBLE) FROM pearson""")
def evidence_facts(spark, folder):
    names = F.create_map(
        *[F.lit(x) for x in ("dataset", "rows", "missingness", "missing_n", "numeric_descriptive", "mean", "relationship", "r")]
    )
    others = F.create_map(
        *[F.lit(x) for x in ("dataset", "columns", "missingness", "percent", "numeric_descriptive", "median", "relationship", "pairwise_n")]
    )
    values = F.col("values")
    return evidence(spark, folder).select(
        "ordinal", "id", "kind", F.array_join("variable_ids", ",").alias("variables"), "denominator",
        F.array_join("allowed_interpretation_codes", ",").alias("codes"),
        F.round(values[names[F.col("kind")]], 6).alias("first_value"), F.round(values[others[F.col("kind")]], 6).alias("second_value"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(template: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


def _sentences_sql() -> str:
    parts = []
    for language in wording.LANGUAGES:
        text = {kind: _quoted(wording.sentence(language, kind)) for kind in ("dataset", "missing", "numeric", "relationship")}
        numbers = {
            "n": "CAST(n AS VARCHAR)", "mean": statistic_sql("mean"), "sd": statistic_sql("sd"), "median": statistic_sql("median"),
            "minimum": statistic_sql("mn"), "maximum": statistic_sql("mx"), "label": "label",
        }
        sizes = {"rows": "CAST(rows AS VARCHAR)", "columns": "'6'"}
        gaps = {"missing": "CAST(missing AS VARCHAR)", "percent": "printf('%.1f', share)", "label": "shown"}
        pair = {"n": "CAST(n AS VARCHAR)", "r": statistic_sql("r"), "first": "'value'", "second": "'post_value'"}
        parts += [
            f"SELECT '{language}' AS language, 'dataset_size' AS id, {_replaced(text['dataset'], sizes)} AS sentence FROM size",
            f"SELECT '{language}', 'missing_' || column_id, {_replaced(text['missing'], gaps)} FROM gaps",
            f"SELECT '{language}', 'numeric_' || column_id, {_replaced(text['numeric'], numbers)} FROM numbers",
            f"SELECT '{language}', 'relationship_1', {_replaced(text['relationship'], pair)} FROM pearson",
        ]
    return EVIDENCE_SQL + " " + " UNION ALL ".join(parts)


@query("fact_sentences", _sentences_sql())
def fact_sentences(spark, folder):
    return facts.with_sentences(evidence(spark, folder)).select("language", "id", "sentence")


@query("range_sentences", f"""{DIRTY_SQL}, n AS (SELECT count(*) FILTER (WHERE fv > 100) AS c FROM finite)
SELECT 'value' AS variable, 'value (points): ' || c || ' finite values fall outside the user-supplied range −∞ to 100.00; values were flagged, not removed.' AS sentence
FROM n WHERE c > 0""")
def range_sentences(spark, folder):
    violations = profile.range_violations(events_dirty(spark, folder), {"value": (None, 100), "post_value": (0, None)})
    return facts.range_sentences(violations, "en", UNITS)


_REQUESTS = "SELECT DISTINCT CASE WHEN event_id % 4 = 0 THEN 'fi' WHEN event_id % 4 = 1 THEN 'es' WHEN event_id % 4 = 2 THEN 'xx' ELSE 'en' END AS language, {key} AS key FROM {e}"
_KEYS = "CASE WHEN event_id % 5 = 0 THEN 'group' WHEN event_id % 5 = 1 THEN 'time' WHEN event_id % 5 = 2 THEN 'detailed' ELSE event_type END"
_LOOKED_UP = {
    ("fi", "group"): "ryhmävertailu", ("fi", "time"): "aikasarja", ("fi", "detailed"): "laaja", ("es", "group"): "comparación de grupos",
    ("es", "time"): "serie por fecha", ("es", "detailed"): "detallado", ("en", "group"): "group comparison", ("en", "time"): "date series",
    ("en", "detailed"): "detailed",
}


@query("template_lookup", f"""WITH requests AS ({_REQUESTS.format(key=_KEYS, e='events')}), words(language, key, text) AS (VALUES {', '.join(
    f"('{language}', '{key}', '{text}')" for (language, key), text in _LOOKED_UP.items())})
SELECT r.language, r.key, coalesce(own.text, en.text, r.key) AS text FROM requests r LEFT JOIN words own ON own.language = r.language AND own.key = r.key
LEFT JOIN words en ON en.language = 'en' AND en.key = r.key""")
def template_lookup(spark, folder):
    requests = spark.sql(_REQUESTS.format(key=_KEYS, e="{e}"), e=table(spark, folder, "events"))
    return facts.look_up(requests, facts.labels(spark, "setting"), "text").select("language", "key", "text")


# --- facts of many reports ------------------------------------------------------------------------------------

_TYPES = "('click', 'view', 'purchase', 'signup', 'error')"


def user_facts(spark, folder):
    """One report per user with one fact per kind of event, a third of the events counted to user 0."""
    events = table(spark, folder, "events").selectExpr(
        "IF(event_id % 3 = 0, 0, user_id) AS user_id", "event_type", "event_id", "value"
    )
    grouped = events.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 60).alias("high_n"), F.min("event_id").alias("ordinal"),
        F.max("value").alias("top"),
    )
    codes = (
        F.when(F.col("event_type").isin("click", "view"), F.array(F.lit("describe_direction")))
        .when(F.col("event_type") == "purchase", F.array(F.lit("linear_association")))
        .otherwise(F.array().cast("array<string>"))
    )
    return grouped.select(
        F.col("user_id").cast("string").alias("report_id"), "ordinal", F.concat(F.lit("mean_"), "event_type").alias("id"),
        F.lit("numeric").alias("kind"), F.col("n").alias("denominator"),
        F.create_map(F.lit("high_n"), F.col("high_n").cast("double"), F.lit("top"), F.col("top")).alias("values"),
        F.concat(F.lit("User "), "user_id", F.lit(" had "), "n", F.lit(" events of kind "), "event_type", F.lit(".")).alias("sentence"),
        codes.alias("allowed_interpretation_codes"),
    )


USER_FACTS_SQL = """WITH counted AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_type, event_id, value FROM events),
facts AS (SELECT CAST(user_id AS VARCHAR) AS report_id, min(event_id) AS ordinal, 'mean_' || event_type AS id, event_type, count(*) AS denominator,
  count(*) FILTER (WHERE value > 60) AS high_n, 'User ' || user_id || ' had ' || count(*) || ' events of kind ' || event_type || '.' AS sentence,
  CASE WHEN event_type IN ('click', 'view') THEN 'describe_direction' WHEN event_type = 'purchase' THEN 'linear_association' END AS code
  FROM counted GROUP BY user_id, event_type)"""


@query("fact_suppression", f"{USER_FACTS_SQL} SELECT report_id, id, denominator FROM facts WHERE denominator >= 5 AND high_n >= 5")
def fact_suppression(spark, folder):
    return facts.suppress_small_cells(user_facts(spark, folder)).select("report_id", "id", "denominator")


@query("fact_payload", f"""{USER_FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ordinal, id) AS rank FROM facts
  WHERE denominator >= 5 AND high_n >= 5)
SELECT report_id, CAST(rank AS INTEGER) AS rank, id, '[[FACT:' || id || ']]' AS token, sentence AS binding, coalesce(code, '') AS codes FROM r WHERE rank <= 3""")
def fact_payload(spark, folder):
    """At most three facts here, so that the limit takes effect."""
    found = facts.fact_payload(user_facts(spark, folder), share_labels=True, limit=3)
    return found.select("report_id", "rank", "id", "token", "binding", F.array_join("allowed_interpretation_codes", ",").alias("codes"))


@query("fact_payload_json", f"""{USER_FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ordinal, id) AS rank FROM facts
  WHERE denominator >= 5 AND high_n >= 5)
SELECT report_id, '{{"language":"en","audience":"general","depth":"brief","study_context":"","facts":[' || string_agg(
  '{{"id":"' || id || '","token":"[[FACT:' || id || ']]","binding":"' || id || '","kind":"numeric","allowed_interpretation_codes":[' ||
  coalesce('"' || code || '"', '') || ']}}', ',' ORDER BY rank) || ']}}' AS payload FROM r WHERE rank <= 30 GROUP BY report_id""")
def fact_payload_json(spark, folder):
    payload = facts.fact_payload(user_facts(spark, folder))
    return facts.payload_json(payload, language="en", audience="general", depth="brief", study_context="not shared")


def _section_rows(spark, folder):
    dirty = events_dirty(spark, folder)
    profiled = profile.profile(dirty)
    results = {
        "facts": facts.with_sentences(evidence(spark, folder), ["en"]),
        "overview": profile.overview_table(profiled), "quality": profile.quality_table(profiled),
    }
    return section_table(results, ReportSettings())


@query("section_filter", f"""{EVIDENCE_SQL}, s AS (
  SELECT 'executive' AS section, 'sentences' AS table_id, 1 AS cells FROM size
  UNION ALL SELECT 'overview', 'sentences', 1 FROM size UNION ALL SELECT 'primary', 'sentences', 1 FROM pearson
  UNION ALL SELECT 'overview', 'overview_variables', 4 FROM profiled
  UNION ALL SELECT 'quality', 'quality_missing', 4 FROM profiled UNION ALL SELECT 'quality', 'sentences', 1 FROM gaps
  UNION ALL SELECT 'descriptive', 'sentences', 1 FROM numbers)
SELECT section, table_id, CAST(sum(cells) AS BIGINT) AS cells FROM s WHERE section IN ('overview', 'executive', 'primary', 'limitations', 'technical') GROUP BY ALL""")
def section_filter_query(spark, folder):
    kept = section_filter(_section_rows(spark, folder), ["overview"])
    return kept.groupBy("section", "table_id").agg(F.count(F.lit(1)).alias("cells"))


@query("result_json", f"""{DIRTY_SQL} SELECT '{{"event_id":' || event_id || ',"event_type":' || coalesce('"' || event_type || '"', 'null') ||
  ',"finite":' || CASE WHEN fv IS NULL THEN 'false' ELSE 'true' END || ',"value":' || coalesce(CASE WHEN fv IS NULL THEN NULL WHEN fv > 50 THEN '1.0' ELSE '0.0' END, 'null') || '}}' AS json FROM finite""")
def result_json_query(spark, folder):
    """NaN and infinity become null; the finite values are reduced to 0 and 1 so that both sides print them alike."""
    rows = events_dirty(spark, folder).selectExpr(
        "event_id", "event_type", "value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity') AS finite",
        "CASE WHEN isnan(value) OR abs(value) = double('infinity') THEN value WHEN value > 50 THEN 1D WHEN value <= 50 THEN 0D END AS value",
    )
    return result_json(rows)
