"""Narrative queries: conversations as narratives about the facts of users."""

from pyspark.sql import functions as F

from catalogue.facts import USER_FACTS_SQL, user_facts
from catalogue.registry import query, table
from descry.functions import text
from descry.operators import narrative

# The same derived columns for both engines; {arr} makes an array of its arguments.
_BLOCKS = """SELECT CAST(conv_id AS {str}) AS response_id, CAST(CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id % 150 END AS {str}) AS report_id,
  CASE WHEN conv_id % 10 = 9 THEN 'fi' ELSE 'en' END AS language, CAST(turn AS INT) AS block_no, 'interpretation' AS section_id,
  CASE (conv_id + turn) % 7 WHEN 0 THEN concat(text, ' [[FACT:mean_click]]') WHEN 1 THEN concat('[[FACT:mean_view]]', text, ' and [[FACT:mean_none]]')
    WHEN 2 THEN concat(text, ' [[FACT:mean_') WHEN 3 THEN concat(text, ' was Caused by [[FACT:mean_purchase]].') WHEN 4 THEN concat(text, ' in 12,5% of cases')
    WHEN 5 THEN '   ' ELSE 'It may follow: [[FACT:mean_click]] [[FACT:mean_view]]' END AS prose,
  CASE (conv_id + turn) % 4 WHEN 0 THEN {arr}('mean_click') WHEN 1 THEN {arr}('mean_purchase', 'mean_click') WHEN 2 THEN {arr}('mean_gone') ELSE {empty} END AS fact_ids,
  CASE conv_id % 5 WHEN 0 THEN 'describe_direction' WHEN 1 THEN 'linear_association' WHEN 2 THEN '' END AS interpretation_code
FROM {source}"""

BLOCKS_SQL = _BLOCKS.format(str="VARCHAR", arr="list_value", empty="CAST([] AS VARCHAR[])", source="conversations")
TOKEN_SQL = r"\[\[FACT:([A-Za-z0-9_-]+)\]\]"
NUMBER_SQL = r"(^|[^\pL\pN_\]])[-+]?\p{Nd}"


def blocks(spark, folder):
    return spark.sql(
        _BLOCKS.format(str="STRING", arr="array", empty="CAST(array() AS ARRAY<STRING>)", source="{conversations}"),
        conversations=table(spark, folder, "conversations"),
    )


@query("fact_token_extract", f"""WITH blocks AS ({BLOCKS_SQL}), t AS (SELECT response_id, block_no, regexp_extract_all(prose, '{TOKEN_SQL}', 1) AS ids FROM blocks)
SELECT response_id, block_no, CAST(i AS INTEGER) AS token_no, ids[i] AS fact_id FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM t)""")
def fact_token_extract(spark, folder):
    return narrative.fact_token_table(blocks(spark, folder))


_REFERENCES = f"""refs AS (SELECT DISTINCT response_id, report_id, block_no, interpretation_code, listed, ref FROM (
  SELECT response_id, report_id, block_no, interpretation_code, false AS listed, unnest(regexp_extract_all(prose, '{TOKEN_SQL}', 1)) AS ref FROM blocks WHERE trim(prose) <> ''
  UNION ALL SELECT response_id, report_id, block_no, interpretation_code, true, unnest(fact_ids) FROM blocks WHERE trim(prose) <> ''))"""


@query("narrative_unknown_facts", f"""{USER_FACTS_SQL}, blocks AS ({BLOCKS_SQL}), {_REFERENCES}
SELECT DISTINCT response_id, block_no, ref AS fact_id FROM refs r WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.report_id = r.report_id AND f.id = r.ref)""")
def narrative_unknown_facts(spark, folder):
    return narrative.unknown_facts(blocks(spark, folder), user_facts(spark, folder))


_BANNED = "statistically significant|caused|causes|proved|citation|references"


@query("narrative_validation", f"""{USER_FACTS_SQL}, blocks AS ({BLOCKS_SQL}), {_REFERENCES},
errors AS (
  SELECT response_id, 'wrong_language' AS code FROM blocks WHERE language <> 'en'
  UNION SELECT response_id, 'empty_prose' FROM blocks WHERE trim(prose) = ''
  UNION SELECT response_id, 'unresolved_token' FROM blocks WHERE contains(prose, '[[FACT:') AND NOT regexp_matches(prose, '{TOKEN_SQL}')
  UNION SELECT response_id, 'literal_quantitative_claim' FROM blocks WHERE regexp_matches(regexp_replace(prose, '{TOKEN_SQL}', '', 'g'), '{NUMBER_SQL}')
  UNION SELECT response_id, 'unsupported_claim' FROM blocks WHERE regexp_matches(lower(regexp_replace(prose, '{TOKEN_SQL}', '', 'g')), '{_BANNED}')
  UNION SELECT response_id, 'unknown_fact' FROM refs r WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.report_id = r.report_id AND f.id = r.ref)
  UNION SELECT response_id, 'unsupported_interpretation' FROM blocks b WHERE interpretation_code <> '' AND trim(prose) <> '' AND NOT EXISTS (
    SELECT 1 FROM refs r JOIN facts f ON f.report_id = r.report_id AND f.id = r.ref WHERE r.response_id = b.response_id AND r.block_no = b.block_no
    AND r.listed AND f.code = b.interpretation_code))
SELECT response_id, coalesce(string_agg(code, ',' ORDER BY code), '') AS errors, count(code) = 0 AS valid
FROM (SELECT DISTINCT response_id FROM blocks) LEFT JOIN errors USING (response_id) GROUP BY response_id""")
def narrative_validation(spark, folder):
    verdicts = narrative.validate_narratives(blocks(spark, folder), user_facts(spark, folder), "en")
    return verdicts.select("response_id", F.array_join("errors", ",").alias("errors"), "valid")


@query("fact_token_expand", f"""{USER_FACTS_SQL}, blocks AS ({BLOCKS_SQL}), wide AS (SELECT report_id,
  max(sentence) FILTER (WHERE id = 'mean_click') AS c, max(sentence) FILTER (WHERE id = 'mean_view') AS v, max(sentence) FILTER (WHERE id = 'mean_purchase') AS p
  FROM facts GROUP BY report_id)
SELECT response_id, block_no, regexp_replace(replace(replace(replace(prose, '[[FACT:mean_click]]', coalesce(c, '')), '[[FACT:mean_view]]', coalesce(v, '')),
  '[[FACT:mean_purchase]]', coalesce(p, '')), '{TOKEN_SQL}', '', 'g') AS text FROM blocks LEFT JOIN wide USING (report_id)""")
def fact_token_expand(spark, folder):
    return narrative.expand_fact_tokens(blocks(spark, folder), user_facts(spark, folder))


@query("text_numeric_claims", f"SELECT doc_id, regexp_matches(regexp_replace(text, '{TOKEN_SQL}', '', 'g'), '{NUMBER_SQL}') AS has_number FROM documents")
def text_numeric_claims(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.has_literal_number(F.col("text")).alias("has_number"))


@query("text_banned_terms", f"""SELECT doc_id, lang, CASE lang WHEN 'en' THEN regexp_matches(lower(t), '{_BANNED}')
  WHEN 'es' THEN regexp_matches(lower(t), 'estadísticamente significativo|causó|demostró|referencias|citación') ELSE false END AS banned
FROM (SELECT doc_id, lang, text || CASE WHEN doc_id % 9 = 0 THEN ' Proved.' WHEN doc_id % 9 = 1 THEN ' Demostró.' ELSE '' END AS t FROM documents)""")
def text_banned_terms(spark, folder):
    documents = table(spark, folder, "documents").selectExpr(
        "doc_id", "lang", "text || CASE WHEN doc_id % 9 = 0 THEN ' Proved.' WHEN doc_id % 9 = 1 THEN ' Demostró.' ELSE '' END AS t"
    )
    return documents.select("doc_id", "lang", narrative.uses_banned_term(F.col("t"), F.col("lang")).alias("banned"))


# Every tenth conversation shows another problem; its turns are the prose of the blocks.
_BODY_PROBLEMS = {0: "not_an_object", 1: "not_an_object", 2: "unknown_language", 3: "unknown_field", 4: "missing_field", 5: "wrong_type", 6: "wrong_type", 7: "not_an_object"}


@query("narrative_schema_check", f"""WITH r AS (SELECT conv_id, turn // 12 AS part, conv_id % 10 AS k, count(*) AS n, max(length(text)) AS longest FROM conversations GROUP BY 1, 2)
SELECT conv_id || ':' || part AS response_id, concat_ws(',', CASE WHEN k NOT IN (0, 1, 7) AND n > 8 THEN 'block_count' END,
  CASE k {' '.join(f"WHEN {k} THEN '{name}'" for k, name in _BODY_PROBLEMS.items() if name in ('missing_field', 'not_an_object'))} END,
  CASE WHEN k NOT IN (0, 1, 4, 5, 7) AND longest > 3000 THEN 'prose_too_long' END, CASE k WHEN 3 THEN 'unknown_field' WHEN 2 THEN 'unknown_language' END,
  CASE WHEN k IN (5, 6) THEN 'wrong_type' END) AS problems FROM r""")
def narrative_schema_check(spark, folder):
    """Bodies made of the turns of conversations, some with wrong types, text after the end or missing fields."""
    kind = F.col("conv_id") % 10
    quoted = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prose")))  # {"prose":"..."}
    prose = F.when(kind == 5, F.lit(',"prose":5')).when(kind == 4, F.lit("")).otherwise(
        F.concat(F.lit(","), quoted.substr(F.lit(2), F.length(quoted) - 2)))
    ids = F.when(kind == 6, F.lit('"a"')).otherwise(F.lit('["a"]'))
    block = F.concat(F.lit('{"section_id":"s"'), prose, F.lit(',"fact_ids":'), ids, F.lit("}"))
    turns = table(spark, folder, "conversations").select("conv_id", F.expr("turn div 12").alias("part"), "turn", block.alias("block"))
    # Twelve turns of a conversation are one response, so that a long one does not become one row; the turns are the blocks.
    joined = turns.groupBy("conv_id", "part").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "block")))["block"], ",").alias("blocks"))
    language = F.when(kind == 2, F.lit("fr")).otherwise(F.lit("es"))
    body = F.concat(F.lit('{"language":"'), language, F.lit('"'), F.when(kind == 3, F.lit(',"tone":1')).otherwise(""), F.lit(',"blocks":['), "blocks",
                    F.lit("]}"), F.when(kind == 7, F.lit(" and more")).otherwise(""))
    body = F.when(kind == 0, F.lit("not json")).when(kind == 1, F.lit("[]")).otherwise(body)
    found = narrative.check_response_schema(joined.select(F.concat_ws(":", "conv_id", "part").alias("response_id"), body.alias("body")))
    return found.select("response_id", F.array_join("problems", ",").alias("problems"))
