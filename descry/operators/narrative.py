"""Checks of written narratives against the facts they cite, for tables of narratives from many reports.

Narrative blocks: ``response_id, report_id, language, block_no, section_id, fact_ids, interpretation_code, prose``.
Facts: at least ``report_id, id`` and, per operator, ``sentence`` or ``allowed_interpretation_codes``.

A popular report may own a third of all blocks, so every look-up of facts spreads each (report, fact) key over salts
on the narrative side and repeats the small fact row per salt. Only ids travel in these joins, never prose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry import wording
from descry.functions import text

SALTS = 16

# Limits of a response.
MAX_BLOCKS = 8
MAX_FACT_IDS = 30
MAX_PROSE = 3_000
RESPONSE_FIELDS = ["language", "blocks"]
BLOCK_FIELDS = ["section_id", "fact_ids", "interpretation_code", "prose"]


def _look_up_facts(references: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Left-join facts to (report_id, ref) references, salted against hot reports; adds ``_known`` and the columns."""
    salted = references.withColumn("_salt", F.pmod(F.xxhash64("response_id", "block_no"), F.lit(SALTS)).cast("int"))
    repeated = facts.select(
        "report_id", F.col("id").alias("ref"), *columns, F.lit(True).alias("_known"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    return (
        salted.join(repeated, ["report_id", "ref", "_salt"], "left")
        .withColumn("_known", F.coalesce("_known", F.lit(False)))
        .drop("_salt")
    )


def fact_token_table(blocks: DataFrame) -> DataFrame:
    """One row per fact token of a block with its place."""
    return blocks.select("response_id", "block_no", F.posexplode(text.fact_tokens(F.col("prose")))).select(
        "response_id", "block_no", (F.col("pos") + 1).alias("token_no"), F.col("col").alias("fact_id")
    )


def _references(blocks: DataFrame) -> DataFrame:
    """Distinct fact ids a block cites, by token or in its list; ``listed`` tells the latter."""
    tokens = F.transform(text.fact_tokens(F.col("prose")), lambda t: F.struct(t.alias("ref"), F.lit(False).alias("listed")))
    listed = F.transform(
        F.coalesce("fact_ids", F.array().cast("array<string>")), lambda t: F.struct(t.alias("ref"), F.lit(True).alias("listed"))
    )
    return blocks.where(~text.is_blank(F.col("prose"))).select(
        "response_id", "report_id", "block_no", "interpretation_code",
        F.inline(F.array_distinct(F.concat(tokens, listed))),
    )


def unknown_facts(blocks: DataFrame, facts: DataFrame) -> DataFrame:
    """Cited fact ids that the report does not have: response_id, block_no, fact_id."""
    cited = _references(blocks).select("response_id", "report_id", "block_no", "ref").distinct()
    return _look_up_facts(cited, facts, []).where(~F.col("_known")).select(
        "response_id", "block_no", F.col("ref").alias("fact_id")
    )


def is_unresolved(prose: Column) -> Column:
    """A token was opened but none is well-formed."""
    return F.contains(prose, F.lit(text.FACT_TOKEN_START)) & (F.size(text.fact_tokens(prose)) == 0)


def has_broken_token(prose: Column) -> Column:
    """A token was opened and not completed, even beside good ones (reported, not part of the verdict)."""
    return F.contains(text.without_fact_tokens(prose), F.lit(text.FACT_TOKEN_START))


def uses_banned_term(prose: Column, language: Column) -> Column:
    """The text outside fact tokens holds a term that is banned in the language."""
    folded = text.fold(text.without_fact_tokens(prose))
    by_language = F.create_map(
        *[part for code, terms in wording.BANNED_TERMS.items() for part in (F.lit(code), F.array(*[F.lit(t.casefold()) for t in terms]))]
    )
    return F.coalesce(
        F.exists(F.try_element_at(by_language, language), lambda term: F.contains(folded, term)), F.lit(False)
    )


def block_errors(blocks: DataFrame, expected_language: Column) -> DataFrame:
    """Errors that a block shows by itself, as an array column ``errors``; no join and no shuffle."""
    prose = F.col("prose")
    empty = text.is_blank(prose)

    def flag(condition: Column, code: str) -> Column:
        return F.when(condition, F.lit(code))

    return blocks.withColumn(
        "errors",
        F.array_compact(
            F.array(
                flag(~F.col("language").eqNullSafe(expected_language), "wrong_language"),
                flag(empty, "empty_prose"),
                flag(~empty & is_unresolved(prose), "unresolved_token"),
                flag(~empty & text.has_literal_number(prose), "literal_quantitative_claim"),
                flag(~empty & uses_banned_term(prose, expected_language), "unsupported_claim"),
            )
        ),
    )


def validate_narratives(blocks: DataFrame, facts: DataFrame, expected_language: str | Column) -> DataFrame:
    """Verdict per response: sorted distinct error codes, valid when there is none.

    ``expected_language`` is the requested language, a code or a column of ``blocks``.
    """
    language = F.lit(expected_language) if isinstance(expected_language, str) else expected_language
    code = F.col("interpretation_code")
    has_code = F.coalesce(code != "", F.lit(False))
    # A code without any citation can never be allowed.
    cites = (F.size(text.fact_tokens(F.col("prose"))) > 0) | (F.coalesce(F.size("fact_ids"), F.lit(0)) > 0)
    uncited = F.when(has_code & ~cites & ~text.is_blank(F.col("prose")), F.lit("unsupported_interpretation"))
    own = block_errors(blocks, language).select(
        "response_id", F.explode_outer(F.array_compact(F.array_append("errors", uncited))).alias("code")
    )

    cited = _look_up_facts(_references(blocks), facts, ["allowed_interpretation_codes"])
    allowed = F.coalesce(F.col("listed") & F.array_contains("allowed_interpretation_codes", code), F.lit(False))
    checked = cited.groupBy("response_id", "block_no").agg(
        F.bool_or(~F.col("_known")).alias("unknown"), F.bool_or(has_code & ~allowed).alias("_asks"),
        F.bool_or(allowed).alias("allowed"),
    )
    by_reference = checked.select(
        "response_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("unknown"), F.lit("unknown_fact")),
                    F.when(F.col("_asks") & ~F.col("allowed"), F.lit("unsupported_interpretation")),
                )
            )
        ).alias("code"),
    )
    return (
        own.unionByName(by_reference)
        .groupBy("response_id")
        .agg(F.array_sort(F.collect_set("code")).alias("errors"))
        .withColumn("valid", F.size("errors") == 0)
    )


def expand_fact_tokens(blocks: DataFrame, facts: DataFrame) -> DataFrame:
    """Replace every fact token by the sentence of its fact (unknown facts vanish): response_id, block_no, text.

    Tokens are looked up one by one and the pieces put back in order; inserted text is never expanded again.
    """
    prose = F.coalesce("prose", F.lit(""))  # a block without prose stays, with an empty text
    pieces = F.split(prose, text.FACT_TOKEN, -1)
    tokens = text.fact_tokens(prose)
    parts = F.transform(
        pieces,
        lambda piece, i: F.struct(
            i.alias("pos"), piece.alias("before"), F.try_element_at(tokens, i + 1).alias("ref")
        ),
    )
    exploded = blocks.select("response_id", "report_id", "block_no", F.inline(parts))
    with_token = exploded.where(F.col("ref").isNotNull())
    # Only the ids of tokens are joined; the pieces of text stay where the block is put together again.
    found = _look_up_facts(with_token.drop("before"), facts, ["sentence"]).select(
        "response_id", "block_no", (F.col("pos") * 2 + 1).alias("pos"), F.coalesce("sentence", F.lit("")).alias("piece")
    )
    plain = exploded.select("response_id", "block_no", (F.col("pos") * 2).alias("pos"), F.col("before").alias("piece"))
    return (
        plain.unionByName(found)
        .groupBy("response_id", "block_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"))
        .select("response_id", "block_no", F.array_join(F.col("pieces.piece"), "").alias("text"))
    )


def check_response_schema(responses: DataFrame) -> DataFrame:
    """Structural problems of raw JSON responses (``response_id``, ``body``): an array ``problems`` per response.

    Checked: one JSON object and nothing after it, no unknown fields, a known language, 1 to 8 blocks, required block
    fields, JSON types (texts, lists of texts; ``interpretation_code`` may be null), at most 30 fact ids and 3,000 characters
    of prose per block. A body with a repeated field is no object.
    """
    # Parsing stops behind the first value: only a body that is one value is one element of a list and one field.
    alone = F.try_parse_json(F.concat(F.lit("["), "body", F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"body":'), "body", F.lit("}")))
    one = F.coalesce(F.size(F.try_variant_get(alone, "$", "array<variant>")) == 1, F.lit(False)) & field.isNotNull()

    def part(value: Column, name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "variant")

    def kind(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value), F.lit("absent"))

    def elements(value: Column) -> Column:
        return F.when(kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))

    def is_kind(value: Column, *kinds: str) -> Column:
        return kind(value).isin(*kinds)

    body, blocks = F.col("_body"), F.col("_blocks")
    root = F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>"))

    def some(condition) -> Column:
        return F.coalesce(F.exists(blocks, condition), F.lit(False))

    def wrong_type(block: Column) -> Column:
        listed = part(block, "fact_ids")
        return (
            ~kind(block).startswith("OBJECT") | ~is_kind(part(block, "section_id"), "STRING", "absent")
            | ~is_kind(part(block, "prose"), "STRING", "absent")
            | ~is_kind(part(block, "interpretation_code"), "STRING", "VOID", "absent")
            | ~(is_kind(listed, "absent") | kind(listed).startswith("ARRAY"))
            | F.coalesce(F.exists(elements(listed), lambda item: ~is_kind(item, "STRING")), F.lit(False))
        )

    def extra(block: Column) -> Column:
        fields = F.json_object_keys(F.to_json(block))
        return F.coalesce(F.size(F.array_except(fields, known)) > 0, F.lit(False))

    def length(block: Column) -> Column:
        return F.length(F.try_variant_get(block, "$.prose", "string"))

    known = F.array(*[F.lit(name) for name in BLOCK_FIELDS])
    extra_in_root = F.size(F.array_except(root, F.array(*[F.lit(n) for n in RESPONSE_FIELDS]))) > 0
    count = F.coalesce(F.size(blocks), F.lit(-1))
    ok = one & F.coalesce(kind(body).startswith("OBJECT"), F.lit(False))
    language = F.when(is_kind(part(body, "language"), "STRING"), F.try_variant_get(body, "$.language", "string"))

    def flag(condition: Column, code: str) -> Column:
        return F.when(ok & F.coalesce(condition, F.lit(False)), F.lit(code))

    problems = F.array_sort(
        F.array_compact(
            F.array(
                F.when(~ok, F.lit("not_an_object")),
                flag(extra_in_root | some(extra), "unknown_field"),
                flag(~F.coalesce(language, F.lit("")).isin(*wording.LANGUAGES), "unknown_language"),
                flag((count < 1) | (count > MAX_BLOCKS), "block_count"),
                flag(some(lambda b: is_kind(part(b, "section_id"), "absent") | is_kind(part(b, "prose"), "absent")), "missing_field"),
                flag(some(wrong_type), "wrong_type"),
                flag(some(lambda b: F.size(elements(part(b, "fact_ids"))) > MAX_FACT_IDS), "too_many_fact_ids"),
                flag(some(lambda b: length(b) > MAX_PROSE), "prose_too_long"),
            )
        )
    )
    return (
        responses.withColumn("_body", F.try_parse_json("body"))
        .withColumn("_blocks", elements(part(body, "blocks")))
        .select("response_id", problems.alias("problems"))
        .withColumn("conforms", F.size("problems") == 0)
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Narrative blocks of raw JSON responses (``response_id``, ``report_id``, ``body``)."""
    parsed = F.from_json(
        F.col("body"),
        "language STRING, blocks ARRAY<STRUCT<section_id: STRING, fact_ids: ARRAY<STRING>, "
        "interpretation_code: STRING, prose: STRING>>",
    )
    return (
        responses.withColumn("_parsed", parsed)
        .select("response_id", "report_id", F.col("_parsed.language").alias("language"), F.posexplode("_parsed.blocks"))
        .select(
            "response_id", "report_id", "language", (F.col("pos") + 1).alias("block_no"), "col.section_id",
            F.coalesce("col.fact_ids", F.array().cast("array<string>")).alias("fact_ids"),
            "col.interpretation_code", "col.prose",
        )
    )
