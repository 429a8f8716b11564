"""Evidence facts: one row per stated result, its sentence, small-cell suppression and the shared payload.

Facts are built from result tables that have at most a few rows per column of the analysed table. The operators on
facts (sentences, suppression, payload) also take tables of facts from many reports, keyed by ``report_id``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from descry import wording
from descry.functions import sqltext as Q
from descry.functions.wide import literal_table

# Smallest cell that may be shared, facts per payload.
SMALL_CELL = 5
PAYLOAD_FACTS = 30
PLACEHOLDER = r"\{([a-z]+)\}"


def templates(spark: SparkSession) -> DataFrame:
    """language, key, template: every sentence template."""
    return _literal_table(spark, wording.SENTENCES, "template")


#: Families of labels; keys such as ``group`` mean different things in different families.
LABEL_FAMILIES = {"label": wording.LABELS, "role": wording.ROLE_LABELS, "setting": wording.SETTING_LABELS}


def labels(spark: SparkSession, family: str = "label") -> DataFrame:
    """language, key, text of one family: table labels, role names or setting names."""
    return _literal_table(spark, LABEL_FAMILIES[family], "text")


def _literal_table(spark: SparkSession, table: Mapping[str, Mapping[str, str]], name: str) -> DataFrame:
    rows = [
        {"language": language, "key": key, name: value} for language, texts in table.items() for key, value in texts.items()
    ]
    return literal_table(spark, rows, f"language string, key string, {name} string")


def look_up(requests: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Add ``value`` for each (language, key): that language's text, else the English one, else the key itself.

    ``table`` is one of the wording tables above or one of the caller; Spark decides by its size how to join.
    """
    own = table.select("language", "key", F.col(value).alias("_own"))
    english = table.where(F.col("language") == "en").select("key", F.col(value).alias("_english"))
    return (
        requests.join(own, ["language", "key"], "left")
        .join(english, "key", "left")
        .withColumn(value, F.coalesce("_own", "_english", "key"))
        .drop("_own", "_english")
    )


def filled(template: Column, texts: Column) -> Column:
    """Replace every ``{name}`` by its entry of a map column, in one pass."""
    pieces = F.split(template, PLACEHOLDER, -1)
    names = F.concat(F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1)), F.array(F.lit("")))
    return F.array_join(
        F.zip_with(pieces, names, lambda piece, name: F.concat(piece, F.coalesce(F.try_element_at(texts, name), F.lit("")))), ""
    )


def _map(values: Mapping[str, str], type_: str) -> str:
    return "map(" + ", ".join(f"'{key}', CAST({value} AS {type_})" for key, value in values.items()) + ")"


def _fact(
    order: str, id_: str, kind: str, template: str, texts: Mapping[str, str], values: Mapping[str, str], denominator: str, *,
    variables: str | None = None, direction: str = "CAST(NULL AS STRING)", codes: str | None = None,
) -> list[str]:
    none = "CAST(array() AS ARRAY<STRING>)"
    return [
        f"CAST({order} AS BIGINT) AS ordinal", f"{id_} AS id", f"'{kind}' AS kind", f"{variables or none} AS variable_ids",
        f"{none} AS group_labels", f"CAST({denominator} AS BIGINT) AS denominator", f"{_map(values, 'DOUBLE')} AS values",
        f"{Q.quoted(wording.FACT_METHODS[kind])} AS method", f"{direction} AS direction",
        f"{codes or none} AS allowed_interpretation_codes", f"{template} AS template_key", f"{_map(texts, 'STRING')} AS texts",
    ]


_STATISTICS = ("mean", "sd", "median", "min", "max")


def dataset_fact(profiled: DataFrame) -> DataFrame:
    size = profiled.selectExpr("coalesce(max(missing + nonmissing), 0L) AS rows", "count(1) AS columns")
    texts = {"rows": Q.count_text("rows"), "columns": Q.count_text("columns")}
    values = {"rows": "rows", "columns": "columns"}
    return size.selectExpr(*_fact("0", "'dataset_size'", "dataset", "'dataset'", texts, values, "rows"))


def missing_facts(profiled: DataFrame, units: Mapping[str, str] | None = None) -> DataFrame:
    """One fact per column with missing values."""
    share = Q.percent("missing", "missing + nonmissing")
    texts = {"label": Q.display_label("label", units), "missing": Q.count_text("missing"), "percent": Q.percent_text(share)}
    return profiled.where("missing > 0").selectExpr(
        *_fact(
            "1000 + position", "concat('missing_', column_id)", "missingness", "'missing'", texts,
            {"missing_n": "missing", "percent": share}, "missing + nonmissing", variables="array(column_id)",
        )
    )


def numeric_facts(summary: DataFrame, column_ids: Mapping[str, str], units: Mapping[str, str] | None = None) -> DataFrame:
    """One fact per row of a numeric profile."""
    names = dict(zip(_STATISTICS, ("mean", "sd", "median", "minimum", "maximum")))
    texts = {"label": Q.display_label("variable", units), "n": Q.count_text("n")}
    texts |= {text: Q.statistic_text(name) for name, text in names.items()}
    values = {name: name for name in ("n", "missing_count", "nonfinite_count", *_STATISTICS)}
    return summary.selectExpr("*", f"{Q.choice('variable', column_ids)} AS column_id").selectExpr(
        *_fact(
            "2000 + position", "concat('numeric_', column_id)", "numeric_descriptive", "'numeric'", texts, values, "n",
            variables="array(column_id)",
        )
    )


def difference_fact(effect: DataFrame, valid_n: int) -> DataFrame:
    """The fact of a defined Cohen's d; ``effect`` is the row of ``cohens_d``."""
    direction = Q.filled(wording.sentence("en", "direction"), {"first": "group_1", "second": "group_2"})
    texts = {
        "direction": direction, "difference": Q.statistic_text("mean_difference"), "effect": Q.statistic_text("cohens_d"),
    }
    values = {"mean_difference": "mean_difference", "cohens_d": "cohens_d"}
    return effect.where("reason IS NULL").selectExpr(
        *_fact(
            "3000", "'group_difference_1'", "group_difference", "'effect'", texts, values, str(valid_n), direction=direction,
            codes="array('describe_direction')",
        )
    )


def relationship_fact(relationship: DataFrame) -> DataFrame:
    texts = {"first": "first", "second": "second", "n": Q.count_text("n"), "r": Q.statistic_text("r"), "reason": "reason"}
    return relationship.selectExpr(
        *_fact(
            "3000", "'relationship_1'", "relationship", "IF(r IS NULL, 'relationship_unavailable', 'relationship')", texts,
            {"r": "r", "pairwise_n": "n"}, "n", codes="IF(r IS NULL, CAST(array() AS ARRAY<STRING>), array('linear_association'))",
        )
    )


def change_fact(change: DataFrame) -> DataFrame:
    """The fact of a paired change; ``change`` has the three rows of ``paired_change_statistics``."""
    names = ("mean", "sd", "median")
    texts = {"n": Q.count_text("n")} | {name: Q.statistic_text(name) for name in names}
    return change.where("measure = 'change'").selectExpr(
        *_fact(
            "3000", "'change_1'", "paired_change", "'change'", texts, {"paired_n": "n"} | {name: name for name in names}, "n",
            direction="'post_minus_pre'", codes="array('describe_direction')",
        )
    )


def time_fact(coverage: DataFrame) -> DataFrame:
    return coverage.selectExpr(
        *_fact(
            "3000", "'time_1'", "date_series", "'time'", {"n": Q.count_text("valid_n")}, {"valid_n": "valid_n", "dates": "dates"},
            "valid_n",
        )
    )


def with_sentences(facts: DataFrame, languages: Sequence[str] = wording.LANGUAGES) -> DataFrame:
    """One row per fact and language with the localized sentence; the template table has under a hundred rows."""
    wanted = templates(facts.sparkSession).where(F.col("language").isin(*languages)).withColumnRenamed("key", "template_key")
    return (
        facts.join(F.broadcast(wanted), "template_key")
        .withColumn("sentence", filled(F.col("template"), F.col("texts")))
        .drop("template", "template_key", "texts")
    )


def range_sentences(
    violations: DataFrame, language: str = "en", units: Mapping[str, str] | None = None
) -> DataFrame:
    """One sentence per column with values outside the supplied range."""
    texts = {
        "label": Q.display_label("variable", units), "count": Q.count_text("outside_n"),
        "minimum": f"IF(minimum IS NULL, '−∞', {Q.statistic_text('minimum')})",
        "maximum": f"IF(maximum IS NULL, '∞', {Q.statistic_text('maximum')})",
    }
    return violations.where("outside_n > 0").selectExpr(
        "variable", f"{Q.filled(wording.sentence(language, 'range_finding'), texts)} AS sentence"
    )


def shareable() -> Column:
    """Whether a fact may be shared: no denominator below 5 and no count under a name ending in ``_n`` below 5."""
    small_value = F.exists(
        F.map_entries("values"),
        lambda entry: F.endswith(entry["key"], F.lit("_n")) & F.coalesce(entry["value"] < SMALL_CELL, F.lit(False)),
    )
    small_denominator = F.coalesce(F.col("denominator") < SMALL_CELL, F.lit(False))
    return ~(small_denominator | F.coalesce(small_value, F.lit(False)))


def suppress_small_cells(facts: DataFrame) -> DataFrame:
    return facts.where(shareable())


def fact_payload(facts: DataFrame, *, share_labels: bool = False, limit: int = PAYLOAD_FACTS) -> DataFrame:
    """The first 30 shareable facts of every report, reduced to id, token, binding, kind and codes.

    ``facts`` needs a ``report_id``. The binding is the id, or the sentence when labels may be shared. Only the
    first facts of each task reach the shuffle.
    """
    order = Window.partitionBy("report_id").orderBy("ordinal", "id")
    return (
        suppress_small_cells(facts)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select(
            "report_id", "rank", "id",
            F.concat(F.lit("[[FACT:"), F.col("id"), F.lit("]]")).alias("token"),
            F.col("sentence" if share_labels else "id").alias("binding"),
            "kind", "allowed_interpretation_codes",
        )
    )


def payload_json(
    payload: DataFrame, *, language: str, audience: str, depth: str, study_context: str = "", share_labels: bool = False
) -> DataFrame:
    """One JSON document per report with its at most 30 facts; context only when labels may be shared."""
    fact = F.struct("rank", "id", "token", "binding", "kind", "allowed_interpretation_codes")
    context = study_context if share_labels else ""
    return (
        payload.groupBy("report_id")
        .agg(F.array_sort(F.collect_list(fact)).alias("facts"))
        .select(
            "report_id",
            F.to_json(
                F.struct(
                    F.lit(language).alias("language"), F.lit(audience).alias("audience"), F.lit(depth).alias("depth"),
                    F.lit(context).alias("study_context"), F.transform("facts", lambda f: f.dropFields("rank")).alias("facts"),
                )
            ).alias("payload"),
        )
    )
