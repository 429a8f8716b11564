"""Registration of queries, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, its expected result."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(name: str, digits: int = 6, alias: str | None = None) -> Column:
    return F.round(F.col(name), digits).alias(alias or name)


_DIRTY = """
WITH base AS (
  SELECT event_id, ts, user_id,
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 23 = 0 THEN NULL
         WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE)
         WHEN event_id % 89 = 0 THEN CAST('NaN' AS DOUBLE)
         ELSE value END AS value,
    CASE WHEN event_id % 29 = 0 THEN NULL
         ELSE value * CAST(1.1 AS DOUBLE) + (event_id % 7) END AS post_value
  FROM {events})
SELECT * FROM base UNION ALL SELECT * FROM base WHERE event_id % 50 = 0
"""

#: The events with missing, NaN, infinite and duplicated entries, as a SQL prefix for the expected results.
DIRTY_SQL = f"WITH dirty AS ({_DIRTY.format(events='events')}), finite AS (SELECT *, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN NULL ELSE value END AS fv FROM dirty)"


def events_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """The same table in Spark."""
    return spark.sql(_DIRTY, events=table(spark, folder, "events"))


ISO_DATE_SQL = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T].*)?$"
ID_NAME_SQL = r"(^|[_\s-])(id|identifier|participant.?id|record.?id|case.?id)($|[_\s-])"


def profile_sql(source: str, columns: dict[str, str], overrides: dict[str, str] | None = None) -> str:
    """A SELECT with one row per column of ``source``: counts, role, uncertainty. Kinds: real, whole, text, instant."""
    overrides = overrides or {}
    parts = []
    for i, (name, kind) in enumerate(columns.items(), 1):
        value = f'CASE WHEN isnan("{name}") THEN NULL ELSE "{name}" END' if kind == "real" else f'"{name}"'
        nonfinite = f"count(*) FILTER (WHERE isinf({value}))" if kind == "real" else "0"
        whole = "true"
        if kind == "real":
            whole = (
                f"coalesce(bool_and(CASE WHEN v IS NULL THEN NULL WHEN isinf(v) THEN false ELSE v - floor(v) <= 1e-8 END), true)"
            )
        iso = f"count(*) FILTER (WHERE regexp_full_match(trim(v), '{ISO_DATE_SQL}'))" if kind == "text" else "0"
        nonfinite = nonfinite.replace(value, "v")
        override = f"'{overrides[name]}'" if name in overrides else "NULL"
        parts.append(
            f"SELECT {i} AS position, 'c{i:03d}' AS column_id, '{name}' AS label, '{kind}' AS kind, {override} AS forced, "
            f"count(v) AS nonmissing, count(DISTINCT v) AS uniq, count(*) - count(v) AS missing, {nonfinite} AS nonfinite, "
            f"{whole} AS whole, {iso} AS iso FROM (SELECT {value} AS v FROM {source})"
        )
    return f"""
    SELECT position, column_id, label, kind, nonmissing, uniq AS unique_nonmissing, missing, nonfinite, role,
      forced IS NULL AND ((kind IN ('real','whole') AND role = 'ordinal') OR (kind = 'text' AND role = 'date')) AS role_uncertain
    FROM (SELECT *, coalesce(forced, CASE
        WHEN kind = 'instant' THEN 'date'
        WHEN kind IN ('real','whole') THEN CASE
          WHEN idname AND uniq >= greatest(2, CAST(floor(nonmissing * CAST(0.8 AS DOUBLE)) AS BIGINT)) THEN 'identifier'
          WHEN uniq <= 10 AND nonmissing >= 5 AND whole THEN 'ordinal' ELSE 'numeric' END
        WHEN nonmissing >= 2 AND iso / CAST(greatest(1, nonmissing) AS DOUBLE) >= 0.9 THEN 'date'
        WHEN idname AND uniq / CAST(greatest(1, nonmissing) AS DOUBLE) >= 0.8 THEN 'identifier'
        WHEN uniq <= 20 OR uniq / CAST(greatest(1, nonmissing) AS DOUBLE) <= 0.2 THEN 'categorical'
        ELSE 'text' END) AS role
      FROM (SELECT *, regexp_matches(lower(label), '{ID_NAME_SQL}') AS idname FROM ({' UNION ALL '.join(parts)})))
    """


DIRTY_KINDS = {
    "event_id": "whole", "ts": "instant", "user_id": "whole", "event_type": "text", "value": "real", "post_value": "real",
}
KINDS = {
    "lineitem": {
        "l_orderkey": "whole", "l_partkey": "whole", "l_suppkey": "whole", "l_linenumber": "whole", "l_quantity": "real",
        "l_extendedprice": "real", "l_discount": "real", "l_tax": "real", "l_returnflag": "text", "l_linestatus": "text",
        "l_shipdate": "instant",
    },
    "orders": {
        "o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_totalprice": "real", "o_orderdate": "instant",
        "o_orderpriority": "text",
    },
    "events": {"event_id": "whole", "ts": "instant", "user_id": "whole", "event_type": "text", "value": "real", "props": "text"},
    "part": {
        "p_partkey": "whole", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "whole", "p_retailprice": "real",
    },
    "documents": {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"},
    "labels": {"doc_id": "whole", "quality": "whole", "toxic": "whole"},
    "customer": {
        "c_custkey": "whole", "c_name": "text", "c_nationkey": "whole", "c_acctbal": "real", "c_mktsegment": "text",
    },
    "conversations": {"conv_id": "whole", "turn": "whole", "role": "text", "text": "text"},
}


def dirty_profile_sql(overrides: dict[str, str] | None = None) -> str:
    """CTE prefix with ``profiled``: the profile of the dirty events."""
    return f"{DIRTY_SQL}, profiled AS ({profile_sql('dirty', DIRTY_KINDS, overrides)})"


#: SQL text of a statistic or percentage, as printed in reports.
def statistic_sql(value: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL THEN '—' WHEN {value} <> 0 AND abs({value}) < 0.01 THEN printf('%.3e', {value}) "
        f"ELSE printf('%.2f', {value}) END"
    )
