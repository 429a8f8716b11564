"""One output row per column from one aggregate over the table, and small fixed tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns aggregated together; wider tables take one scan per this many columns, so that the generated code of an
#: aggregate stays below the size the JVM compiles.
COLUMNS_PER_AGGREGATE = 50


def aggregate_rows(df: DataFrame, rows: Sequence[str]) -> DataFrame:
    """Each of ``rows`` is the SQL of a struct of aggregates; the result has one row per struct."""
    parts = [rows[i : i + COLUMNS_PER_AGGREGATE] for i in range(0, len(rows), COLUMNS_PER_AGGREGATE)]
    frames = [df.agg(F.expr(f"array({', '.join(part)})").alias("rows")).selectExpr("inline(rows)") for part in parts]
    return reduce(DataFrame.unionByName, frames)


def entries(df: DataFrame, rows: Sequence[str]) -> DataFrame:
    """One row per table row and struct: the long form of selected columns."""
    return df.selectExpr(f"inline(array({', '.join(rows)}))")


def literal_table(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A small fixed table inside the plan."""
    text = F.lit(json.dumps(list(rows), ensure_ascii=False))
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))
