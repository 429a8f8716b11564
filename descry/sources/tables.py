"""Gates and views on tables of any source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.functions import predicates as P


def size_gate(
    df: DataFrame, *, max_rows: int | None = None, max_columns: int | None = None, max_cells: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Size contract of a table: check, limit, actual, passed. No limit means always passed.

    Rows come from one count (file footers where the source has them). Bytes are the sizes of the files read and
    are checked only when asked for.
    """
    width = len(df.columns)
    rows = F.col("rows")
    checks = [("rows", max_rows, rows), ("columns", max_columns, F.lit(width)), ("cells", max_cells, rows * F.lit(width))]
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    if max_bytes is not None:
        files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
        total = files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).scalar()
        checks.append(("bytes", max_bytes, total))
    structs = [
        F.struct(
            F.lit(name).alias("check"), F.lit(limit).cast("bigint").alias("limit"), actual.cast("bigint").alias("actual"),
            (F.lit(True) if limit is None else actual <= F.lit(limit)).alias("passed"),
        )
        for name, limit, actual in checks
    ]
    return counted.select(F.inline(F.array(*structs)))


def trim_trailing_blank(df: DataFrame, order_by: str) -> DataFrame:
    """Drop blank records after the last filled one; blank records in between stay.

    A record is blank when all its columns but ``order_by`` are missing or empty text. The last filled position is a
    one-value scalar subquery, so rows are filtered where they are. Filled records stay whatever their order value; blank ones without one go.
    """
    filled = F.lit(False)
    for field in df.schema.fields:
        if field.name != order_by:
            has_value = P.present(P.ref(field.name), field.dataType)
            if isinstance(field.dataType, T.StringType):
                has_value = has_value & (P.ref(field.name) != "")
            filled = filled | has_value
    last = df.where(filled).agg(F.max(P.ref(order_by))).scalar()
    return df.where(filled | (P.ref(order_by) <= last))


def preview(df: DataFrame, order_by: Sequence[str] = (), rows: int = 20) -> DataFrame:
    """The first rows, by the given order if there is one (each task keeps only its own first rows)."""
    return (df.orderBy(*[P.ref(name) for name in order_by]) if order_by else df).limit(rows)
