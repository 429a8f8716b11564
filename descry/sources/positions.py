"""Where a row stands in the files it was read from, as a key that compares in file order.

Spark tables have no order of their own, but rows of files have: by file, and in the file by row. Parquet readers tell the
row's number in its file. Text readers tell where the part of the file begins that a task reads; inside such a part rows
come one after the other, and ``monotonically_increasing_id`` grows along them. Either way the smallest key of a group is
its first row, however the files are split and packed into tasks.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known_of_files(df: DataFrame) -> list[str]:
    """What the table still knows of the files that its rows come from."""
    if not df.inputFiles():
        return []
    try:
        return df.select("_metadata").schema[0].dataType.fieldNames()
    except AnalysisException:  # a union, an aggregate, or two sources
        return []


def _keeps_order(df: DataFrame) -> bool:
    """Whether no step between the files and this table moves rows between tasks, by the plan that EXPLAIN prints."""
    view = f"positions_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        plan = df.sparkSession.sql(f"EXPLAIN SELECT * FROM {view}").head()[0]
    finally:
        df.sparkSession.catalog.dropTempView(view)
    return not any(step in plan for step in ("Exchange", "Join", "Sort", "Aggregate", "Window", "InMemoryTableScan"))


def row_position(df: DataFrame) -> Column | None:
    """Key (file, block, row) of each row's place; None where the table does not come row by row from files.

    Parquet keeps its row numbers through any filter, projection or shuffle. For text formats the key holds only as long as
    rows have not been moved between tasks, so a table that was shuffled or cached has none. Neither have unions, joins and
    aggregates, which mix rows of several places. With several files the order is that of their paths.
    """
    path, known = F.col("_metadata.file_path").alias("file"), _known_of_files(df)
    if "row_index" in known:
        return F.struct(path, F.lit(0).cast("bigint").alias("block"), F.col("_metadata.row_index").alias("row"))
    if "file_block_start" in known and _keeps_order(df):
        return F.struct(path, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return None
