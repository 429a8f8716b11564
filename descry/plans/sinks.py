"""Writing results: Parquet and JSON without NaN or infinity, and reuse of unchanged results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.errors import AnalysisError
from descry.functions import predicates as P
from descry.session import scratch_path

#: One line per version of a store.
_INDEX = "number bigint, version string, names array<string>, format string"


def _safe(column: Column, dtype: T.DataType) -> Column:
    if P.is_floating(dtype):
        return F.when(F.abs(column) < F.lit(P.INFINITY), column)
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda item: _safe(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(column, lambda _, value: _safe(value, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [_safe(column[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def json_safe(df: DataFrame) -> DataFrame:
    """NULL in place of NaN and infinity, at any depth."""
    return df.select(*[_safe(P.ref(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def result_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*[P.ref(name) for name in safe.columns]), {"ignoreNullFields": "false"}).alias("json"))


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version that a store's index names last; None where there is no index."""
    try:
        index = spark.read.schema(_INDEX).parquet(f"{folder}/_index")
    except AnalysisException:
        return None
    last = index.orderBy(F.col("number").desc(), F.col("version").desc()).head()
    return None if last is None else last["version"]


def publish_version(
    spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], *, format: str = "parquet", mode: str = "overwrite"
) -> str:
    """Write all tables to a version of their own and only then name it in the index: all or nothing.

    Until the index has its new line, which is one file that Spark moves into place, readers see the version before. Of
    two writers at a time the last one wins with all its tables. Old versions stay until they are removed.
    """
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.mode(mode).format(format).save(f"{folder}/{version}/{name}")
    try:
        before = spark.read.schema(_INDEX).parquet(f"{folder}/_index").agg(F.max("number")).head()[0] or 0
    except AnalysisException:
        before = 0
    line = spark.createDataFrame([(before + 1, version, sorted(tables), format)], _INDEX)
    line.coalesce(1).write.mode("append").parquet(f"{folder}/_index")
    return version


def write_results(results: Mapping[str, DataFrame], folder: str, *, format: str = "parquet", mode: str = "overwrite") -> None:
    """Write every result table below ``folder``, JSON-safe, all or nothing (``publish_version``)."""
    tables = {name: json_safe(table) for name, table in results.items()}
    if tables:
        publish_version(next(iter(tables.values())).sparkSession, folder, tables, format=format, mode=mode)


def read_results(spark: SparkSession, folder: str, names: list[str] | None = None, *, format: str | None = None) -> dict[str, DataFrame]:
    """The tables of the last whole set that was written to ``folder``; by default all of them, in the format they have."""
    version = current_version(spark, folder)
    if version is None:
        raise AnalysisError(f"There are no results in {folder}.")
    stored = spark.read.schema(_INDEX).parquet(f"{folder}/_index").where(F.col("version") == version).head()
    return {name: spark.read.format(format or stored["format"]).load(f"{folder}/{version}/{name}") for name in (stored["names"] if names is None else names)}


def materialized(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder, for inputs that are costly to compute: a report scans it often."""
    path = scratch_path(df.sparkSession, "input")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def reuse_or_compute(
    spark: SparkSession, fingerprint: DataFrame, folder: str, compute: Callable[[], Mapping[str, DataFrame]]
) -> dict[str, DataFrame]:
    """Results stored for this fingerprint, computed and written first if there are none."""
    target = f"{folder}/{fingerprint.head()['fingerprint']}"
    if current_version(spark, target) is None:  # a run that was cut off has no version and is repeated
        write_results(compute(), target)
    return read_results(spark, target)
