"""What the corpus operators share: Arrow batches cut by size, byte arrays of texts, written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.session import scratch_path

#: White space and words of the word based operators: ASCII only, so that bytes.split() finds the same words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Texts are handed to numpy in slices of about this many bytes; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where its folder is the driver's; elsewhere install it or use --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: str = "text"):
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, whole rows only."""
    values = batch.column(column)
    lengths = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
    for start, end in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def _mapped(batches: Iterator[pa.RecordBatch], setup, state, column: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    handle = setup(state)
    for batch in batches:
        for part in slices(batch, column):
            columns = handle(part)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array)
                                              else columns[f.name].cast(f.type) for f in schema], schema=schema)


def map_texts(docs: DataFrame, setup: Callable, state, fields: list[tuple[str, str, pa.DataType]], column: str = "text") -> DataFrame:
    """Run ``handle = setup(state)`` once per task and ``handle(batch) -> columns`` on slices of the rows.

    ``fields`` are (name, Spark type, Arrow type) of the result. ``state`` is a small picklable value, such as a model.
    """
    schema = pa.schema([(name, kind) for name, _, kind in fields])
    return docs.mapInArrow(partial(_mapped, setup=setup, state=state, column=column, schema=schema),
                           ", ".join(f"`{name}` {kind}" for name, kind, _ in fields))


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as bytes, null as empty."""
    return [value or b"" for value in batch.column(column).cast(pa.binary()).to_pylist()]


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column without a detour over Python objects."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
