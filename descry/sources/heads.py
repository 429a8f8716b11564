"""The first lines of many files without reading the files: each task opens its files, takes a bounded head and stops.

Spark's text source always reads a file to its end. Here Spark lists the files, which costs no content, deals them to tasks,
and a task reads each of its files only until it has the lines, 64 KB at a time and ``LIMIT`` bytes at most. Files of stores
that the tasks cannot open themselves are read as lines by Spark, to the same result.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes read at a time and at most; bytes looked at for NUL; stores that pyarrow opens.
CHUNK, LIMIT, SNIFFED_BYTES = 1 << 16, 1 << 20, 4096
OPENED = ("file", "hdfs", "s3", "gs")
_BREAK = re.compile("\r\n|\r|\n")
_BOM = "\ufeff"
#: The encodings that Spark's readers take by themselves.
_SPARK_ENCODINGS = ("utf-8", "us-ascii", "ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32")
_SCHEMA = "file string, size bigint, lines array<string>, has_nul boolean, cut boolean"


def spark_encoding(encoding: str) -> str:
    """The encoding itself where Spark reads it; else one that passes bytes on unchanged, to be decoded afterwards.

    Such an encoding must keep ASCII as it is and have no separator, quote or line break inside other characters, as do
    GB18030, GBK, Big5, Shift JIS, EUC and the one-byte code pages.
    """
    if encoding.lower() in _SPARK_ENCODINGS:
        return encoding
    marks = ',;\t"\r\n'
    if marks.encode(encoding) != marks.encode("ascii"):
        raise ValueError(f"Text in {encoding} cannot be cut into lines before it is decoded.")
    return "ISO-8859-1"


def redecoded(value: str | None, encoding: str) -> str | None:
    """A text that was read as ISO-8859-1 in its own encoding; bytes that mean nothing become the replacement character."""
    return None if value is None else value.encode("latin-1").decode(encoding, "replace")


def decode_columns(df: DataFrame, encoding: str) -> DataFrame:
    """``df`` with its texts, and those in arrays, decoded where Spark has passed on their bytes."""
    if spark_encoding(encoding) == encoding:
        return df

    def decoded(value):
        return [redecoded(v, encoding) for v in value] if isinstance(value, list) else redecoded(value, encoding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pa.types.is_string(c.type) or pa.types.is_list(c.type) for c in batch.columns]
            columns = [pa.array([decoded(v) for v in c.to_pylist()], c.type) if text else c for c, text in zip(batch.columns, texts)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def _opened(uri: str):
    from pyarrow import fs

    scheme, _, place = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + place.lstrip("/"))
    store, place = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(place)


def _head(uri: str, count: int, encoding: str) -> tuple[list[str], bool, bool]:
    """(lines, NUL among the first bytes, whether the last line is cut off) of one file."""
    decoder = codecs.getincrementaldecoder(encoding)("replace")
    text, read, has_nul, ended = "", 0, False, False
    with _opened(uri) as stream:
        while not ended and read < LIMIT and len(_BREAK.findall(text[:-1])) < count:
            data = stream.read(CHUNK)
            ended = not data
            if not read:
                has_nul = "\0" in codecs.getincrementaldecoder(encoding)("replace").decode(data[:SNIFFED_BYTES])
            read += len(data)
            text += decoder.decode(data, ended)
    lines = _BREAK.split(text.removeprefix(_BOM))
    whole = lines[:-1] if ended and not lines[-1] else lines
    return whole[:count], has_nul, not ended and len(lines) <= count


def _heads(batches: Iterator[pa.RecordBatch], count: int, encoding: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column("file").to_pylist()
        found = [_head(file, count, encoding) if size else ([], False, False) for file, size in zip(files, batch.column("size").to_pylist())]
        columns = [batch.column("file"), batch.column("size"), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "size", "lines", "has_nul", "cut"])


def _by_lines(spark: SparkSession, path: str | list[str], count: int, encoding: str, listed: DataFrame) -> DataFrame:
    """The same through Spark's text source. Every line has a byte, its break, so ``SNIFFED_BYTES`` lines reach far enough."""
    text = spark.read.option("encoding", spark_encoding(encoding)).text(path)
    text = text.select(F.regexp_replace(F.col("_metadata.file_path"), "^([a-z][a-z0-9+.-]*):/+", "$1:/").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("place"))
    order = Window.partitionBy("file").orderBy("place")
    first = text.where("block = 0").withColumn("line_no", F.row_number().over(order)).where(F.col("line_no") <= SNIFFED_BYTES)
    offset = F.coalesce(F.sum(F.octet_length("value") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nul_at = F.locate("\x00", F.col("value"))
    nul = (nul_at > 0) & (F.col("_offset") + nul_at <= SNIFFED_BYTES)
    kept = F.when(F.col("line_no") <= count, F.struct("line_no", "value"))
    heads = first.withColumn("_offset", offset).groupBy("file").agg(F.array_sort(F.collect_list(kept)).alias("kept"), F.bool_or(nul).alias("has_nul"))
    heads = decode_columns(heads.select("file", F.col("kept")["value"].alias("lines"), "has_nul"), encoding)
    plain = F.transform("lines", lambda line: F.regexp_replace(line, "^" + _BOM, ""))
    return listed.join(heads.select("file", plain.alias("lines"), "has_nul"), "file", "left").select(
        "file", "size", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), F.coalesce("has_nul", F.lit(False)).alias("has_nul"), F.lit(False).alias("cut"))


def first_lines(spark: SparkSession, path: str | list[str], count: int, *, encoding: str = "UTF-8", by_spark: bool | None = None) -> DataFrame:
    """Per file: file, size, its first ``count`` lines, has_nul (in the first 4,096 bytes), cut (the last line is not whole).

    Files without any byte have no lines. Of a file ``LIMIT`` bytes are read at most; what lies beyond is cut. ``by_spark``
    chooses the reader: None asks which stores the files lie in.
    """
    source = spark.read.format("binaryFile").load(path)
    listed = source.select(F.regexp_replace("path", "^([a-z][a-z0-9+.-]*):/+", "$1:/").alias("file"), F.col("length").alias("size"))
    if by_spark is None:
        other = listed.where(~F.regexp_extract("file", "^([^:]*):", 1).isin(*OPENED))
        by_spark = bool(other.head(1))
    heads = _by_lines(spark, path, count, encoding, listed) if by_spark else listed.mapInArrow(partial(_heads, count=count, encoding=encoding), _SCHEMA)
    # Spark's scans leave out files without any byte; the listing, which the driver has anyway, names them.
    names = [re.sub("^([a-z][a-z0-9+.-]*):/+", r"\1:/", name) for name in source.inputFiles()]
    if len(names) == listed.count():
        return heads
    named = spark.createDataFrame([(name,) for name in names], "file string")
    nothing = [F.lit(0).cast("bigint").alias("size"), F.array().cast("array<string>").alias("lines"), F.lit(False).alias("has_nul"), F.lit(False).alias("cut")]
    return heads.unionByName(named.join(listed, "file", "left_anti").select("file", *nothing))
