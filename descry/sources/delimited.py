"""Delimited text: strict and lenient scans, type inference, and per-file audits of whole directories.

Scans go through Spark's CSV reader with every column as text; types are decided afterwards from counts. Audits
look at text lines, so that they see what the CSV reader would silently drop, pad or cut; those of separators and headers
read only the first lines of a file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.errors import AnalysisError
from descry.functions import predicates as P
from descry.functions import sqltext as Q
from descry.functions import text
from descry.functions.wide import aggregate_rows
from descry.plans.sinks import materialized
from descry.sources.heads import decode_columns, first_lines, redecoded, spark_encoding

# Candidate separators, lines inspected, and the tokens the lenient scan treats as missing.
SEPARATORS = (",", ";", "\t")
DETECTION_LINES = 12
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
BOOLEAN_TOKENS = ("True", "TRUE", "true", "False", "FALSE", "false")

_BOM = "\ufeff"
_QUOTED = r'"(?:[^"]|"")*"'


def check_labels(labels: Sequence[str | None], max_columns: int | None = None) -> list[str]:
    """Strip header labels; reject empty headers, blank labels, duplicates regardless of case, and excess."""
    stripped = [(label or "").strip() for label in labels]
    if not any(stripped):
        raise AnalysisError("There is no column name in the first line.")
    if not all(stripped):
        raise AnalysisError("A column lacks a name in the header.")
    if len({label.casefold() for label in stripped}) < len(stripped):
        raise AnalysisError("Column names must be unique regardless of case.")
    if max_columns is not None and len(stripped) > max_columns:
        raise AnalysisError(f"The table exceeds the limit of {max_columns} columns.")
    return stripped


def _reader(spark: SparkSession, separator: str, encoding: str, multiline: bool):
    return (
        spark.read.option("sep", separator).option("encoding", spark_encoding(encoding)).option("multiLine", multiline)
        .option("quote", '"').option("escape", '"').option("nullValue", "").option("columnPruning", False)
    )


@dataclass(frozen=True)
class DelimitedScan:
    """Text columns of delimited files, before and after typing."""

    text: DataFrame
    labels: list[str]
    decimal: str = "."

    def typed(self) -> DataFrame:
        """Columns cast to the types their values allow; runs one job for the counts."""
        return cast_inferred(self.text, self.decimal)


def strict_scan(
    spark: SparkSession,
    path: str | list[str],
    *,
    separator: str | None = ",",
    encoding: str = "UTF-8",
    decimal: str = ".",
    multiline: bool = False,
    reject_ragged: bool = True,
    reject_blank: bool | None = None,
    max_columns: int | None = None,
) -> DelimitedScan:
    """Delimited files with a header; only the empty field is missing (``NA`` stays a value).

    Every file must have the header of the others: the reader checks it where it reads the start of a file, and the job
    fails with the name of a file that differs. A row with too few or too many fields fails the job that reads it; with
    ``reject_ragged=False`` such rows are kept and marked in ``_malformed``. The reader drops blank lines, so
    ``reject_blank`` (by default with ``reject_ragged``, unless ``multiline``) first counts them in a pass of its own.
    ``separator=None`` takes the one that all files show. ``encoding`` may be one that Spark does not read, such as GB18030:
    files are then cut into fields by their bytes, and the fields are decoded in Python. ``multiline`` admits line breaks inside quotes, at the price of
    unsplittable files.
    """
    separator = common_separator(spark, path, encoding=encoding) if separator is None else separator
    first = _reader(spark, separator, encoding, multiline).option("header", False).csv(path).head()
    if first is None:
        raise AnalysisError("There is no line in these files.")
    raw = ["" if label is None else label for label in first]
    spelled = raw if spark_encoding(encoding) == encoding else [redecoded(label, encoding) for label in raw]
    labels = check_labels([spelled[0].removeprefix(_BOM), *spelled[1:]], max_columns)
    if reject_blank or (reject_blank is None and reject_ragged and not multiline):
        _require_no_blank_lines(spark, path, encoding)
    # The header check compares names as they are written; they are trimmed afterwards.
    schema = T.StructType([T.StructField(label, T.StringType()) for label in raw])
    reader = _reader(spark, separator, encoding, multiline).option("header", True).option("enforceSchema", False)
    if reject_ragged:
        return DelimitedScan(decode_columns(reader.schema(schema).option("mode", "FAILFAST").csv(path).toDF(*labels), encoding), labels, decimal)
    schema = schema.add("_malformed", T.StringType())
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed")
    return DelimitedScan(decode_columns(reader.schema(schema).csv(path).toDF(*labels, "_malformed"), encoding), labels, decimal)


def blank_lines(spark: SparkSession, path: str | list[str], *, encoding: str = "UTF-8") -> DataFrame:
    """Files with lines that the reader of delimited text drops, and their number: file, blank_lines."""
    lines = spark.read.option("encoding", spark_encoding(encoding)).text(path)
    blank = lines.where(F.trim("value") == "").select(F.col("_metadata.file_path").alias("file"))
    return blank.groupBy("file").agg(F.count(F.lit(1)).alias("blank_lines"))


def _require_no_blank_lines(spark: SparkSession, path: str | list[str], encoding: str) -> None:
    worst = blank_lines(spark, path, encoding=encoding).agg(F.count("*").alias("files"), F.min("file").alias("file")).head()
    if worst["files"]:
        raise AnalysisError(f"{worst['files']} file(s) have blank lines, which are malformed records, among them {worst['file']}.")


def common_separator(spark: SparkSession, path: str | list[str], *, encoding: str = "UTF-8") -> str:
    """The separator that all files show; files without a filled line have no say."""
    judged = separator_audit(spark, path, encoding=encoding).where("verdict <> 'empty'")
    found = judged.selectExpr(
        "collect_set(separator) AS marks", "count_if(separator IS NULL) AS unclear", "min(IF(separator IS NULL, file, NULL)) AS file"
    ).head()
    if found["unclear"] or len(found["marks"]) != 1:
        where = f", for example in {found['file']}" if found["file"] else ""
        raise AnalysisError(f"The files do not show one common separator{where}; name it.")
    return found["marks"][0]


def lenient_scan(spark: SparkSession, path: str | list[str]) -> DelimitedScan:
    """Comma-separated UTF-8 in which the usual spellings of 'not available' are missing."""
    scan = strict_scan(spark, path)
    cleaned = [F.when(~P.ref(name).isin(*MISSING_TOKENS), P.ref(name)).alias(name) for name in scan.labels]
    return DelimitedScan(scan.text.select(*cleaned), scan.labels)


# --- types ----------------------------------------------------------------------------------------------------


def infer_text_types(df: DataFrame, decimal: str = ".") -> DataFrame:
    """Per text column the counts of values that read as integers, numbers and booleans, and the type they allow."""
    rows = []
    for i, name in enumerate(df.columns, 1):
        column = Q.named(name)
        spelled = f"replace({column}, {Q.quoted(decimal)}, '.')" if decimal != "." else column
        filled = f"count({column})"
        integers = f"count_if({column} RLIKE {Q.quoted(text.INTEGER_TEXT)} AND try_cast(trim({column}) AS BIGINT) IS NOT NULL)"
        numbers = f"count_if({spelled} RLIKE {Q.quoted(text.NUMBER_TEXT)})"
        flags = f"count_if({column} IN ({', '.join(map(Q.quoted, BOOLEAN_TOKENS))}))"
        inferred = (
            f"CASE WHEN {filled} = 0 THEN 'string' WHEN {integers} = {filled} THEN 'bigint' WHEN {numbers} = {filled} THEN 'double' "
            f"WHEN {flags} = {filled} THEN 'boolean' ELSE 'string' END"
        )
        rows.append(
            Q.struct(
                position=str(i), label=Q.quoted(name), nonmissing=filled, integers=integers, numbers=numbers, booleans=flags,
                inferred_type=inferred,
            )
        )
    return aggregate_rows(df, rows)


def cast_inferred(df: DataFrame, decimal: str = ".") -> DataFrame:
    """Cast text columns to their inferred types. Collects one row per column."""
    types = {row["label"]: row["inferred_type"] for row in infer_text_types(df, decimal).collect()}

    def cast(name: str) -> Column:
        column = P.ref(name)
        if types[name] == "double":
            return text.text_number(column, decimal).alias(name)
        if types[name] == "string":
            return column
        return F.trim(column).try_cast(types[name]).alias(name)

    return df.select(*[cast(name) for name in df.columns])


def decimal_numbers(df: DataFrame, columns: Sequence[str], decimal: str = ",") -> DataFrame:
    """Replace text columns by the numbers they spell with the given decimal mark."""
    return df.withColumns({name: text.text_number(P.ref(name), decimal) for name in columns})


# --- audits of directories ------------------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Every line with its file; ``place`` increases along each split of a file."""
    return spark.read.option("encoding", spark_encoding(encoding)).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "^" + _BOM, "").alias("line"), F.monotonically_increasing_id().alias("place"),
    )


def _separators(heads: DataFrame) -> DataFrame:
    """``heads`` (see ``first_lines``) with filled, comma, semicolon, tab, separator and sep_verdict; no shuffle."""
    names = {",": "comma", ";": "semicolon", "\t": "tab"}
    judged = heads.withColumn("filled", F.filter(F.slice("lines", 1, DETECTION_LINES), lambda line: text.strip(line) != ""))

    def viable(mark: str) -> Column:
        counts = F.transform("filled", lambda line: F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit(""))))
        steady = (F.array_min(counts) > 0) & (F.array_min(counts) == F.array_max(counts))
        return F.when(steady, F.array_min(counts)).cast("bigint")

    judged = judged.withColumns({name: viable(mark) for mark, name in names.items()})
    best = F.greatest(*[F.col(name) for name in names.values()])
    winners = F.array_compact(F.array(*[F.when(F.col(n) == best, F.lit(mark)) for mark, n in names.items()]))
    verdict = F.when(F.size("filled") == 0, F.lit("empty")).when(F.col("separator").isNotNull(), F.lit("detected")).otherwise(F.lit("ambiguous"))
    return judged.withColumn("separator", F.when(F.size(winners) == 1, F.get(winners, F.lit(0)))).withColumn("sep_verdict", verdict)


def separator_audit(spark: SparkSession, path: str | list[str], *, encoding: str = "UTF-8") -> DataFrame:
    """The separator of every file, judged by its first 12 lines: file, lines, comma, semicolon, tab, separator, verdict.

    A separator is viable when it occurs equally often, and at all, in each non-blank line. One viable separator
    wins; among several the strictly most frequent; else the file is ambiguous. Files without a filled line, also those
    without any byte, are empty. Of each file only the head is read.
    """
    found = _separators(first_lines(spark, path, DETECTION_LINES, encoding=encoding))
    return found.select("file", F.size("filled").cast("bigint").alias("lines"), "comma", "semicolon", "tab", "separator", F.col("sep_verdict").alias("verdict"))


def split_fields(line: Column, separator: str) -> Column:
    """Fields of one line, honouring quotes."""
    mark = "\\t" if separator == "\t" else "[" + separator + "]"
    fields = F.split(line, mark + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(
        fields, lambda f: F.regexp_replace(F.regexp_replace(f, r'^"([\s\S]*)"$', "$1"), '""', '"')
    )


def field_count(line: Column, separator: str) -> Column:
    """Number of fields of one line, separators inside quotes not counted; 0 for a blank line."""
    bare = F.regexp_replace(line, _QUOTED, "")
    marks = F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit("")))
    return F.when(line == "", F.lit(0)).otherwise(marks + 1)


def header_audit(
    spark: SparkSession, path: str | list[str], *, separator: str | None = ",", encoding: str = "UTF-8", max_columns: int = 250
) -> DataFrame:
    """Header problems and binary content per file: file, columns, blank_labels, duplicate_labels, has_nul, verdict.

    ``separator=None`` uses the one detected for each file (a comma where it is unclear). Labels are compared regardless of
    case by full folding, as a scan does. Files without any byte have no columns and the verdict ``empty``. Of each file only
    the head is read; a header line beyond a megabyte is ``line_too_long``.
    """
    heads = first_lines(spark, path, DETECTION_LINES if separator is None else 1, encoding=encoding)
    first = F.get("lines", F.lit(0))
    if separator is None:
        heads = _separators(heads)
        fields = reduce(
            lambda other, mark: F.when(F.col("separator") == mark, split_fields(first, mark)).otherwise(other),
            SEPARATORS[1:], split_fields(first, SEPARATORS[0]),
        )
    else:
        fields = split_fields(first, separator)
    head = heads.select("file", F.transform(fields, text.strip).alias("labels"), "has_nul", (F.col("cut") & (F.size("lines") == 1)).alias("too_long"))
    folded = F.transform("labels", text.fold)
    checked = head.select(
        "file", F.when(F.col("labels").isNull(), 0).otherwise(F.size("labels")).alias("columns"),
        F.when(F.col("labels").isNull(), 0).otherwise(F.size(F.filter("labels", lambda label: label == ""))).alias("blank_labels"),
        F.when(F.col("labels").isNull(), 0).otherwise(F.size("labels") - F.size(F.array_distinct(folded))).alias("duplicate_labels"),
        "has_nul", "too_long",
    )
    verdict = (
        F.when(F.col("columns") == 0, F.lit("empty"))
        .when(F.col("has_nul"), F.lit("binary"))
        .when(F.col("too_long"), F.lit("line_too_long"))
        .when(F.col("blank_labels") == F.col("columns"), F.lit("no_header"))
        .when(F.col("blank_labels") > 0, F.lit("blank_label"))
        .when(F.col("duplicate_labels") > 0, F.lit("duplicate_label"))
        .when(F.col("columns") > max_columns, F.lit("too_many_columns"))
        .otherwise(F.lit("ok"))
    )
    return checked.withColumn("verdict", verdict).drop("too_long")


def _line_counts(lines: DataFrame, separator: str) -> DataFrame:
    """Per file: columns, records, malformed, blank_lines and open_quotes, every line taken as a record."""
    counted = lines.select(
        "file", "block", "place", field_count(F.col("line"), separator).alias("fields"),
        (F.pmod(F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))), F.lit(2)) == 1).alias("open"),
    )
    return _counted_records(counted.groupBy("file", "fields").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("open").alias("open_quotes"), F.min(F.struct("block", "place")).alias("first")))


def _counted_records(totals: DataFrame) -> DataFrame:
    """The audit of ``totals``: file, fields, n, open_quotes, first; the record with the smallest ``first`` is the header."""
    # Both sides have one row per file and field count.
    headers = totals.groupBy("file").agg(F.min_by("fields", "first").alias("columns"))
    return totals.join(headers, "file").groupBy("file", "columns").agg(
        (F.sum("n") - 1).alias("records"),
        F.sum(F.when(F.col("fields") != F.col("columns"), F.col("n")).otherwise(0)).alias("malformed"),
        F.sum(F.when(F.col("fields") == 0, F.col("n")).otherwise(0)).alias("blank_lines"),
        F.sum("open_quotes").alias("open_quotes"),
    )


def _record_counts(lines: DataFrame, separator: str) -> DataFrame:
    """The same, where a line break inside quotes belongs to its record.

    Whether a line begins inside quotes follows from the number of quotes before it. It is summed in three steps, so that
    no task holds more than one part of a file: in each part, over the totals of the parts, and both together.
    """
    pieces = F.split("line", '"', -1)
    marks = lambda odd: F.aggregate(
        F.transform(pieces, lambda piece, i: F.when(i % 2 == odd, F.length(piece) - F.length(F.replace(piece, F.lit(separator), F.lit("")))).otherwise(0)),
        F.lit(0), lambda total, n: total + n)
    counted = lines.select("file", "block", "place", (F.col("line") == "").alias("blank"), (F.size(pieces) - 1).alias("quotes"), marks(0).alias("outside"), marks(1).alias("inside"))
    part = Window.partitionBy("file", "block").orderBy("place")
    before = F.coalesce(F.sum("quotes").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.withColumn("before", before % 2)
    # One row per part of a file: its quotes, and its last lines with an even and with an odd number of quotes before them.
    parts = counted.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), *[F.max(F.when(F.col("before") == k, F.col("place"))).alias(f"last{k}") for k in (0, 1)])
    along = Window.partitionBy("file").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("opens", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    # A record begins at a line outside quotes; the last such line of a part may be continued in the next ones.
    last = F.when(F.col("opens") == 0, F.col("last0")).otherwise(F.col("last1"))
    parts = parts.withColumn("start", F.when(last.isNotNull(), F.struct("block", last.alias("place"))))
    parts = parts.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "opens", F.last("start", True).over(earlier).alias("earlier"))
    placed = counted.join(parts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    within = (F.col("before") + F.col("opens")) % 2 == 1
    placed = placed.select("file", "block", "place", "blank", within.alias("within"), F.when(within, F.col("inside")).otherwise(F.col("outside")).alias("marks"),
                           (F.col("quotes") % 2 == 1).alias("turns"), "earlier")
    single = placed.where("NOT within AND NOT turns").select(
        "file", F.struct("block", "place").alias("start"), F.when(F.col("blank"), 0).otherwise(F.col("marks") + 1).alias("fields"), F.lit(False).alias("open"))
    begun = F.last(F.when(~F.col("within"), F.struct("block", "place")), True).over(part.rowsBetween(Window.unboundedPreceding, 0))
    longer = placed.withColumn("start", F.coalesce(begun, "earlier")).where("within OR turns").groupBy("file", "start").agg(
        (F.sum("marks") + 1).cast("int").alias("fields"), (F.count_if("turns") % 2 == 1).alias("open"))
    records = single.unionByName(longer)
    return _counted_records(records.groupBy("file", "fields").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("open_quotes"), F.min("start").alias("first")))


def ragged_audit(
    spark: SparkSession, path: str | list[str], *, separator: str = ",", encoding: str = "UTF-8", quoted_breaks: bool = False
) -> DataFrame:
    """Records per file that do not have as many fields as the header; blank lines count as malformed.

    file, columns, records, malformed, blank_lines, open_quotes. Lines are reduced to (file, field count) totals in
    every task; files with line breaks inside quotes show up under ``open_quotes``, the lines with an odd number of quotes.
    With ``quoted_breaks`` such files are counted again by records, in which quoted line breaks may occur, also where a split
    of the file falls into one; ``open_quotes`` is then 1 for a file that ends inside quotes.
    """
    lines = _lines(spark, path, encoding)
    counts = _line_counts(lines, separator)
    if not quoted_breaks:
        return counts
    counts = materialized(counts)  # one row per file
    broken = counts.where("open_quotes > 0").select("file")
    return counts.where("open_quotes = 0").unionByName(_record_counts(lines.join(broken, "file", "left_semi"), separator))
