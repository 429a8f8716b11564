"""Missing / non-finite semantics and value identity, as Column expressions.

* missing   = NULL, and NaN for floating types
* nonfinite = +/- infinity, counted apart from missing
* finite    = neither; every statistic but the two legacy ones uses finite values
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.errors import AnalysisError

INFINITY = float("inf")

#: Strings longer than this many bytes are compared by their SHA-256 instead of being shuffled whole.
VERBATIM_BYTES = 64


def ref(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise AnalysisError(f"Variable '{name}' was not found.")


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    """Numeric in the sense of the report: every number type, never booleans."""
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def missing(column: Column, dtype: T.DataType) -> Column:
    if is_floating(dtype):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def present(column: Column, dtype: T.DataType) -> Column:
    return ~missing(column, dtype)


def as_number(column: Column) -> Column:
    """The value as DOUBLE with NaN turned into NULL; infinities stay."""
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def finite(column: Column) -> Column:
    """The value as DOUBLE where finite, else NULL (NaN sorts above infinity, so one test covers both)."""
    number = column.cast("double")
    return F.when(F.abs(number) < F.lit(INFINITY), number)


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as DOUBLE, NULL for an empty denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def label_text(column: Column, dtype: T.DataType) -> Column:
    """The text of a category; booleans print capitalised."""
    text = column.cast("string")
    return F.initcap(text) if isinstance(dtype, T.BooleanType) else text


def digest_long(text: Column, tag: Column | None = None) -> Column:
    """Texts up to 64 bytes verbatim; longer ones as a one-character tag plus the SHA-256 of the whole text.

    A digest key has 65 characters, so it never equals a verbatim one.
    """
    tag = F.lit("#") if tag is None else tag
    return F.when(F.octet_length(text) > VERBATIM_BYTES, F.concat(tag, F.sha2(text, 256))).otherwise(text)


def identity_key(column: Column, dtype: T.DataType) -> Column:
    """A compact grouping key that is equal exactly when two values are equal (missing equals missing)."""
    if is_floating(dtype):
        return F.when(~F.isnan(column), column)
    if isinstance(dtype, T.StringType):
        return digest_long(column)
    if isinstance(dtype, T.BinaryType):
        return digest_long(F.hex(column))
    if isinstance(dtype, T.VariantType):
        return digest_long(F.to_json(column))
    if is_nested(dtype):
        return digest_long(F.to_json(F.struct(column.alias("v"))))
    return column


def require_numeric(df: DataFrame, *names: str) -> None:
    for name in names:
        if not is_numeric(type_of(df, name)):
            raise AnalysisError(f"The variable '{name}' must be numeric and not boolean.")


def require_distinct(first: str, second: str) -> None:
    if first == second:
        raise AnalysisError("The two selected variables must be different.")


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, booleans excluded."""
    return [field.name for field in df.schema.fields if is_numeric(field.dataType)]
