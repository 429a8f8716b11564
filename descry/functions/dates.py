"""Date parsing and ISO output, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.functions.text import strip

_SLASH_DATE = r"^(\d{4})/(\d{1,2})/(\d{1,2})"


def as_instant(column: Column, dtype: T.DataType) -> Column:
    """TIMESTAMP_NTZ of a date-like value; text that is no date becomes NULL."""
    if isinstance(dtype, T.StringType):
        dashed = F.regexp_replace(strip(column), _SLASH_DATE, "$1-$2-$3")
        return dashed.try_cast("timestamp_ntz")
    return column.cast("timestamp_ntz")


def iso_text(instant: Column) -> Column:
    """ISO text with seconds, and with microseconds only where there are any."""
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(instant, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))
