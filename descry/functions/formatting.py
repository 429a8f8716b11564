"""Numbers as report text: always a decimal point, two decimals for statistics, one for percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from descry.functions import sqltext


def statistic_text(name: str) -> Column:
    """The text of a DOUBLE column."""
    return F.expr(sqltext.statistic_text(sqltext.named(name)))


def count_text(name: str) -> Column:
    """The text of an integer column."""
    return F.expr(sqltext.count_text(sqltext.named(name)))


def percent_text(name: str) -> Column:
    """The text of a percentage, one decimal."""
    return F.expr(sqltext.percent_text(sqltext.named(name)))
