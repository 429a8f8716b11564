"""Text patterns as Column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide roles and narrative checks. Word and digit classes are spelled
# out with Unicode properties because Java's \\w and \\d are ASCII-only.
ID_NAME = r"(?Ui)(^|[_\s-])(id|identifier|participant.?id|record.?id|case.?id)($|[_\s-])"
ISO_DATE = r"(?d)^\p{Nd}{4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}(?:[ T].*)?$"
FACT_TOKEN = r"\[\[FACT:([A-Za-z0-9_-]+)\]\]"
FACT_TOKEN_START = "[[FACT:"
LITERAL_NUMBER = r"(?<![\p{L}\p{N}_\]])[-+]?\p{Nd}+(?:[.,]\p{Nd}+)?(?:[eE][-+]?\p{Nd}+)?%?"
NUMBER_TEXT = r"(?i)^\s*[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity|nan)\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"

_SPACE = r"[\s\x1c-\x1f]"
EDGE_SPACE = rf"(?U)^{_SPACE}+|{_SPACE}+\z"
NON_SPACE = r"(?U)[^\s\x1c-\x1f]"

#: ISO_DATE of the stripped text in one anchored match, which gives up at the first character of other texts.
PADDED_ISO_DATE = rf"(?Ud)^{_SPACE}*{ISO_DATE.removeprefix('(?d)^').removesuffix('$')}{_SPACE}*\z"

#: Whether LITERAL_NUMBER occurs: a digit that follows no word character and no bracket (a sign is neither). The digit
#: is tried first, so that the look-behind runs at digits only.
HAS_LITERAL_NUMBER = r"\p{Nd}(?<![\p{L}\p{N}_\]]\p{Nd})"


def strip(column: Column) -> Column:
    """Remove leading and trailing white space of every kind (Spark's trim removes blanks only)."""
    return F.regexp_replace(column, EDGE_SPACE, "")


def is_blank(column: Column) -> Column:
    """NULL or nothing but white space."""
    return F.coalesce(~F.rlike(column, F.lit(NON_SPACE)), F.lit(True))


def text_number(column: Column, decimal: str = ".") -> Column:
    """A number written as text, or NULL. The pattern keeps Java-only spellings such as ``1.0d`` out."""
    text = F.replace(column, F.lit(decimal), F.lit(".")) if decimal != "." else column
    return F.when(F.rlike(text, F.lit(NUMBER_TEXT)), F.trim(text).try_cast("double"))


def fact_tokens(prose: Column) -> Column:
    """Ids of all well-formed fact tokens, in order of appearance."""
    return F.regexp_extract_all(prose, F.lit(FACT_TOKEN), F.lit(1))


def without_fact_tokens(prose: Column) -> Column:
    """The text with its well-formed fact tokens removed."""
    return F.when(F.contains(prose, F.lit(FACT_TOKEN_START)), F.regexp_replace(prose, FACT_TOKEN, "")).otherwise(prose)


def has_literal_number(text: Column) -> Column:
    """Whether the text states a number outside fact tokens."""
    return F.rlike(without_fact_tokens(text), F.lit(HAS_LITERAL_NUMBER))


@cache
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """The full case folding of Unicode, as Python knows it: characters that fold to one, what they fold to, and the others."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    folded = {c: c.casefold() for c in every if c.casefold() != c}
    single = [c for c in folded if len(folded[c]) == 1]
    return "".join(single), "".join(folded[c] for c in single), {c: t for c, t in folded.items() if len(t) > 1}


def fold(column: Column) -> Column:
    """The text for comparison regardless of case, by the full Unicode folding: ``Straße`` and ``STRASSE`` become equal.

    ``lower`` is not enough: it keeps ``ß``, the long s and the final sigma. Folding goes character by character, so the
    result does not depend on the neighbours. Texts of ASCII only take the short way.
    """
    source, target, several = _fold_table()
    folded = F.translate(column, source, target)
    expanded = folded
    for character, text in several.items():
        expanded = F.replace(expanded, F.lit(character), F.lit(text))
    expanded = F.when(F.rlike(column, F.lit(f"[{''.join(several)}]")), expanded).otherwise(folded)
    return F.when(F.rlike(column, F.lit(r"[^\x00-\x7F]")), expanded).otherwise(F.lower(column))
