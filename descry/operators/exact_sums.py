"""Sums, means and variances of doubles whose bits do not depend on how rows are partitioned.

Adding doubles rounds, so the usual sum follows the order in which partial results meet. Here every value is cut into whole
numbers: multiples of fixed powers of two, ``DIGIT`` bits each. Whole numbers add exactly in any order. A value needs four of
them, counted from the bin that holds its leading bit, so rows are grouped by that bin as well, with map-side combining; the
sums of all bins of a key are at most a hundred numbers. They are combined with carries into digits of one sign, and added
from the smallest. Variances take a second pass over the squared differences from that mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.functions import sqltext as Q

#: Bits of a digit, exponent of the unit of bin 0, number of the lowest and highest bin: the unit of the lowest one is the
#: smallest double. 2**42 rows of one key add up without overflow.
DIGIT, BASE, LOWEST, HIGHEST = 20, -14, -53, 51
_PIECES = 4


def _unit(bin_no: str) -> str:
    """The power of two of a bin as a constant look-up; 0 below the lowest one, where no double has bits."""
    units = ", ".join(f"double('{2.0 ** (DIGIT * b + BASE)!r}')" for b in range(LOWEST, HIGHEST + 1))
    return f"coalesce(get(array({units}), {bin_no} + {-LOWEST}), 0D)"


def _piece_sums(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, bin, digit): exact sums of the multiples of each bin's unit. ``value`` is finite or null."""
    # A rounded logarithm may name the bin next to the right one: the pieces then start a bin higher or lower and still hold
    # all bits.
    leading = f"greatest({LOWEST}, least({HIGHEST}, CAST(floor((log2(abs(nullif({value}, 0D))) - {BASE}) / {DIGIT}) AS INT)))"
    at = rows.selectExpr(*map(Q.named, keys), f"{value} AS _rest", f"{leading} AS _bin").where("_bin IS NOT NULL")
    pieces = []
    for k in range(_PIECES):
        at = at.selectExpr("*", f"{_unit(f'_bin - {k}')} AS _unit{k}")
        at = at.selectExpr("*", f"CAST(coalesce(_rest / nullif(_unit{k}, 0D), 0D) AS BIGINT) AS _q{k}")
        rest = f"_rest - _q{k} * _unit{k}"
        at = at.selectExpr(*map(Q.named, keys), "_bin", *[f"_q{i}" for i in range(k + 1)], f"{rest} AS _rest")
        pieces.append(Q.struct(bin=f"_bin - {k}", digit=f"_s{k}"))
    sums = at.groupBy(*keys, "_bin").agg(*[F.sum(f"_q{k}").alias(f"_s{k}") for k in range(_PIECES)])
    long = sums.selectExpr(*map(Q.named, keys), f"inline(array({', '.join(pieces)}))").where("digit <> 0")
    return long.groupBy(*keys, "bin").agg(F.sum("digit").alias("digit"))


def exact_totals(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, total): the sum per key of the doubles that the SQL ``value`` gives, less than one unit in the last place from
    the true one. Null adds nothing; a key of which all values are null or zero has no row. Values must be finite."""
    names = [*map(Q.named, keys)]
    digits = _piece_sums(rows, keys, value).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "digit"))).alias("_digits"), F.min("bin").alias("_low"), F.max("bin").alias("_high"))
    empty = "named_struct('carry', 0L, 'digits', CAST(array() AS ARRAY<BIGINT>))"

    def carried(sign: str) -> str:
        own = f"(s.carry + {sign} * coalesce(try_element_at(_digits, i), 0L))"
        return (f"aggregate(sequence(_low, _high), {empty}, (s, i) -> named_struct('carry', shiftright({own}, {DIGIT}), "
                f"'digits', concat(s.digits, array({own} & {(1 << DIGIT) - 1}))))")

    # The carry out of the highest bin has the sign of the sum; with all digits of that sign nothing cancels below.
    signed = digits.selectExpr(*names, "_digits", "_low", "_high", f"IF({carried('1L')}.carry < 0, -1L, 1L) AS _sign")
    settled = signed.selectExpr(*names, "_low", "_high", "_sign", f"{carried('_sign')} AS _state")
    whole = f"aggregate(zip_with(_state.digits, sequence(_low, _high), (d, i) -> d * pow(2D, i * {DIGIT} + {BASE})), 0D, (t, d) -> t + d)"
    top = f"IF(_state.carry = 0, 0D, _state.carry * pow(2D, (_high + 1) * {DIGIT} + {BASE}))"
    return settled.selectExpr(*names, f"_sign * ({whole} + {top}) AS total")


def exact_moments(rows: DataFrame, keys: Sequence[str], value: str, *, few_keys: bool = False) -> DataFrame:
    """(keys, n, mean, variance) of the doubles in column ``value`` per key, the same bits for any partitioning.

    The mean is the exact sum over n; the variance is the exact sum of the squared differences from that mean over n - 1,
    null for fewer than two values. Null is no value. Infinite values give an infinite mean, or null if they have both signs,
    and no variance. With ``few_keys`` the means are broadcast.
    """
    names = [*map(Q.named, keys)]
    infinite = f"abs({Q.named(value)}) = {Q.INFINITY}"
    counts = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.expr(f"max(IF({infinite}, {Q.named(value)}, NULL))").alias("_above"), F.expr(f"min(IF({infinite}, {Q.named(value)}, NULL))").alias("_below"))
    sums = exact_totals(rows, keys, f"IF({infinite}, NULL, {Q.named(value)})")

    def with_totals(left: DataFrame, totals: DataFrame, name: str) -> DataFrame:
        totals = totals.withColumnRenamed("total", name)
        if not keys:
            return left.join(F.broadcast(totals), F.lit(True), "left")  # one row on either side
        right = totals.toDF(*[f"_k{i}" for i in range(len(keys))], name)
        matched = [F.col(Q.named(key)).eqNullSafe(F.col(f"_k{i}")) for i, key in enumerate(keys)]
        return left.join(F.broadcast(right) if few_keys else right, matched, "left").drop(*[f"_k{i}" for i in range(len(keys))])

    mean = f"CASE WHEN _above <> _below THEN NULL WHEN _above IS NOT NULL THEN _above WHEN n > 0 THEN coalesce(_sum, 0D) / n END"
    means = with_totals(counts, sums, "_sum").selectExpr(*names, "n", f"{mean} AS mean", "_above IS NULL AS _finite")
    centred = means.where("_finite AND n > 1").selectExpr(*[f"{name} AS _k{i}" for i, name in enumerate(names)], "mean AS _mean")
    if keys:
        matched = [F.col(name).eqNullSafe(F.col(f"_k{i}")) for i, name in enumerate(names)]
        apart = rows.join(F.broadcast(centred) if few_keys else centred, matched)
    else:
        apart = rows.join(F.broadcast(centred), F.lit(True))  # one row
    apart = apart.selectExpr(*names, f"({Q.named(value)} - _mean) * ({Q.named(value)} - _mean) AS _square")
    # A square beyond the largest double would not be finite; such a variance is infinite.
    huge = apart.groupBy(*keys).agg(F.expr(f"IF(max(_square) = {Q.INFINITY}, max(_square), NULL)").alias("total"))
    squares = exact_totals(apart, keys, f"IF(_square < {Q.INFINITY}, _square, NULL)")
    found = with_totals(with_totals(means, squares, "_squares"), huge.where("total IS NOT NULL"), "_huge")
    return found.selectExpr(*names, "n", "mean", "IF(_finite AND n > 1, coalesce(_huge, coalesce(_squares, 0D) / (n - 1)), NULL) AS variance")
