"""Exact quantiles without gathering a group in one task.

Spark's ``percentile`` over rows ships a buffer of distinct values from every task to one reducer. Two ways avoid
that. Where a profile knows that there are few distinct values, they are counted first (map-side combined), and
``percentile`` runs on the counts. Otherwise the wanted ranks are narrowed by counting:

1. count values in coarse logarithmic cells (1024 per octave, so a few thousand cells in practice and about
   four million for any DOUBLE data at all) and find the cell of each wanted rank;
2. count the values of those cells in 2**21 equal-width slices and find the slice;
3. count the distinct values of those slices - by the density of DOUBLE numbers at most some two million -
   and read off the value at the rank.

Every step is a partially aggregated ``groupBy``; a window only ever sees the counts of one cell, never rows.
With an unbounded number of keys, steps 2 and 3 would have to bring the rows of a cell to where its wanted ranks are, and
values that lie close together relative to their size share one cell. There each value gets a place within the nominal bounds
of its cell, from the value alone, and counts are rolled up from values to places, blocks of 65,536 places, and cells.
The descent then meets at most 65,536 blocks of a cell, places of a block, and the few values of a place.

All binning functions are monotone, so the result is the exact order statistic. Both ways, and ``percentile``, use the same
interpolation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.functions.sqltext import named

#: Known distinct values per key up to which their counts may meet in one aggregation buffer.
FEW_VALUES = 500_000

_CELLS_PER_OCTAVE = 1024
_SLICES = 1 << 21
_OFFSET = 1_200_000  # larger than 1075 octaves below one * cells per octave

#: Order-preserving coarse cell of a finite DOUBLE.
_SIZE = f"(CAST(floor(log2(abs(_x)) * {_CELLS_PER_OCTAVE}D) AS INT) + {_OFFSET})"
_CELL = f"CASE WHEN _x > 0D THEN {_SIZE} WHEN _x < 0D THEN -{_SIZE} ELSE 0 END"

#: Order-preserving slice of a value within the bounds of its cell.
_PLACE = f"CAST(floor((_x - _low) / (_high - _low) * {_SLICES}D) AS INT)"
_SLICE = f"IF(_low < _high, least({_PLACE}, {_SLICES - 1}), 0)"

#: Nominal bounds of a cell, and the order-preserving place of a value within them: 2**32 places, in blocks of 2**16.
_FROM = f"power(2D, (abs(_cell) - {_OFFSET}) / {_CELLS_PER_OCTAVE}D)"
_TO = f"power(2D, (abs(_cell) - {_OFFSET} + 1) / {_CELLS_PER_OCTAVE}D)"
_PLACES = 1 << 32
_WITHIN = f"greatest(0L, least({_PLACES - 1}L, CAST(floor((abs(_x) - {_FROM}) / ({_TO} - {_FROM}) * {_PLACES}D) AS BIGINT)))"
_CELL_PLACE = f"IF(_cell = 0 OR {_TO} <= {_FROM}, 0L, IF(_x < 0D, -1L, 1L) * {_WITHIN})"

#: Wanted ranks re-based to the start of their bin; those outside the bin are dropped.
_INSIDE = (
    "filter(transform(_wanted, w -> named_struct('prob', w.prob, 'rest', w.rest - _before)), w -> w.rest >= 0 AND w.rest < _w)"
)


def quantiles_of_few_values(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """The result of ``exact_quantiles`` for a value known to have at most ``FEW_VALUES`` distinct values per key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.expr("count(1) AS _w"))
    found = [F.percentile(value, F.lit(float(p)), F.col("_w")).alias(f"q{i}") for i, p in enumerate(probs)]
    return counts.groupBy(*keys).agg(F.sum("_w").alias("value_n"), *found)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], *, few_keys: bool
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per combination of ``keys``.

    ``df`` has the key columns (no NULLs) and a DOUBLE ``value`` whose NULLs are ignored; infinities must have been
    removed. Result: the keys, ``value_n`` and ``q0``, ``q1``, ... in the order of ``probs``.

    ``few_keys=True`` states that the number of key combinations is bounded and small (one per column, or groups
    that passed a count check). Then each step re-reads only the needed columns and finds the wanted cells with a
    broadcast of at most ``2 * len(probs)`` rows per key. With ``few_keys=False`` only counts are exchanged: per value once,
    then per place, block and cell.
    """
    base = df.select(*keys, F.col(value).alias("_x")).where("_x IS NOT NULL")
    find = _by_broadcast if few_keys else _by_descent
    found = find(base, keys, list(map(float, probs)))

    def interpolated(i: int, p: float) -> str:
        low, high = [f"{end}(_x) FILTER (WHERE _prob = {i})" for end in ("min", "max")]
        place = f"({p!r}D * (max(_n) - 1))"
        return f"IF({low} = {high}, {low}, (ceil({place}) - {place}) * {low} + ({place} - floor({place})) * {high}) AS q{i}"

    results = [interpolated(i, p) for i, p in enumerate(map(float, probs))]
    return found.groupBy(*keys).agg(F.expr("max(_n) AS value_n"), *[F.expr(text) for text in results])


def _wanted_cells(cells: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The cells that hold a wanted rank, with the ranks counted from the cell's start."""
    ranks = ", ".join(
        f"named_struct('prob', {i}, 'rest', CAST({side}({p!r}D * (_n - 1)) AS BIGINT))"
        for i, p in enumerate(probs)
        for side in ("floor", "ceil")
    )
    within = f"PARTITION BY {', '.join(map(named, keys)) or '0'}"
    counted = cells.selectExpr("*", f"sum(_w) OVER ({within}) AS _n", _before(within, "_cell"))
    return _holding_wanted(counted.selectExpr("*", f"array_distinct(array({ranks})) AS _wanted"), keys, "_cell")


def _held_values(values: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """(keys, _n, _x, _prob): the values at the wanted ranks of their bin."""
    held = _with_running_count(values, within, "_x").selectExpr("*", f"{_INSIDE} AS _held")
    return held.selectExpr(*map(named, keys), "_n", "_x", "explode(_held.prob) AS _prob")


def _by_broadcast(base: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The values at the wanted ranks, by three passes over the rows."""
    counted = base.selectExpr(*map(named, keys), "_x", "1L AS _w", f"{_CELL} AS _cell")

    def bins(frame: DataFrame, *by: str) -> DataFrame:
        totals = [F.expr(text) for text in ("sum(_w) AS _w", "min(_x) AS _low", "max(_x) AS _high")]
        return frame.groupBy(*keys, *by).agg(*totals)

    wanted = _wanted_cells(bins(counted, "_cell"), keys, probs)
    at_cell = [*keys, "_cell"]
    slices = counted.join(F.broadcast(wanted), at_cell).selectExpr("*", f"{_SLICE} AS _slice")
    slices = bins(slices, "_cell", "_n", "_wanted", "_slice")
    wanted = _holding_wanted(_with_running_count(slices, at_cell, "_slice"), keys, "_cell", "_slice")
    values = counted.join(F.broadcast(wanted), at_cell).where("_x BETWEEN _low AND _high")
    values = values.groupBy(*at_cell, "_slice", "_n", "_wanted", "_x").agg(F.expr("sum(_w) AS _w"))
    return _held_values(values, keys, [*at_cell, "_slice"])


def _by_descent(base: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The values at the wanted ranks, by descending through rolled-up counts."""
    total = F.expr("sum(_w) AS _w")
    at_cell, at_block, at_place = [*keys, "_cell"], [*keys, "_cell", "_block"], [*keys, "_cell", "_block", "_place"]
    values = base.groupBy(*keys, "_x").agg(F.expr("count(1) AS _w")).selectExpr("*", f"{_CELL} AS _cell")
    values = values.selectExpr("*", f"{_CELL_PLACE} AS _place").selectExpr("*", "shiftright(_place, 16) AS _block")
    places = values.groupBy(*at_place).agg(total)
    blocks = places.groupBy(*at_block).agg(total)
    wanted = _wanted_cells(blocks.groupBy(*at_cell).agg(total), keys, probs)
    blocks = _with_running_count(blocks.join(wanted, at_cell), at_cell, "_block")
    wanted = _holding_wanted(blocks, keys, "_cell", "_block")
    places = _with_running_count(places.join(wanted, at_block), at_block, "_place")
    wanted = _holding_wanted(places, keys, "_cell", "_block", "_place")
    return _held_values(values.join(wanted, at_place), keys, at_place)


def _before(within: str, order: str) -> str:
    """How many values precede a bin."""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"coalesce(sum(_w) OVER ({within} ORDER BY {order} {frame}), 0L) AS _before"


def _with_running_count(counts: DataFrame, within: list[str], order: str) -> DataFrame:
    return counts.selectExpr("*", _before(f"PARTITION BY {', '.join(map(named, within))}", order))


def _holding_wanted(bins: DataFrame, keys: list[str], *at: str) -> DataFrame:
    """The bins that hold a wanted rank."""
    bounds = [name for name in ("_low", "_high") if name in bins.columns]
    kept = bins.selectExpr(*map(named, keys), *at, *bounds, "_n", f"{_INSIDE} AS _wanted")
    return kept.where("size(_wanted) > 0")
