"""Near-duplicate vectors by collision counting over one-dimensional projections.

Every vector is projected on many random lines. The projected values are sorted in tables: a table cuts some of its lines
at zero, which deals the vectors to cells, and sorts each cell by the value on one more line. In the window around each
vector in this order, the lines are counted on which the other value falls into the window around the own one; a pair that
collides on enough lines is a candidate. The least count comes from the recall wanted for pairs at the least cosine.

Candidates only say which vectors belong together: they are passed on as stars, never as all pairs. In each connected group
of candidates all pairs are then compared by their cosine in double precision, in blocks; a large cell or group is dealt to
tasks as pairs of tiles. Equal vectors collapse before all this.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb, erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import written
from descry.llm.components import components, stars
from descry.llm.simhash import whole_groups

#: Least cosine of a link; tables and lines that deal to the cells of each; lines on which collisions are counted.
COSINE, TABLES, CUTS, LINES = 0.95, 15, 15, 32
#: Width of a step and number of steps of the values on the counted lines (unit: their spread); window to either side in steps.
STEP, STEPS, WINDOW = 0.32, 16, 2
#: Recall of the count at the least cosine; rows of a tile; pairs or vectors handled at a time.
RECALL, TILE, BLOCK = 0.999, 1024, 1 << 18


def collision_share(cosine: float) -> float:
    """Share of lines on which two vectors of this cosine collide: their steps differ by WINDOW at most.

    On a line of random direction the values differ by a normal amount of spread sqrt(2 - 2 cosine); the place of the first
    value in its step is uniform.
    """
    spread = sqrt(max(2 - 2 * cosine, 1e-12))

    def inside(x: float) -> float:  # integral of P(difference < t) over t up to x
        return x * erf(x / spread / sqrt(2)) + 2 * spread / sqrt(2 * pi) * exp(-((x / spread) ** 2) / 2)

    low, high = WINDOW * STEP, (WINDOW + 1) * STEP
    return (inside(high) - inside(low)) / STEP


def least_count(cosine: float = COSINE, recall: float = RECALL) -> int:
    """The largest number of collisions that pairs of this cosine reach with this probability."""
    p, total = collision_share(cosine), 0.0
    for count in range(LINES, 0, -1):
        total += comb(LINES, count) * p**count * (1 - p) ** (LINES - count)
        if total >= recall:
            return count
    return 0


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and flat values of a list column in doubles, null components as NaN; null rows have size 0."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64), values


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) by size of the vectors; rows that link with nothing are left out."""
    sizes, values = _arrays(column)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        x = values[starts[rows][:, None] + np.arange(size)]
        largest = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (largest > 0)
        x = x[good] / largest[good, None]  # first by the largest, so that squares neither overflow nor vanish
        yield rows[good], x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the name of their vector, equal for equal vectors; null where it links with nothing."""
    for batch in batches:
        column = batch.column("vector")
        names = np.zeros(len(column), np.int64)
        usable = np.zeros(len(column), bool)
        sizes, values = _arrays(column)
        starts = np.cumsum(sizes) - sizes
        for rows, _ in _matrices(column):
            usable[rows] = True
            for i in rows.tolist():
                octets = (values[starts[i] : starts[i] + sizes[i]] + 0.0).tobytes()  # -0 is 0
                names[i] = xxhash.xxh3_64_intdigest(octets) - (1 << 63)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names, mask=~usable), column], names=["vec_id", "name", "vector"])


def _lines(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The cutting and the counted lines for vectors of one size, the latter scaled to a spread of 1 for unit vectors."""
    rng = np.random.default_rng([17, size])
    cutting = rng.normal(size=(size, TABLES * CUTS))
    counted = rng.normal(size=(size, LINES))
    return cutting, counted / np.sqrt((counted * counted).sum(axis=0)) * sqrt(size)


def _placed(batches: Iterator[pa.RecordBatch], sketched: bool) -> Iterator[pa.RecordBatch]:
    """Each vector once in every table: cell, name, and its steps on the counted lines in two numbers."""
    lines: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        names = batch.column("name").to_numpy()
        for rows, x in _matrices(batch.column("vector")):
            size = x.shape[1]
            if size not in lines:
                lines = {size: _lines(size)}  # one size at a time, as a rule there is only one
            cutting, counted = lines[size]
            for a in range(0, len(rows), 8192):
                part = x[a : a + 8192]
                sides = (part @ cutting > 0).reshape(len(part), TABLES, CUTS) @ (1 << np.arange(CUTS))
                cell = sides + (np.arange(TABLES) << CUTS) + (size * TABLES << CUTS)
                columns = [pa.array(cell.ravel(), pa.int64()), pa.array(np.repeat(names[rows[a : a + 8192]], TABLES))]
                if sketched:
                    steps = np.clip(np.floor(part @ counted / STEP) + STEPS // 2, 0, STEPS - 1).astype(np.uint8)
                    packed = (steps[:, ::2] | steps[:, 1::2] << 4).view(np.int64)
                    columns += [pa.array(np.repeat(packed[:, k], TABLES)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "name", "s1", "s2"][: len(columns)])


def _steps(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    packed = np.stack([s1, s2], axis=1).view(np.uint8)
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(s1), LINES).astype(np.int8)


def _windows(cell: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), a before b in the order by cell and value, of which b is in the window after a."""
    order = np.lexsort((value, cell))
    place = np.cumsum(np.append(False, np.diff(cell[order]) != 0)) * (4 * STEPS) + value[order]
    count = np.searchsorted(place, place + WINDOW, side="right") - np.arange(len(place)) - 1
    total = np.cumsum(count)
    at = 0
    while at < len(order):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + BLOCK, side="right")))
        n = count[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[at:to] - n - base, n)
        yield order[a], order[b]
        at = to


def _collide(batches: Iterator[pa.RecordBatch], needed: int) -> Iterator[pa.RecordBatch]:
    """Stars over the candidates of each cell; in a cell of two tiles only pairs across count, as the others meet elsewhere."""
    for part in whole_groups(batches, lambda c: np.cumsum(np.append(True, (np.diff(c["cell"]) != 0) | (np.diff(c["p"]) != 0) | (np.diff(c["q"]) != 0))) if len(c["cell"]) else c["cell"]):
        cell, p, q, tile, name = (part[k] for k in ("cell", "p", "q", "tile", "name"))
        if len(cell) < 2:
            continue
        group = np.cumsum(np.append(False, (np.diff(cell) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)))
        steps = _steps(part["s1"], part["s2"])
        sorted_by = steps[np.arange(len(cell)), (cell >> CUTS) % TABLES % LINES].astype(np.int64)
        nodes, roots = [], []
        for a, b in _windows(group, sorted_by):
            met = (name[a] != name[b]) & ((p[a] == q[a]) | (tile[a] != tile[b]))
            a, b = a[met], b[met]
            close = (np.abs(steps[a] - steps[b]) <= WINDOW).sum(axis=1) >= needed
            if close.any():
                u, v = stars(name[a[close]], name[b[close]])
                nodes.append(u)
                roots.append(v)
        if nodes:
            u, v = stars(np.concatenate(nodes), np.concatenate(roots))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def tiled(rows: DataFrame, sizes: DataFrame, key: str, tile: int) -> DataFrame:
    """``rows`` dealt to pairs of tiles (p, q), p <= q, of their group: groups of up to ``tile`` rows (all that are missing
    in ``sizes``: key, n) have one, and each row of a larger group goes to all pairs with its own tile."""
    number = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / tile).cast("int")
    own = F.pmod(F.xxhash64("name"), F.col("tiles")).cast("int")
    dealt = rows.join(sizes, key, "left").withColumn("tiles", number).withColumn("tile", own).drop("n")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.withColumn("other", other).drop("tiles")
    return dealt.withColumn("p", F.least("tile", "other")).withColumn("q", F.greatest("tile", "other")).drop("other")


def candidate_stars(classes: DataFrame, needed: int, tile: int) -> DataFrame:
    """(u, v): links between names that connect all pairs of candidates; see the module."""
    cells = classes.select("name", "vector").mapInArrow(partial(_placed, sketched=False), "cell bigint, name bigint")
    crowded = written(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > tile), "crowded")
    placed = classes.select("name", "vector").mapInArrow(partial(_placed, sketched=True), "cell bigint, name bigint, s1 bigint, s2 bigint")
    key = ["cell", "p", "q"]
    return (tiled(placed, crowded, "cell", tile).select(*key, "tile", "name", "s1", "s2").repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(partial(_collide, needed=needed), "u bigint, v bigint"))


def _compared(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """For each group of rows (one label, p, q): weights of the vectors linked to each, and stars over the links."""

    def finished(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        names, tile, weight = (held.column(k).to_numpy() for k in ("name", "tile", "n"))
        across = held.column("p")[0].as_py() != held.column("q")[0].as_py()
        for at, x in _matrices(held.column("vector")):
            name, mine, n = names[at], tile[at], weight[at]
            links, u, v = np.zeros(len(at), np.int64), [], []
            for a in range(0, len(at), 512):
                near = x[a : a + 512] @ x.T >= cosine
                near &= (mine[a : a + 512, None] != mine[None]) if across else (name[a : a + 512, None] != name[None])
                links[a : a + 512] = near @ n
                i, j = np.nonzero(near)
                node, root = stars(name[a + i], name[j]) if len(i) else (i, j)
                u.append(node)
                v.append(root)
            node, root = stars(np.concatenate(u), np.concatenate(v))
            for kind, columns in ((0, (name, links)), (1, (node, root))):
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(np.full(len(columns[0]), kind, np.int32))], names=["name", "value", "kind"])

    rest, last = [], None
    for batch in batches:
        label, p, q = (batch.column(k).to_numpy() for k in ("label", "p", "q"))
        cuts = [0, *(np.flatnonzero((np.diff(label) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = (label[a], p[a], q[a])
            if rest and key != last:
                yield from finished(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
            last = key
    if rest:
        yield from finished(rest)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, tile: int = TILE, vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: how many other vectors are linked, the smallest vec_id reachable.

    Links are pairs with a cosine of ``cosine`` or more that meet as candidates, and all others in their groups. A vector
    that is null, empty, zero or holds a null or non-finite component links with nothing; neither do vectors of different
    sizes. Equal vectors are linked. Repeated rows count as other vectors. A null vec_id never names a component unless none
    of it has one; ``kept`` says that vec_id is component_id, null being equal to null. An empty table gives no rows; other
    columns are ignored. A cosine below 0.9 is refused: the tables are chosen for near copies.
    """
    if not 0.9 <= cosine <= 1:
        raise ValueError("The tables are chosen for a cosine from 0.9 to 1.")
    source = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    named = source.mapInArrow(_named, "vec_id bigint, name bigint, vector array<double>")
    narrow = vectors.schema[vector].dataType.simpleString() == "array<float>"
    packed = F.col("vector").cast("array<float>") if narrow else F.col("vector")  # exact: the components were floats
    least_id, copies = F.min("vec_id").alias("least_id"), F.count("*").alias("n")
    classes = named.where("name IS NOT NULL").groupBy("name").agg(least_id, copies, F.first(packed).alias("vector"))
    classes = written(classes, "classes")
    labels = components(candidate_stars(classes, least_count(cosine, recall), tile))
    labels = labels.unionByName(labels.select(F.col("v").alias("u"), "v").distinct()).toDF("name", "label")
    large = written(labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > tile), "large")
    members = tiled(labels, large, "label", tile).join(classes.select("name", "n", "vector"), "name")
    key = ["label", "p", "q"]
    found = members.select(*key, "tile", "name", "n", "vector").repartition(*key).sortWithinPartitions(*key)
    found = written(found.mapInArrow(partial(_compared, cosine=cosine), "name bigint, value bigint, kind int"), "links")
    links = found.where("kind = 0").groupBy("name").agg(F.sum("value").alias("links"))
    roots = components(found.where("kind = 1").select(F.col("name").alias("u"), F.col("value").alias("v"))).toDF("name", "root")
    rooted = classes.select("name", "least_id", "n").join(roots, "name", "left").join(links, "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    done = rooted.join(least, "root").select("name", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = written(done, "components")
    rows = named.select("vec_id", "name").join(done, "name", "left")
    component: Column = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
