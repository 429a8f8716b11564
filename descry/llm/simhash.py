"""Near-duplicates by SimHash, found with a covering code as anchor points.

Two blocks of 23 bits of a fingerprint are each covered by the binary Golay code, which is perfect with radius 3: every
fingerprint has exactly one anchor, a pair of codewords, within the radius in both blocks. If two fingerprints differ in at
most two bits, then the anchor of one lies within the radius plus those bits of the other. So each fingerprint goes to its
own anchor as a resident and to every further anchor within radius plus two as a visitor (about 61 of 2^24), and residents
are compared with all that came to their anchor. No pair is missed, whatever the group. Of the pairs found, a task passes on
only spanning stars; components over these are those over all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from descry.llm.common import map_texts, utf8, written
from descry.llm.components import components, stars

#: Length, dimension and generator polynomial of the binary Golay code.
LENGTH, DIMENSION, GENERATOR = 23, 12, 0b110001110101
RADIUS, THRESHOLD = 3, 2
#: Pairs compared at a time.
BLOCK = 1 << 20


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the word shingles (ASCII lower case; a shorter text is one shingle; no word: 0)."""
    words = text.lower().split()
    if not words:
        return 0
    joined, count = b" ".join(words), max(1, len(words) - width + 1)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    shingles = zip(ends, ends[min(width, len(words)) :])
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in shingles), np.uint64, count)
    ones = sum(np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
               for i in range(0, count, BLOCK))
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.int64)[0])


def _fingerprint_setup(width: int):
    def handle(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "fp": np.array([fingerprint(t, width) for t in utf8(batch)], np.int64)}

    return handle


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) per document. Null counts as empty; an empty text has fingerprint 0."""
    fields = [("doc_id", "bigint", pa.int64()), ("fp", "bigint", pa.int64())]
    return map_texts(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), _fingerprint_setup, width, fields)


@lru_cache(maxsize=1)
def _code():
    """Syndromes of single bits, and for each syndrome the error patterns of up to 3, of 4 and of 5 bits, as ragged lists."""
    single = []
    for bit in range(LENGTH):
        rest = 1 << bit
        for high in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - (LENGTH - DIMENSION))
        single.append(rest)
    single = np.array(single)
    lists = []
    for weights in (range(1, RADIUS + 1), [RADIUS + 1], [RADIUS + 2]):
        none = np.zeros(int(len(weights) > 1), np.int64)  # the pattern without an error
        patterns, syndromes = [none], [none]
        for weight in weights:
            places = np.array(list(combinations(range(LENGTH), weight)), np.int64)
            patterns.append((1 << places).sum(axis=1))
            syndromes.append(np.bitwise_xor.reduce(single[places], axis=1))
        pattern, syndrome = np.concatenate(patterns), np.concatenate(syndromes)
        order = np.argsort(syndrome, kind="stable")
        lists.append((pattern[order], np.searchsorted(syndrome[order], np.arange((1 << (LENGTH - DIMENSION)) + 1))))
    return single, lists


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, anchor * 2 + is_visitor) of every anchor that each fingerprint goes to."""
    single, lists = _code()
    blocks, syndromes = [], []
    for shift in (0, LENGTH):
        block = fp.view(np.uint64) >> np.uint64(shift) & np.uint64((1 << LENGTH) - 1)
        block = block.astype(np.int64)
        syndromes.append(np.bitwise_xor.reduce([single[b] * (block >> b & 1) for b in range(LENGTH)]))
        blocks.append(block)
    where, found = [], []
    for first, second in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)):  # bits beyond the radius in the two blocks
        (p, p_at), (q, q_at) = lists[first], lists[second]
        a, b = syndromes
        n, m = p_at[a + 1] - p_at[a], q_at[b + 1] - q_at[b]
        i = np.repeat(np.arange(len(fp)), n * m)
        local = np.arange(len(i)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        words = (blocks[0][i] ^ p[p_at[a][i] + local // m[i]], blocks[1][i] ^ q[q_at[b][i] + local % m[i]])
        message = LENGTH - DIMENSION
        found.append(((words[0] >> message << DIMENSION | words[1] >> message) << 1) | int(bool(first or second)))
        where.append(i)
    return np.concatenate(where), np.concatenate(found)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fps = batch.column("fp").to_numpy()
        for start in range(0, len(all_fps), 4096):
            fp = all_fps[start : start + 4096]
            where, anchor = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(fp[where], pa.int64())], names=["anchor", "fp"])


def close_pairs(group: np.ndarray, resident: np.ndarray, fp: np.ndarray, bits: int | Callable, name: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of residents a and members b of the same group, with different names, whose fingerprints differ in
    at most ``bits`` bits, or for which the function ``bits`` of two arrays of fingerprints holds. They come block by block, all those of one resident together; the caller reduces each block.
    The arrays are sorted by group, residents first.
    """
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(starts, append=len(group))
    homes = np.add.reduceat(resident.astype(np.int64), starts)
    each = np.repeat(size, homes)  # partners of each resident
    residents = np.flatnonzero(resident)
    first = np.repeat(starts, homes)
    total = np.cumsum(each)
    at = 0
    while at < len(residents):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + BLOCK, side="right")))
        a = np.repeat(residents[at:to], each[at:to])
        b = np.repeat(first[at:to] - (total[at:to] - each[at:to] - base), each[at:to]) + np.arange(len(a))
        near = (bits(fp[a], fp[b]) if callable(bits) else np.bitwise_count(fp[a] ^ fp[b]) <= bits) & (name[a] != name[b])
        if near.any():
            yield a[near], b[near]
        at = to


def whole_groups(batches: Iterator[pa.RecordBatch], key, read: Callable | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, or what ``read`` makes of these, cut so that rows with one key stay together."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        columns = read(batch) if read else {name: batch.column(name).to_numpy() for name in batch.schema.names}
        if rest is not None:
            columns = {name: np.concatenate([rest[name], columns[name]]) for name in columns}
        keys = key(columns)
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield {name: c[:cut] for name, c in columns.items()}
        rest = {name: c[cut:] for name, c in columns.items()}
    if rest is not None and len(key(rest)):
        yield rest


def _compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for part in whole_groups(batches, lambda c: c["anchor"] >> 1):
        fp = part["fp"].view(np.uint64)
        for a, b in close_pairs(part["anchor"] >> 1, part["anchor"] & 1 == 0, fp, bits, fp):
            node, root = stars(part["fp"][a], part["fp"][b])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])


def fingerprint_links(distinct: DataFrame, bits: int = THRESHOLD) -> DataFrame:
    """(u, v): links between the fingerprints of ``distinct`` (column fp) that connect what all pairs within ``bits`` do."""
    if not 0 <= bits <= THRESHOLD:
        raise ValueError(f"The anchors are chosen for at most {THRESHOLD} bits.")
    placed = distinct.select("fp").mapInArrow(_spread, "anchor int, fp bigint")
    return (placed.repartition(F.shiftright("anchor", 1)).sortWithinPartitions("anchor")
            .mapInArrow(partial(_compare, bits=bits), "u bigint, v bigint"))


def _components(docs: DataFrame, width: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp) of the documents, and (fp, root, least_id) of their fingerprints: the component and the least doc_id."""
    fps = written(fingerprints(docs, width), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(fingerprint_links(classes, bits))
    return fps, classes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("root"), "least_id")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) per document: the smallest doc_id reachable over fingerprints within ``bits``.

    Null texts count as empty; all texts without a word share fingerprint 0 and are linked like any other. Equal
    fingerprints collapse before anything is compared. A null doc_id belongs to its component but is never its name, unless
    no document of it has one. Repeated rows get equal results. An empty table gives no rows. Only doc_id and text are read.
    """
    fps, merged = _components(docs, width, bits)
    least = merged.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(merged.join(least, "root").select("fp", "component_id"), "components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _printed_rows_setup(width: int):
    def handle(batch: pa.RecordBatch) -> dict:
        return dict(zip(batch.schema.names, batch.columns)) | {"__fp": np.array([fingerprint(t, width) for t in utf8(batch)], np.int64)}

    return handle


def one_of_each(docs: DataFrame, width: int = 3, bits: int = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest doc_id stays, once if repeated.

    A doc_id may stand for several texts: rows are told apart by it and their fingerprint. Of rows of one component with the
    same doc_id one fingerprint stays, of rows with the same doc_id and fingerprint one row. Rows without a doc_id stay, as
    nothing can refer to them. All columns are returned.
    """
    _, classes = _components(docs, width, bits)
    stays = classes.where("least_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("least_id", "fp")).alias("s")).selectExpr("s.least_id AS __id", "s.fp AS __name")
    fields = [(f.name, f.dataType.simpleString(), to_arrow_type(f.dataType)) for f in docs.schema]
    rows = map_texts(docs.where("doc_id IS NOT NULL"), _printed_rows_setup, width, [*fields, ("__fp", "bigint", pa.int64())])
    kept = rows.join(stays, (F.col("doc_id").cast("bigint") == F.col("__id")) & (F.col("__fp") == F.col("__name")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__fp"]).select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
