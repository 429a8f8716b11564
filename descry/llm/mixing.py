"""Mixing sources to target weights: token blocks, multinomial shard counts, pseudorandom index permutations.

The words of a source, in order of doc_id, are packed into blocks of a fixed number of words; the last block of a source is
its tail. The mix of a source takes its words once, and again as far as its target exceeds them; each such epoch takes whole
blocks in the order of a permutation keyed by source and epoch, then the tail, and ends inside a block where the target
does. The slots of all sources are dealt to output shards: the counts of a shard are a multinomial draw. They are drawn
along a tree over the shards, halving the range with a draw at each node and keeping within what is left of each source, so
that every source meets its target exactly and any task can find the counts and the first slots of its own shards alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from descry.llm.common import map_texts, word_count, written

#: Words per block, blocks per output shard, share of all words that the mix takes, weights in turn, most uses of a word.
BLOCK, SHARD_BLOCKS, SHARE, WEIGHTS, MOST = 512, 4096, 1.5, (3.0, 1.0, 2.0), 2.0
#: Rows of a source that are laid out together.
CHUNK = 4096
SEED = 42
_M64 = (1 << 64) - 1


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words that each source gives: the total goes by weight, no source above ``most`` times its size, the excess again
    by weight to the others. Sources in code point order, null last, take the weights in turn."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict[str | None, float] = {}
    while True:
        free = [s for s in order if s not in fixed]
        left, total = share * sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        given = {s: left * weight[s] / total for s in free}
        over = [s for s in free if given[s] > most * sizes[s]]
        if not over:
            return fixed | given
        fixed |= {s: most * sizes[s] for s in over}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. size-1: a Feistel network over the next even number of bits, walked back into range."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for turn in range(6):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & _M64)
            left, right = right, left ^ (_mix(right + salt) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def shard_counts(first: int, last: int, shards: int, totals: np.ndarray, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot of each source, slots of each source) for the shards first .. last-1; shards are equally full."""
    everything = int(totals.sum())

    def bound(shard: int) -> int:
        return everything * shard // shards

    def descend(low: int, high: int, start: np.ndarray, counts: np.ndarray):
        if low >= last or high <= first:
            return
        if high - low == 1:
            yield low, start, counts
            return
        middle = (low + high) // 2
        wanted, total = bound(middle) - bound(low), bound(high) - bound(low)
        draw = np.random.default_rng([seed, low, high]).multinomial(wanted, counts / total) if total else np.zeros_like(counts)
        draw = np.clip(draw, np.maximum(0, counts - (total - wanted)), counts)
        for step in (1, -1):  # what the bounds have cut off goes to sources with room, the largest first
            missing = (wanted - int(draw.sum())) * step
            room = (counts - draw if step == 1 else draw).copy()
            for s in np.argsort(-room, kind="stable"):
                if missing <= 0:
                    break
                part = min(missing, int(room[s]))
                draw[s] += step * part
                missing -= part
        yield from descend(low, middle, start, draw)
        yield from descend(middle, high, start + draw, counts - draw)

    yield from descend(0, shards, np.zeros_like(totals), totals.copy())


def _plan(sizes: list[int], wanted: list[int], block: int) -> np.ndarray:
    """Slots per source."""
    return np.array([sum(-(-part // block) for part in _epochs(size, want)) for size, want in zip(sizes, wanted)], np.int64)


def _epochs(size: int, want: int) -> list[int]:
    """Words taken in each pass over a source."""
    return [min(size, want - e * size) for e in range(-(-want // size))] if size else []


def _slots(batches: Iterator[pa.RecordBatch], sizes: list[int], wanted: list[int], block: int, shards: int, seed: int) -> Iterator[pa.RecordBatch]:
    totals = _plan(sizes, wanted, block)
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for low, high in _ranges(ids):
            for shard, start, counts in shard_counts(low, high, shards, totals, seed):
                source = np.repeat(np.arange(len(counts)), counts)
                place = np.random.default_rng([seed, shard]).permutation(len(source))  # order of the slots in the shard
                slot = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + start[source]
                index, words, epoch = (np.zeros(len(source), np.int64) for _ in range(3))
                for s in map(int, np.flatnonzero(counts)):
                    mine, full, at = source == s, sizes[s] // block, 0
                    for e, part in enumerate(_epochs(sizes[s], wanted[s])):
                        number = -(-part // block)
                        here = mine & (slot >= at) & (slot < at + number)
                        local = slot[here] - at
                        key = seed * 1_000_003 + s * 101 + e
                        index[here] = np.where(local < full, permuted(np.minimum(local, max(full - 1, 0)), max(full, 1), key), full)
                        words[here] = np.minimum(block, part - local * block)
                        epoch[here] = e
                        at += number
                columns = [np.full(len(source), shard), place, source.astype(np.int32), index, epoch.astype(np.int32), words]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "slot", "source_no", "block", "epoch", "words"])


def _ranges(ids: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(ids) != 1) + 1
    return [(int(part[0]), int(part[-1]) + 1) for part in np.split(ids, cuts) if len(part)]


def _laid_out(sized: DataFrame) -> DataFrame:
    """``sized`` with ``start``: the first word of each row in its source. Hot sources are laid out in chunks."""
    spread = sized.withColumn("chunk", F.floor(F.col("doc_id") / CHUNK))
    spread = spread.withColumn("chunk", F.coalesce("chunk", F.lit((1 << 62))))  # without a doc_id: last
    per_chunk = spread.groupBy("source_no", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = Window.partitionBy("source_no").orderBy("chunk")
    per_chunk = per_chunk.withColumn("offset", F.sum("chunk_size").over(before) - F.col("chunk_size")).drop("chunk_size")
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return (spread.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(per_chunk, ["source_no", "chunk"]).withColumn("start", F.col("offset") + F.col("inner")).drop("chunk", "inner", "offset"))


def mixed(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` as (rows, pieces).

    ``rows``: doc_id, source, digest, copy, size, source_size, target, source_no, start, one row per document. ``pieces``:
    for each slot of the mix and each document in its block, shard, slot, epoch, source_no, start (of the document),
    doc_id, size, ``from_word`` and ``words``, the words of the document that stand in that slot.

    Words are runs of characters other than ASCII white space; null has none. A null source is a source. Documents without
    words are never taken, sources without words get target 0. Equal rows share what is taken of them in order of their
    ``copy``. Everything depends on the rows and the seed alone, not on partitions. The number of sources is assumed to
    fit on the driver, as their weights do; all else is distributed.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        word_count().alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    sized = written(sized, "sizes")
    per_source = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    if not per_source:
        per_source = {None: 0}
    goal = targets(per_source)
    order = list(goal)
    rows = pd.DataFrame([(i, s, per_source[s], float(goal[s])) for i, s in enumerate(order)], columns=["source_no", "named", "source_size", "target"])
    schema = "source_no int, named string, source_size bigint, target double"
    known = spark.createDataFrame([tuple(r) for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False)], schema)
    laid = _laid_out(sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("named"))).drop("named"))
    laid = written(laid, "layout")
    sizes, wanted = [per_source[s] for s in order], [int(goal[s] + 0.5) for s in order]
    slots = int(_plan(sizes, wanted, block).sum())
    shards = max(1, -(-slots // shard_blocks))
    tasks = max(1, min(shards, spark.sparkContext.defaultParallelism * 4))
    draw = partial(_slots, sizes=sizes, wanted=wanted, block=block, shards=shards, seed=seed)
    drawn = spark.range(0, shards if slots else 0, 1, tasks).mapInArrow(draw, "shard bigint, slot bigint, source_no int, block bigint, epoch int, words bigint")
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = laid.where("size > 0").select("source_no", "start", "size", "doc_id", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    low, end = F.col("block") * block, F.col("start") + F.col("size")
    parts = parts.withColumn("low", F.greatest("start", low) - low).withColumn("high", F.least(end, low + block) - low)
    taken = drawn.join(parts, ["source_no", "block"]).withColumn("high", F.least("high", "words")).where("high > low")
    pieces = taken.select("shard", "slot", "epoch", "source_no", "start", "doc_id", "size",
                          (F.col("block") * block + F.col("low") - F.col("start")).alias("from_word"), (F.col("high") - F.col("low")).alias("words"))
    return laid, pieces


def taken_words(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document; the conventions are those of ``mixed``."""
    laid, pieces = mixed(docs, **settings)
    sums = pieces.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    used = laid.where("size > 0").join(sums, ["source_no", "start"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    return used.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(
        laid.where("size = 0").select(*columns, F.lit(0).cast("bigint").alias("taken")))


def _cut_setup(names: list[str]):
    import regex

    word = regex.compile(rb"[^\x20\x09-\x0D]+")

    def cut(text: bytes, pieces: list[dict]) -> str:
        spans = [m.span() for m in word.finditer(text)]
        runs: list[list[int]] = []  # epoch, first word, end
        for p in pieces:
            if runs and runs[-1][0] == p["epoch"] and runs[-1][2] == p["from_word"]:
                runs[-1][2] += p["words"]
            else:
                runs.append([p["epoch"], p["from_word"], p["from_word"] + p["words"]])
        return b" ".join(text if b - a == len(spans) else text[spans[a][0] : spans[b - 1][1]] for _, a, b in runs).decode()

    def handle(batch: pa.RecordBatch) -> dict:
        out = list(map(cut, batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__ranges").to_pylist()))
        return {name: out if name == "text" else batch.column(name) for name in names}

    return handle


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each row with the words of it that the mix takes, in the columns of ``docs``.

    What an epoch takes of a document comes as runs of neighbouring words with the white space between them, runs joined
    by a space; a document taken whole keeps its text as it is, one that is taken twice has it twice, and one of which
    nothing is taken is left out. n_chars, where it exists, counts the new text.
    """
    laid, pieces = mixed(docs, **settings)
    ranges = pieces.groupBy("source_no", "start").agg(F.sort_array(F.collect_list(F.struct("epoch", "from_word", "words"))).alias("__ranges"))
    key = ["__doc", "__source", "__size", "__digest"]
    named = laid.where("size > 0").join(ranges, ["source_no", "start"]).select(
        F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("size").alias(key[2]), F.col("digest").alias(key[3]), "source_no", "start", "__ranges")
    # Equal rows differ in their start alone; they are numbered on both sides.
    named = named.withColumn("__copy", F.row_number().over(Window.partitionBy(*key).orderBy("start"))).drop("source_no", "start")
    texts = docs.withColumns({key[0]: F.col("doc_id").cast("bigint"), key[1]: F.col("source").cast("string"), key[2]: word_count(),
                              key[3]: F.xxhash64(F.coalesce("text", F.lit("")))}).where("`__size` > 0")
    texts = texts.withColumn("__copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*key, "__copy"]]
    joined = texts.alias("t").join(named.alias("r"), same).select(*[f"t.`{c}`" for c in docs.columns], "r.__ranges")
    fields = [(f.name, f.dataType.simpleString(), to_arrow_type(f.dataType)) for f in docs.schema]
    out = map_texts(joined, _cut_setup, docs.columns, fields)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
