"""Exact duplicates through a minimal perfect hash over the digests already seen.

The history (an earlier delivery, or one part of a table) is reduced to one winner per digest and stored in shards. A shard
holds a minimal perfect hash, built level by level: a key takes the bit that it alone asks for, keys that collide go on to
the next level, and the slot of a key is the number of bits set before its own. A slot holds the full digest with the
winner and the number of copies, so a lookup compares all 32 bytes and never takes a stranger for a member. New digests
are reduced in the same way and routed to their shard; those that are no members form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import SPACE, written

#: Bits per key and level. Digests per shard (about 50 bytes each).
LOOSENESS, SHARD = 2, 50_000
DIGEST = 32


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each digest (n x 4 words) on a level: a multiplicative mix of its words with odd constants by level."""
    odd = np.random.default_rng(level).integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (keys * odd).sum(axis=1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels (bit arrays) of a minimal perfect hash over distinct keys, and the slot of each key."""
    levels, slots, left, used = [], np.empty(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        size = max(64, LOOSENESS * len(left))
        place = _places(keys[left], len(levels), size)
        alone = np.bincount(place, minlength=size) == 1
        won = alone[place]
        slots[left[won]] = used + (np.cumsum(alone) - 1)[place[won]]
        used += int(alone.sum())
        levels.append(alone)
        left = left[~won]
    return levels, slots


def look_up(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; -1, or the slot of another key, for those that are no members."""
    slots, left, used = np.full(len(keys), -1), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        place = _places(keys[left], level, len(bits))
        hit = bits[place]
        slots[left[hit]] = used + (np.cumsum(bits) - 1)[place[hit]]
        used += int(bits.sum())
        left = left[~hit]
    return slots


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, DIGEST // 8)


def _store(group: pd.DataFrame) -> pd.DataFrame:
    keys = _words(group["digest"])
    levels, slots = build(keys)
    digest, winner, has = np.empty_like(keys), np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    copies = np.empty(len(keys), np.int64)
    digest[slots], has[slots], copies[slots] = keys, group["winner"].notna(), group["copies"]
    winner[slots] = [0 if pd.isna(w) else w for w in group["winner"]]
    sizes = np.array([len(bits) for bits in levels], np.int64)
    packed = np.packbits(np.concatenate(levels), bitorder="little")
    row = [group["shard"].iloc[0], sizes.tobytes(), packed.tobytes(), digest.tobytes(), winner.tobytes(), has.tobytes(), copies.tobytes()]
    return pd.DataFrame([row], columns=["shard", "sizes", "bits", "digests", "winners", "has_winner", "copies"])


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.sum("n").alias("copies"))


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("bigint"), F.lit(shards)).cast("int"))


def perfect_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard with the hash and its slots. ``history`` has digest, winner and copies, one row per digest."""
    kind = "shard int, sizes binary, bits binary, digests binary, winners binary, has_winner binary, copies binary"
    return _sharded(history.select("digest", F.col("winner").cast("string"), "copies"), shards).groupBy("shard").applyInPandas(_store, kind)


def _merge(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Groups of one shard: the stored ones, with what the new digests add to them, and the new ones."""
    winner = np.array([None if pd.isna(w) else int(w) for w in new["winner"]], object)
    fresh, parts = np.ones(len(new), bool), []
    if len(index):
        row = index.iloc[0]
        sizes = np.frombuffer(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum()), bitorder="little").astype(bool)
        levels = np.split(bits, np.cumsum(sizes)[:-1])
        digest = np.frombuffer(row["digests"], np.uint64).reshape(-1, DIGEST // 8)
        has = np.frombuffer(row["has_winner"], bool)
        best = np.where(has, np.frombuffer(row["winners"], np.int64).astype(object), None)
        copies = np.frombuffer(row["copies"], np.int64).copy()
        if len(new):
            keys = _words(new["digest"])
            slots = look_up(levels, keys)
            member = slots >= 0
            member[member] = (digest[slots[member]] == keys[member]).all(axis=1)  # all 32 bytes
            fresh = ~member
            copies[slots[member]] += new["copies"].to_numpy()[member]
            for slot, other in zip(slots[member], winner[member]):
                best[slot] = min((w for w in (best[slot], other) if w is not None), default=None)
        data = digest.tobytes()
        parts.append(pd.DataFrame({"digest": [data[i : i + DIGEST] for i in range(0, len(data), DIGEST)],
                                   "keep_id": best, "group_size": copies}))
    parts.append(pd.DataFrame({"digest": new["digest"][fresh], "keep_id": winner[fresh], "group_size": new["copies"][fresh]}))
    out = pd.concat([p for p in parts if len(p)] or parts[:1])
    return out.assign(keep_id=[None if w is None else str(w) for w in out["keep_id"]])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with each run of ASCII white space as one space; null counts as empty."""
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


def exact_duplicates(history: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): one row per row of both tables, dropped ones too.

    Of equal texts the row with the smallest doc_id stays, of several rows with that doc_id and text one. A null doc_id
    counts as larger than all others; where a group has none else, keep_id is null and one row stays. Empty tables are
    fine on either side. Copies are counted in every task before anything is shuffled, so a text that makes up a third of
    all rows is no hot key. Columns other than doc_id and text are ignored.
    """
    old_rows, new_rows = (written(digests(d).groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digests") for d in (history, new))
    old, fresh = _winners(old_rows), _winners(new_rows)
    shards = 1 + max(old_rows.count(), new_rows.count()) // SHARD
    index = written(perfect_index(old, shards), "index")
    routed = _sharded(fresh.select("digest", F.col("winner").cast("string"), "copies"), shards)
    groups = index.groupBy("shard").cogroup(routed.groupBy("shard")).applyInPandas(_merge, "digest binary, keep_id string, group_size bigint")
    groups = groups.select("digest", F.col("keep_id").cast("bigint"), "group_size")
    rows = old_rows.unionByName(new_rows).groupBy("digest", "doc_id").agg(F.sum("n").cast("int").alias("n"))
    copy = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")
    return rows.join(groups, "digest").select("*", copy).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest")
