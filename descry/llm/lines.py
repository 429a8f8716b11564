"""Fuzzy duplicates of lines across all documents.

Lines are normalised (lower case, ASCII punctuation and white space as one blank). Equal lines collapse by a 128-bit digest.
Candidates come from buckets: a line goes to one for each of several least hashes of its byte n-grams; n grows with the
length of the line, and a line that can be alike to one of the next class of lengths goes to the buckets of that class, too.
Copies of a line go to its buckets once for each slice of documents. SimHashes decide which pairs of a bucket are looked at
further: one of 56 bits, which travels with the line, and for long lines one of 256 bits over byte n-grams, which is looked
up for pairs. (SimHash blocks by the pigeonhole principle do not find lines of edit similarity 0.8: a changed letter in ten
turns a third of the bits. The README has figures.) In a bucket every line is compared with all others, but only one link of
each is passed on, to the closest line or the least of the very close ones; the edit similarity of each link is verified on
the texts. Links that can still join two groups after that, all of them, are found and verified in a second turn among the
lines that are close to any other: these go to their buckets with their texts, a pair is compared in one of the buckets that
it shares, and a task passes on spanning stars of what it found, so that rows grow with the lines and not with the pairs. Of
every connected group the first occurrence, by doc_id and line number, stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from descry.llm.common import SLICE_BYTES, map_texts, slices, utf8, written
from descry.llm.components import components, stars
from descry.llm.minhash import BLOCK, NONE, _parts, band_keys, binned_signatures, gram_signatures, joined, mixed, window_hashes
from descry.llm.simhash import close_pairs, whole_groups

#: Least edit similarity.
SIMILARITY = 0.8
#: Least lengths in characters of the classes of lines and the bytes of their n-grams; least hashes taken, a bucket each.
LENGTHS, GRAMS, BUCKETS = (0, 12, 24, 64), (3, 5, 8, 14), 16
#: Lines of this length on are compared by 56 bits of the SimHash of their words, shorter ones by the set of their letters.
#: Pairs that differ in more bits are strangers; among those that differ in VERY_CLOSE bits or fewer the least line is taken.
SHORT, SKETCH_BITS, VERY_CLOSE = 24, 22, 12
#: Lines of this length on have a SimHash of 4 x 64 bits over their n-grams of this width, which is looked up for pairs; most
#: bits in which alike lines differ.
LONG, LONG_GRAM, LONG_BITS = 128, 8, 108
#: Bits per line of the membership filter and the largest filter that is sent to the executors; beyond it a join decides.
FILTER_BITS, FILTER_BYTES = 16, 64 << 20
#: Pairs that are collected before their edit distances are looked at; entries of a table for pairs that are looked at together,
#: and the kinds of characters that it tells apart.
WAITING, TABLE, KINDS = 1 << 15, 1 << 21, 64
_LAST = (1 << 63) - 1

_BLANKS = bytes.maketrans(bytes(c for c in range(33, 127) if not chr(c).isalnum()), b" " * 32)


def normal_lines(text: str) -> list[bytes]:
    """The normalised lines of a text; those without a letter, a digit or a character beyond ASCII are empty."""
    return [b" ".join(line.split()) for line in text.lower().encode().translate(_BLANKS).split(b"\n")]


#: The lowest bit of each byte of a number.
_LOWEST = np.uint64(0x0101010101010101)
#: Values counted together, so that no counter of one byte overflows; values handled at a time.
_RUN, _VALUES = 255, 1 << 16


def majority_bits(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For successive parts of ``flat``, none empty, the bits that are set in more than half of their values."""
    runs = -(-sizes // _RUN)  # a long part is counted in several runs
    part = np.repeat(np.arange(len(sizes)), runs)
    within = np.arange(len(part)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = (np.cumsum(sizes) - sizes)[part] + within * _RUN
    ones = np.zeros((len(sizes), 64), np.int32)
    cuts = np.flatnonzero(np.diff(starts // _VALUES, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(starts)]):
        first, last = starts[a], starts[b] if b < len(starts) else len(flat)
        values = flat[first:last]
        # Eight counters a number: those of the k-th bits of its bytes.
        sums = np.stack([np.add.reduceat(values >> np.uint64(k) & _LOWEST, starts[a:b] - first) for k in range(8)], axis=1).view(np.uint8)
        sums = sums.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
        if runs.max() == 1:
            ones[part[a:b]] = sums
        else:
            edges = np.flatnonzero(np.append(True, part[a + 1 : b] != part[a : b - 1]))
            ones[part[a:b][edges]] += np.add.reduceat(sums.astype(np.int32), edges, axis=0)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def different(values: np.ndarray) -> np.ndarray:
    """The different values in order; sorting takes a small part of the time of ``np.unique``, which hashes them."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def distinct_hashes(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in successive parts of ``hashes``, hashed again, and their numbers. Else a frequent word or n-gram
    would decide most bits, and strangers of one language would look alike."""
    bits = np.uint64(21)  # a slice of BLOCK bytes has fewer lines; the same for all, as hashes must not depend on neighbours
    keyed = different(np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << (np.uint64(64) - bits) | hashes >> bits)
    return mixed((keyed << bits) * _BASE), np.bincount((keyed >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(counts))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_known_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """The first ``count`` powers of a number; some are kept."""
    if count > 2 * BLOCK:
        return np.multiply.accumulate(np.full(count, base, np.uint64))
    if base not in _known_powers:
        _known_powers[base] = np.multiply.accumulate(np.full(2 * BLOCK, base, np.uint64))
    return _known_powers[base][:count]


def line_fingerprints(lines: list[bytes]) -> np.ndarray:
    """SimHash over the distinct words of each line; lines must have a word. Word hashes are differences of running sums."""
    out = [np.zeros(0, np.int64)]
    for part in _parts(lines):
        octets, _, _ = joined(part, 1)
        space = (octets == 32) | (octets == 0)
        sums = np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * powers(int(_BASE), len(octets)))
        back = powers(int(_INVERSE), len(octets))
        ends = np.flatnonzero(space)
        before = np.append(-1, ends[:-1])  # place of the blank before each word
        first = before < 0
        hashes = mixed((sums[ends - 1] - np.where(first, np.uint64(0), sums[before])) * np.where(first, np.uint64(1), back[before]))
        words = np.diff(np.searchsorted(ends, np.flatnonzero(octets == 0)), prepend=-1)
        out.append(majority_bits(*distinct_hashes(hashes, words)))
    return np.concatenate(out)


def long_sketches(lines: list[bytes]) -> np.ndarray:
    """256 bits, as four numbers, of the SimHash over the distinct 8-grams of each line, of which one in eight is taken; zeros
    where none is, and where most are repeats: a few edits then bring in as many new ones as there are."""
    out = [np.zeros((0, 4), np.int64)]
    for part in _parts(lines):
        octets, starts, sizes = joined(part, LONG_GRAM)
        hashes = window_hashes(octets, LONG_GRAM)
        taken = np.flatnonzero(hashes >> np.uint64(61) == 0)
        line = np.searchsorted(starts, taken, side="right") - 1
        inside = taken < starts[line] + sizes[line] - LONG_GRAM + 1
        every = np.bincount(line[inside], minlength=len(part))
        flat, counts = distinct_hashes(hashes[taken[inside]], every)
        some, found = np.flatnonzero(counts), np.zeros((len(part), 4), np.int64)
        for k in range(4 if len(some) else 0):
            found[some, k] = majority_bits(mixed((flat + np.uint64(k + 1)) * _BASE), counts[some])
        found[2 * counts < every] = 0
        out.append(found)
    return np.concatenate(out)


def _digests(line: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(line)
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _line_setup(_):
    def handle(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch)
        rows = [(i, n, line) for i, text in enumerate(texts) for n, line in enumerate(normal_lines(text.decode())) if line]
        lines = [line for _, _, line in rows]
        digest = np.array([_digests(line) for line in lines], np.int64).reshape(-1, 2)
        docs = np.array([_LAST if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
        at = np.array([i for i, _, _ in rows], np.int64)
        long = np.fromiter((len(line.decode()) >= LONG for line in lines), bool, len(lines))
        sketch = np.zeros((len(lines), 4), np.int64)
        sketch[long] = long_sketches([line for line, is_long in zip(lines, long.tolist()) if is_long])
        absent = ~sketch.any(axis=1)
        return {"doc": docs[at] if len(at) else at, "row": np.array([xxhash.xxh64_intdigest(t, 42) >> 1 for t in texts], np.int64)[at] if len(at) else at,
                "line": np.array([n for _, n, _ in rows], np.int32), "h1": digest[:, 0], "h2": digest[:, 1]} | {
                f"s{k}": pa.array(sketch[:, k], pa.int64(), mask=absent) for k in range(4)}

    return handle


def _letters(line: str) -> int:
    """The set of the characters in 56 bits; one edit changes two of them at most."""
    mask = 0
    for c in set(line):
        mask |= 1 << ord(c) % 56
    return mask


def gram_buckets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in lines, bucket, sketch) for all buckets of each line. The lowest six bits of a bucket are the class of lengths
    and the number of the least hash. The lowest eight bits of a sketch are the length of a short line, else 64 and the logarithm
    of the length."""
    texts = [line.decode() for line in lines]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    lowest, highest = (np.searchsorted(LENGTHS, n, side="right") - 1 for n in (sizes, sizes * 5 // 4))
    where, keys, sketches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, (least, width) in enumerate(zip(LENGTHS, GRAMS)):
        at = np.flatnonzero((lowest <= number) & (number <= highest))
        if not len(at):
            continue
        mine = [lines[i] for i in at]
        binned = number == len(LENGTHS) - 1
        signatures = (binned_signatures if binned else gram_signatures)(mine, width, BUCKETS)
        key = band_keys(signatures, 1, number + 1).view(np.int64) & ~63 | number << 4 | np.arange(BUCKETS)
        if least < SHORT:
            sketch = np.array([_letters(texts[i]) << 8 for i in at], np.uint64) | sizes[at].astype(np.uint64)
        else:
            scale = np.minimum(np.log(sizes[at] / 16) / np.log(1.04), 191).astype(np.uint64)
            sketch = line_fingerprints(mine).view(np.uint64) & ~np.uint64(255) | (np.uint64(64) + scale)
        filled = signatures != NONE if binned else np.ones(key.shape, bool)
        where.append(np.repeat(at, filled.sum(axis=1)))
        keys.append(key[filled])
        sketches.append(np.repeat(sketch.view(np.int64), filled.sum(axis=1)))
    return np.concatenate(where), np.concatenate(keys), np.concatenate(sketches)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of two lines differ."""
    return np.bitwise_count((a ^ b) >> np.uint64(8))


def may_be_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lines with these sketches can be alike: certain for short ones and for lengths, a bound on bits for others."""
    m, n = (a & np.uint64(255)).astype(np.int64), (b & np.uint64(255)).astype(np.int64)
    bits, apart, most = distance(a, b), np.abs(m - n), np.maximum(m, n) // 5
    return np.where(m < 64, (apart <= most) & (bits <= 2 * most), (apart <= 6) & (bits <= SKETCH_BITS))


def _gram_setup(_):
    def handle(batch: pa.RecordBatch) -> dict:
        lines = list({line for text in utf8(batch) for line in normal_lines(text.decode()) if line})
        at, key, sketch = gram_buckets(lines)
        return {"key": key, "fp": sketch, "h1": np.array([_digests(line)[0] for line in lines], np.int64)[at] if lines else key}

    return handle


def _labelled_gram_setup(_):
    def handle(batch: pa.RecordBatch) -> dict:
        lines = utf8(batch, "line_text")
        at, key, sketch = gram_buckets(lines)
        texts = [line.decode() for line in lines]
        chars = np.fromiter(map(len, texts), np.int32, len(texts))
        bits = np.stack([batch.column(f"s{k}").to_numpy() for k in range(4)], axis=1).reshape(-1, 4).copy()
        for i in np.flatnonzero(chars < LONG):
            bits[i] = char_counts(texts[i])
        return {"key": key, "fp": sketch, "h1": batch.column("h1").to_numpy()[at], "label": batch.column("label").to_numpy()[at],
                "chars": chars[at]} | {f"s{k}": bits[at, k] for k in range(4)}

    return handle


_PLACED = [("key", "bigint", pa.int64()), ("fp", "bigint", pa.int64()), ("h1", "bigint", pa.int64())]


def _shared(batches: Iterator[pa.RecordBatch], read: Callable | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Whole buckets with more than one line, each line once in a bucket."""
    for part in whole_groups(batches, lambda c: c["key"], read):
        again = np.append(False, (part["key"][1:] == part["key"][:-1]) & (part["h1"][1:] == part["h1"][:-1]))
        part = {column: values[~again] for column, values in part.items()} if again.any() else part
        same = part["key"][1:] == part["key"][:-1]
        several = np.append(False, same) | np.append(same, False)
        if several.any():
            yield {column: values[several] for column, values in part.items()}


#: Buckets of this many lines on are compared as matrices, so many entries at a time.
CROWD, ENTRIES = 24, 1 << 16


def _crowds(key: np.ndarray, fp: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Where large buckets, of one kind of sketches, start and end, and which lines are in none of them."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends, long = np.append(starts[1:], len(key)), fp & np.uint64(255) >= np.uint64(64)
    kinds = np.add.reduceat(long.astype(np.int64), starts) if len(key) else starts[:0]
    large = np.flatnonzero((ends - starts >= CROWD) & ((kinds == 0) | (kinds == ends - starts))) if len(key) else starts[:0]
    alone = np.ones(len(key), bool)
    for start, end in zip(starts[large], ends[large]):
        alone[start:end] = False
    return list(zip(starts[large].tolist(), ends[large].tolist())), alone


def _tiles(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, near, bits) of parts of the matrix of all pairs of a bucket, all partners of a row together, columns in
    order: whether two lines may be alike, and the distance of their sketches. Partners of other lengths are left out."""
    length, word = (fp & np.uint64(255)).astype(np.int16), fp >> np.uint64(8)
    order = np.argsort(length, kind="stable")
    sizes, long = length[order], length[0] >= 64
    reach, at = 6 if long else 12, 0
    while at < len(fp):
        first, last = np.searchsorted(sizes, sizes[at] - reach), np.searchsorted(sizes, sizes[at] + reach, side="right")
        to = min(len(fp), at + max(1, ENTRIES // int(last - first)))
        last = np.searchsorted(sizes, sizes[to - 1] + reach, side="right")
        rows, columns = order[at:to], np.sort(order[first:last])
        bits = np.bitwise_count(word[rows][:, None] ^ word[columns][None, :])
        if long:
            near = bits <= SKETCH_BITS
            near &= np.abs(length[rows][:, None] - length[columns][None, :]) <= reach
        else:
            near = may_be_alike(fp[rows][:, None], fp[columns][None, :])
        yield rows, columns, near, bits
        at = to


def _closest(fp: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a bucket and their closest ones, where those under VERY_CLOSE count as equally close; names ascend."""
    u, v = [], []
    for rows, columns, near, bits in _tiles(fp):
        far = np.maximum(bits, np.uint8(VERY_CLOSE))
        far[~near] = 255
        each = np.arange(len(rows))
        far[each, np.searchsorted(columns, rows)] = 255
        best = far.argmin(axis=1)
        hit = far[each, best] < 255
        u.append(name[rows[hit]])
        v.append(name[columns[best[hit]]])
    return np.concatenate(u), np.concatenate(v)


def _near_pairs(key: np.ndarray, fp: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), a > b, of lines of one bucket that may be alike and have different labels, each pair once."""
    crowds, alone = _crowds(key, fp)
    for start, end in crowds:
        mine = label[start:end]
        for rows, columns, near, _ in _tiles(fp[start:end]):
            found = np.flatnonzero(near)
            a, b = rows[found // len(columns)], columns[found % len(columns)]
            some = (a > b) & (mine[a] != mine[b])
            if some.any():
                yield a[some] + start, b[some] + start
    place = np.flatnonzero(alone)
    for a, b in close_pairs(key[place], np.ones(len(place), bool), fp[place], may_be_alike, label[place]) if len(place) else ():
        once = a > b
        yield place[a[once]], place[b[once]]


def _compare(batches: Iterator[pa.RecordBatch], every: bool, close: Callable, apart: Callable | None) -> Iterator[pa.RecordBatch]:
    """Close lines of a bucket: ``every`` pair of lines with different labels, or for each line one. That is its least close
    line, or, if ``apart`` tells distances, its closest one, where those under VERY_CLOSE count as equally close."""
    for part in _shared(batches):
        key, name, fp = part["key"], part["h1"], part["fp"].view(np.uint64)
        if not every and close is may_be_alike:
            crowds, alone = _crowds(key, fp)
            for start, end in crowds:
                u, v = _closest(fp[start:end], name[start:end])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            key, name, fp = key[alone], name[alone], fp[alone]
        for a, b in close_pairs(key, np.ones(len(key), bool), fp, close, part["label"] if every else name) if len(key) else ():
            u, v = name[a], name[b]
            if every:
                u, v = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
            else:
                far = np.maximum(apart(fp[a], fp[b]).astype(np.int64), VERY_CLOSE) if apart else np.zeros(len(a), np.int64)
                order = np.lexsort((v, far, a))
                first = order[np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))]
                u, v = u[first], v[first]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def bucket_pairs(placed: DataFrame, every: bool, close: Callable, apart: Callable | None = None) -> DataFrame:
    """Pairs (u, v), u > v, of names h1 that share a key and are ``close`` by fp (see ``close_pairs``), repeated ones once."""
    found = placed.repartition("key").sortWithinPartitions("key", "h1").mapInArrow(partial(_compare, every=every, close=close, apart=apart), "u bigint, v bigint")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    """Two places of each id in a filter of ``size`` bits."""
    x = ids.view(np.uint64)
    return [((x * np.uint64(odd)) >> np.uint64(20)) % np.uint64(size) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def passing(ids: np.ndarray, packed: bytes | None) -> np.ndarray:
    """Which ids the filter lets pass; all without a filter. The bits stay packed."""
    keep = np.ones(len(ids), bool)
    if packed is None or not len(ids):
        return keep
    octets = np.frombuffer(packed, np.uint8)
    for at in places(ids, 8 * len(octets)):
        keep &= (octets[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return keep


def _text_setup(state: bytes | None):
    def handle(batch: pa.RecordBatch) -> dict:
        lines = list({line for text in utf8(batch) for line in normal_lines(text.decode()) if line})
        h1 = np.array([_digests(line)[0] for line in lines], np.int64)
        keep = np.flatnonzero(passing(h1, state))
        return {"h1": h1[keep], "line_text": [lines[i].decode() for i in keep]}

    return handle


def membership(wanted: DataFrame, count: int) -> bytes | None:
    """A filter that lets pass all ids of ``wanted`` and few others; None if it would be too large to send around."""
    octets = -(-max(64, count * FILTER_BITS) // 8)
    if octets > FILTER_BYTES:
        return None

    def fill(batches):
        found = [np.zeros(0, np.uint64)]
        for batch in batches:
            found += [different(np.concatenate(places(batch.column("h1").to_numpy(), 8 * octets)))]
        filled = different(np.concatenate(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(filled >> 13), pa.array(filled & (1 << 13) - 1)], names=["page", "bit"])

    # Set bits are sent page by page; the whole filter is at most FILTER_BYTES.
    pages = wanted.select("h1").mapInArrow(fill, "page bigint, bit bigint").groupBy("page").agg(F.collect_set("bit").alias("bits"))
    packed = np.zeros(octets, np.uint8)
    for row in pages.toLocalIterator():
        at = (row["page"] << 13) + np.array(row["bits"])
        np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return packed.tobytes()


def _trigram_counts(text: str, size: int) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams = (codes[:-2] * np.uint64(961) + codes[1:-1] * np.uint64(31) + codes[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((grams >> np.uint64(40)).astype(np.int64) & (size - 1), minlength=size)


def within_reach(a: str, b: str, most: int) -> bool:
    """False only if the edit distance is over ``most``: one edit changes three of the trigrams of either text at most."""
    if min(len(a), len(b)) < 3:
        return True
    size = max(1024, min(1 << 16, 1 << (4 * max(len(a), len(b))).bit_length()))  # fewer bins only weaken the bound
    return int(np.abs(_trigram_counts(a, size) - _trigram_counts(b, size)).sum()) <= 6 * most


def within_distance(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` or less: a column of the table at a time, its steps as the bits of two numbers."""
    if abs(len(a) - len(b)) > most:
        return False
    start = len(commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return max(len(a), len(b)) <= most
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    last, every = 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, distance = every, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        equal = places.get(c, 0)
        vertical = equal | down
        level = (((equal & up) + up) ^ up) | equal
        rise, fall = down | (every & ~(level | up)), up & level
        distance += (rise & last > 0) - (fall & last > 0)
        if distance - left > most:  # each character to come takes one off at most
            return False
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(vertical | rise)) & every, rise & vertical & every
    return distance <= most


def _table_within(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the edit distances of the pairs (a, b) of parts of ``codes`` are ``most`` or less, for many pairs at once; the
    lengths of b ascend. As ``within_distance``, but a column is kept in words of 64 rows, of which only those within the
    largest ``most`` of the diagonal are worked on: values outside are taken too large, which no short path minds."""
    one, full, shift = np.uint64(1), ~np.uint64(0), np.uint64(63)
    columns, rows, reach = sizes[b], sizes[a], int(most.max())
    lines, at = np.unique(a, return_inverse=True)
    words = -(-int(rows.max()) // 64)
    line = np.repeat(np.arange(len(lines)), sizes[lines])
    place = np.arange(len(line)) - np.repeat(np.cumsum(sizes[lines]) - sizes[lines], sizes[lines])
    equals = np.zeros((words, len(lines) * KINDS), np.uint64)
    np.bitwise_or.at(equals.ravel(), ((place >> 6) * len(lines) + line) * KINDS + codes[starts[lines][line] + place], one << (place & 63).astype(np.uint64))
    pair = np.repeat(np.arange(len(b)), columns)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(columns) - columns, columns)
    text = np.zeros((int(columns[-1]), len(b)), np.uint8)
    text[place, pair] = codes[starts[b][pair] + place]
    base, number, found = at * KINDS, np.arange(len(b)), np.zeros(len(b), bool)
    up, down, top, low = np.full((words, len(b)), full), np.zeros((words, len(b)), np.uint64), np.zeros(len(b), np.int64), 0

    def value(row: np.ndarray, some: slice, to: int) -> np.ndarray:
        """Values in the column at hand, below ``row`` rows."""
        total = top[some].copy()
        for w in range(low, to):
            bits = np.clip(row - 64 * w, 0, 64)
            mask = np.where(bits > 0, full >> (64 - np.maximum(bits, 1)).astype(np.uint64), np.uint64(0))
            total += np.bitwise_count(up[w, some] & mask).astype(np.int64) - np.bitwise_count(down[w, some] & mask)
        return total

    for j in range(len(text)):
        high = min(words, (j + reach) // 64 + 1)
        while low < max(0, j - reach) // 64:
            top += np.bitwise_count(up[low]).astype(np.int64) - np.bitwise_count(down[low])
            low += 1
        top += 1
        rise, fall = one, np.uint64(0)
        entry = base + text[j]
        for w in range(low, high):
            equal, vp, vn = equals[w].take(entry, mode="clip"), up[w], down[w]
            vertical = equal | vn
            equal |= fall
            level = (((equal & vp) + vp) ^ vp) | equal
            more, less = vn | ~(level | vp), vp & level
            rise, fall, before, under = more >> shift, less >> shift, rise, fall
            more, less = more << one | before, less << one | under
            up[w], down[w] = less | ~(vertical | more), more & vertical
        first, end = np.searchsorted(columns, [j + 1, j + 2])
        if first < end:
            some = slice(first, end)
            found[number[some]] = value(rows[some], some, high) <= most[some]
        if j & 31 == 31:  # values along the diagonal to the last one never fall
            keep = (columns > j + 1) & (value(j + 1 + rows - columns, slice(None), high) <= most)
            left = int(keep.sum())
            if not left:
                break
            if 4 * left < 3 * len(keep):
                columns, rows, most, base, number, top = (x[keep] for x in (columns, rows, most, base, number, top))
                up, down, text = up[:, keep], down[:, keep], text[:, keep]
    return found


def all_within(texts: list[str], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the edit distances of the pairs of texts (a, b) are ``most`` or less. Pairs of like lengths are looked at
    together, those of SLICE_BYTES characters at a time, as the tables take many times the memory of the texts."""
    found, sizes = np.zeros(len(a), bool), np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(sizes[b], kind="stable")
    part = np.cumsum(sizes[a[order]] + sizes[b[order]]) // SLICE_BYTES
    for now in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        lines, ends = np.unique(np.concatenate([a[now], b[now]]), return_inverse=True)
        found[now] = _some_within([texts[i] for i in lines], ends[: len(now)], ends[len(now) :], most[now])
    return found


def _some_within(texts: list[str], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    found = np.zeros(len(a), bool)
    if not len(a):
        return found
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    present = np.bincount(points, minlength=1) > 0
    # Kinds of characters beyond the first ones share their numbers with others, which only makes distances smaller.
    codes, exact = ((np.cumsum(present) - 1) % KINDS).astype(np.uint8)[points], present.sum() <= KINDS
    counts = np.bincount(np.repeat(np.arange(len(texts)), sizes) * KINDS + codes, minlength=len(texts) * KINDS).reshape(-1, KINDS).astype(np.int32)
    left = np.abs(sizes[a] - sizes[b]) <= most
    for i in range(0, len(a), WAITING):  # one edit changes two of the counts at most
        s = slice(i, i + WAITING)
        left[s] &= np.abs(counts[a[s]] - counts[b[s]]).sum(axis=1) <= 2 * most[s]
    some = np.flatnonzero(left)
    some = some[np.argsort(sizes[b[some]], kind="stable")]
    at = 0
    while at < len(some):
        ahead = some[at : at + 4096]
        longest = np.maximum.accumulate(np.maximum(sizes[a[ahead]], sizes[b[ahead]]))
        words = longest // 64 + 1
        fits = (np.arange(1, len(ahead) + 1) * words * KINDS <= TABLE) & (sizes[b[ahead]] <= 1.25 * sizes[b[ahead[0]]] + 16)
        now = ahead[: max(1, int(fits.sum()))]
        at += len(now)
        tall = int(words[len(now) - 1])
        # About 20 steps a word and column for all pairs, or 14 longer ones a column for each.
        if sizes[b[now[0]]] and 20 * (0.4 * tall + 1) * (1000 + len(now) / 2) < 14 * len(now) * (50 + 2 * tall):
            near = now[_table_within(codes, starts, sizes, a[now], b[now], most[now])]
            found[near if exact else [i for i in near if within_distance(texts[a[i]], texts[b[i]], int(most[i]))]] = True
        else:
            found[[i for i in now if within_reach(texts[a[i]], texts[b[i]], int(most[i])) and within_distance(texts[a[i]], texts[b[i]], int(most[i]))]] = True
    return found


def _allowed(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor((1 - similarity) * np.maximum(a, b) + 1e-9).astype(np.int64)


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "a"):
            texts, pairs = part.column("a").to_pylist() + part.column("b").to_pylist(), np.arange(part.num_rows)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            keep = all_within(texts, pairs, pairs + len(pairs), _allowed(sizes[: len(pairs)], sizes[len(pairs) :], similarity))
            yield part.select(["u", "v"]).filter(pa.array(keep))


def char_counts(text: str) -> np.ndarray:
    """How often characters come in a text of less than LONG of them, in 32 kinds, as four numbers."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.bincount(points & 31, minlength=32).astype(np.uint8).view(np.int64)


def strangers(sizes_a: np.ndarray, sizes_b: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs that are not looked at further: both long, with sketches that differ in more than LONG_BITS bits, or both short, with
    counts of characters that so few edits cannot make equal (one changes two of them at most)."""
    long_a, long_b = sizes_a >= LONG, sizes_b >= LONG
    out, sketched = np.zeros(len(a), bool), np.flatnonzero(long_a & long_b)
    x, y = a[sketched], b[sketched]
    out[sketched] = x.any(axis=1) & y.any(axis=1) & (np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) > LONG_BITS)
    short = np.flatnonzero(~long_a & ~long_b)
    x, y = (np.ascontiguousarray(z[short]).view(np.uint8).astype(np.int16) for z in (a, b))
    out[short] = np.abs(x - y).sum(axis=1) > 2 * _allowed(sizes_a[short], sizes_b[short], similarity)
    return out


def _sketches(part: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([part[f"s{k}"].view(np.uint64) for k in range(4)], axis=1)


def _partnered(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The lines of a bucket that are close to a line with another label, and no stranger to it."""
    for part in _shared(batches):
        with_partner, sketch = np.zeros(len(part["key"]), bool), _sketches(part)
        for a, b in _near_pairs(part["key"], part["fp"].view(np.uint64), part["label"]):
            for i in range(0, len(a), ENTRIES):
                u, v = a[i : i + ENTRIES], b[i : i + ENTRIES]
                known = ~strangers(part["chars"][u], part["chars"][v], sketch[u], sketch[v], similarity)
                with_partner[u[known]] = with_partner[v[known]] = True
        yield pa.RecordBatch.from_arrays([pa.array(part[name][with_partner]) for name in ("key", "fp", "h1")], names=["key", "fp", "h1"])


def _read_waiting(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    names = ("key", "fp", "h1", "label", "chars", "s0", "s1", "s2", "s3")
    every = batch.column("keys")
    keys, owner = every.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), every.value_lengths().to_numpy())
    own = np.zeros((batch.num_rows, BUCKETS), np.int64)
    own[owner, keys & BUCKETS - 1] = keys
    texts = np.empty(batch.num_rows, object)
    texts[:] = batch.column("line_text").to_pylist()
    return {name: batch.column(name).to_numpy() for name in names} | {"own": own, "text": texts}


def _meeting(own_a: np.ndarray, own_b: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The bucket, by its number, in which each pair is compared: one that both lines have, spread by a hash of the pair."""
    shared = np.zeros(len(u), np.uint64)
    for k in range(BUCKETS):
        shared |= ((own_a[:, k] == own_b[:, k]) & (own_a[:, k] != 0)).astype(np.uint64) << np.uint64(k)
    turn = mixed((u ^ v).view(np.uint64)) % np.uint64(BUCKETS)
    turned = shared >> turn | shared << np.uint64(BUCKETS) - turn
    turned &= np.uint64((1 << BUCKETS) - 1)
    lowest = np.bitwise_count((turned & (~turned + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    return ((lowest + turn) % np.uint64(BUCKETS)).astype(np.int64)


def _links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Spanning stars of the alike lines of different labels in whole buckets; each pair is compared in one bucket."""
    waiting, texts, count = [], {}, 0

    def verified() -> pa.RecordBatch:
        names = np.array(sorted(texts), np.int64)
        lines = [texts[h] for h in names.tolist()]
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        u, v = (np.concatenate(ends) for ends in zip(*waiting))
        a, b = np.searchsorted(names, u), np.searchsorted(names, v)
        near = all_within(lines, a, b, _allowed(sizes[a], sizes[b], similarity))
        node, root = stars(u[near], v[near])
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["u", "v"])

    for part in _shared(batches, _read_waiting):
        name, sketch = part["h1"], _sketches(part)
        for a, b in _near_pairs(part["key"], part["fp"].view(np.uint64), part["label"]):
            here = _meeting(part["own"][a], part["own"][b], name[a], name[b]) == part["key"][a] & BUCKETS - 1
            a, b = a[here], b[here]
            stranger = strangers(part["chars"][a], part["chars"][b], sketch[a], sketch[b], similarity)
            a, b = a[~stranger], b[~stranger]
            if not len(a):
                continue
            waiting.append((name[a], name[b]))
            used = different(np.concatenate([a, b]))
            texts.update(zip(name[used].tolist(), part["text"][used].tolist()))
            count += len(a)
            if count >= WAITING:
                yield verified()
                waiting, texts, count = [], {}, 0
    if waiting:
        yield verified()


def _not_strangers(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) of which one has no sketch of 256 bits, or both have and these differ in LONG_BITS or fewer."""
    left, right = sketches.toDF("u", *[f"a{k}" for k in range(4)]), sketches.toDF("v", *[f"b{k}" for k in range(4)])
    bits = " + ".join(f"bit_count(a{k} ^ b{k})" for k in range(4))
    return pairs.join(left, "u", "left").join(right, "v", "left").where(f"a0 IS NULL OR b0 IS NULL OR {bits} <= {LONG_BITS}").select("u", "v")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts are alike: edit distance at most (1 - similarity) times the longer length."""
    left, right = texts.toDF("u", "a"), texts.toDF("v", "b")
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return both.mapInArrow(partial(_alike, similarity=similarity), "u bigint, v bigint")


def _other_links(known: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that connect what all pairs of alike lines (h1, line_text) with different labels in one bucket do."""
    known = known.join(sketches, "h1", "left").select("h1", "label", "line_text", *[F.coalesce(f"s{k}", F.lit(0)).cast("bigint").alias(f"s{k}") for k in range(4)])
    kinds = [*_PLACED, ("label", "bigint", pa.int64()), ("chars", "int", pa.int32()), *[(f"s{k}", "bigint", pa.int64()) for k in range(4)]]
    placed = map_texts(known, _labelled_gram_setup, None, kinds, "line_text")
    placed = placed.repartition("key").sortWithinPartitions("key", "h1").mapInArrow(partial(_partnered, similarity=similarity), "key bigint, fp bigint, h1 bigint")
    # Whether two lines are close is the same in all their buckets of one class of lengths.
    each = placed.groupBy("h1", "fp", F.col("key").bitwiseAND(3 << 4).alias("class")).agg(F.collect_list("key").alias("keys"))
    waiting = each.join(known.withColumn("chars", F.length("line_text")), "h1").withColumn("key", F.explode("keys"))
    return waiting.drop("class").repartition("key").sortWithinPartitions("key", "h1").mapInArrow(partial(_links, similarity=similarity), "u bigint, v bigint")


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, row, line): the lines that go. ``doc`` is the doc_id (the largest long for null), ``row`` a hash of the text.

    Lines without a word never go. Null texts have no lines. Repeated rows (same doc_id and text) lose the same lines, so
    the first occurrence stays in each of them. Lines of any length are compared, whole; time for two long lines that are
    close but not alike grows with the square of their length, in steps of many bits at once, memory with the length.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"Candidates are chosen for a similarity from {SIMILARITY} on.")
    source = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    names = ("h1", "h2", "s0", "s1", "s2", "s3")
    kinds = [("doc", "bigint", pa.int64()), ("row", "bigint", pa.int64()), ("line", "int", pa.int32()), *[(n, "bigint", pa.int64()) for n in names]]
    occurrences = written(map_texts(source, _line_setup, None, kinds), "lines")
    distinct = written(occurrences.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.first(f"s{k}").alias(f"s{k}") for k in range(4)]), "distinct")
    sketches = distinct.where("s0 IS NOT NULL").select("h1", "s0", "s1", "s2", "s3")
    placed = map_texts(source, _gram_setup, None, _PLACED)
    pairs = written(_not_strangers(bucket_pairs(placed, False, may_be_alike, distance), sketches), "close")
    near = written(pairs.select(F.explode(F.array("u", "v")).alias("h1")).distinct(), "near")
    member = membership(near, near.count())
    texts = map_texts(source, _text_setup, member, [("h1", "bigint", pa.int64()), ("line_text", "string", pa.string())])
    texts = written(texts.join(near, "h1", "left_semi").groupBy("h1").agg(F.first("line_text").alias("line_text")), "texts")
    links = written(_verified(pairs, texts, similarity), "links")
    labels = components(links)
    known = texts.join(labels.toDF("h1", "label"), "h1", "left").withColumn("label", F.coalesce("label", "h1"))
    groups = components(links.unionByName(_other_links(known, sketches, similarity))).toDF("h1", "root")
    # The first occurrence of each group; only lines that are repeated or close to others can lose one.
    members = groups.unionByName(groups.select(F.col("root").alias("h1"), "root").distinct())
    named = distinct.select("h1", "h2", "n").join(members, "h1", "left").where("n > 1 OR root IS NOT NULL").select("h1", "h2", F.coalesce("root", "h1").alias("root"))
    grouped = written(occurrences.select("doc", "row", "line", "h1", "h2").join(named, ["h1", "h2"]).select("doc", "row", "line", "root"), "grouped")
    where = F.struct("doc", "row", "line")
    first = written(grouped.groupBy("root").agg(F.min(where).alias("stays"), F.count("*").alias("all")).where("all > 1").drop("all"), "stays")
    return grouped.join(first, "root").where(where != F.col("stays")).select("doc", "row", "line")


def _cut_setup(_):
    def handle(batch: pa.RecordBatch) -> dict:
        out, total, dropped = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("__lines").to_pylist()):
            lines, gone = (text or "").split("\n") if text else [], set(gone or ())
            out.append(text if not gone else "\n".join(line for i, line in enumerate(lines) if i not in gone))
            total.append(len(lines))
            dropped.append(len(gone))
        return {"text": pa.array(out, pa.string()), "n_lines": total, "n_dropped": dropped} | {
            name: batch.column(name) for name in batch.schema.names if name not in ("text", "__lines", "n_lines", "n_dropped")}

    return handle


def without_duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with their texts less the duplicate lines, and n_lines and n_dropped (in place of columns of these names).

    Null texts stay null, with 0 lines. Lines are cut at ``\\n``. A text of which all lines went is empty. See
    ``duplicate_lines`` for ties and repeated rows.
    """
    gone = duplicate_lines(docs, similarity).groupBy("doc", "row").agg(F.collect_set("line").alias("__lines")).withColumnsRenamed({"doc": "__gone_doc", "row": "__gone_row"})
    gone = written(gone, "gone")  # its size is then known before the join, so that texts move only where they must
    keyed = docs.drop("n_lines", "n_dropped").withColumns({"__doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), "__row": F.shiftrightunsigned(F.xxhash64("text"), 1)})
    joined = keyed.join(gone, (F.col("__doc") == F.col("__gone_doc")) & (F.col("__row") == F.col("__gone_row")), "left")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    fields = [(f.name, f.dataType.simpleString(), to_arrow_type(f.dataType)) for f in docs.select(names).schema]
    fields += [("n_lines", "bigint", pa.int64()), ("n_dropped", "bigint", pa.int64())]
    return map_texts(joined.select(*[F.col(f"`{c}`") for c in names], "__lines"), _cut_setup, None, fields)
