"""Line dedup: large buckets as matrices, pairs that can't be alike left out before texts move, first occurrences of all groups."""

import random

import numpy as np
import pyarrow as pa

from descry.llm import lines
from descry.llm.common import ship
from descry.llm.simhash import close_pairs


def bucket(rng, size, long):
    fp = rng.integers(0, 1 << 40, size, dtype=np.uint64) << np.uint64(8)
    fp[::3] = fp[0] ^ (np.uint64(1) << rng.integers(8, 50, len(fp[::3])).astype(np.uint64))
    return fp | (rng.integers(64, 90, size) if long else rng.integers(12, 40, size)).astype(np.uint64)


def test_large_buckets_have_the_same_links(monkeypatch):
    rng = np.random.default_rng(4)
    parts = [(3, True), (150, True), (1, False), (90, False), (lines.CROWD, True), (lines.CROWD - 1, True)]
    key = np.repeat(np.arange(len(parts)), [n for n, _ in parts])
    fp = np.concatenate([bucket(rng, n, long) for n, long in parts])
    name, label = np.arange(len(key)) * 7, rng.integers(0, 40, len(key))
    for entries in (1 << 16, 100):
        monkeypatch.setattr(lines, "ENTRIES", entries)
        plain = {(a, b) for x, y in close_pairs(key, np.ones(len(key), bool), fp, lines.may_be_alike, label) for a, b in zip(x.tolist(), y.tolist()) if a > b}
        found = [(a, b) for x, y in lines._near_pairs(key, fp, label) for a, b in zip(x.tolist(), y.tolist())]
        assert len(found) == len(set(found)) and set(found) == plain and plain
        for start, end in lines._crowds(key, fp)[0]:
            best = {}
            for i in range(start, end):
                near = [(max(int(lines.distance(fp[i : i + 1], fp[k : k + 1])[0]), lines.VERY_CLOSE), k) for k in range(start, end)
                        if k != i and lines.may_be_alike(fp[i : i + 1], fp[k : k + 1])[0]]
                best |= {i * 7: min(near)[1] * 7} if near else {}
            assert dict(zip(*map(np.ndarray.tolist, lines._closest(fp[start:end], name[start:end])))) == best
    assert len(lines._crowds(key, fp)[0]) == 3


def test_a_crowd_is_compared_without_a_row_a_pair(monkeypatch):
    """Pairs of strangers used to be laid out one by one, 24 bytes each and in both directions."""
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 56, 3000, dtype=np.uint64) << np.uint64(8) | np.uint64(100)
    monkeypatch.setattr(lines, "close_pairs", lambda *a: 1 / 0)
    assert all(len(a) <= lines.ENTRIES for a, _ in lines._near_pairs(np.zeros(3000, np.int64), fp, np.arange(3000)))
    assert len(lines._closest(fp, np.arange(3000))[0]) > 2900


def test_no_alike_pair_is_a_stranger():
    rng, texts = random.Random(2), []
    for _ in range(800):
        one = "".join(rng.choice("abcdefghijklmnop é") for _ in range(rng.choice([1, 5, 20, 60, 100, 127])))
        other = list(one)
        for _ in range(rng.randrange(1 + len(one) // 4)):
            other[rng.randrange(len(other))] = rng.choice("abcxyz ü")
        texts += [one, "".join(other)]
    sizes, counts = np.array([len(t) for t in texts]), np.stack([lines.char_counts(t) for t in texts]).view(np.uint64)
    a, b = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    a, b = np.append(a, a[:-1]), np.append(b, b[1:])
    out = lines.strangers(sizes[a], sizes[b], counts[a], counts[b], 0.8)
    alike = np.array([lines.within_distance(texts[i], texts[k], max(len(texts[i]), len(texts[k])) // 5) for i, k in zip(a, b)])
    assert not (out & alike).any() and out.mean() > 0.3 and alike.mean() > 0.2


def test_strangers_wait_without_their_texts():
    """Lines that share a bucket and look close by 56 bits, but can't be alike, no longer move with their texts."""
    fp = np.full(40, 100, np.int64)
    columns = {"key": np.zeros(40, np.int64), "fp": fp, "h1": np.arange(40), "label": np.arange(40), "chars": np.full(40, 50, np.int32)}
    counts = np.stack([lines.char_counts(chr(97 + i % 20) * 50) for i in range(40)])
    batch = pa.RecordBatch.from_pydict(columns | {f"s{k}": counts[:, k] for k in range(4)})
    kept = [h for out in lines._partnered(iter([batch.slice(0, 21)]), 0.8) for h in out.column("h1").to_pylist()]
    assert kept == [0, 20]


def test_first_occurrence_of_each_group_stays(spark):
    line = "these seven sailors sing old songs about the sea"
    rows = [(9, line), (3, "x\n" + line + "s"), (None, line), (5, "other words of no kin here\n" + line), (5, line.upper() + "!"), (3, "x\n" + line + "s")]
    got = lines.duplicate_lines(ship(spark).createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc"], r["line"]) for r in got) == [(5, 0), (5, 1), (9, 0), (lines._LAST, 0)]
