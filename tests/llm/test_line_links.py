"""Line dedup: edit distances of many pairs at once, and rows that grow with the lines, not with the pairs of a bucket."""

import random
from itertools import permutations

import numpy as np

from descry.llm import lines


def test_edit_distances_of_many_pairs_at_once():
    rng, texts = random.Random(5), []
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefgh ", "".join(map(chr, range(97, 190)))])
        one = [rng.choice(letters) for _ in range(rng.choice([1, 5, 40, 63, 64, 65, 128, 130, 300]))]
        other = list(one)
        for _ in range(int(len(one) * rng.choice([0, 0.1, 0.19, 0.2, 0.22, 0.4]))):
            at = rng.randrange(len(other))
            other[at : at + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(2) if len(other) > 1 else other
        texts += ["".join(one), "".join(other)]
    a, b = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    a, b = np.append(a, a[:-1]), np.append(b, b[1:])  # strangers, too, and lines in several pairs
    most = lines._allowed(*(np.array([len(texts[i]) for i in ends]) for ends in (a, b)), 0.8)
    plain = [lines.within_distance(texts[i], texts[k], int(m)) for i, k, m in zip(a, b, most)]
    assert lines.all_within(texts, a, b, most).tolist() == plain and 0.3 < np.mean(plain) < 0.7
    assert lines.all_within(texts, a[:3], b[:3], most[:3]).tolist() == plain[:3] and not len(lines.all_within([], a[:0], b[:0], most[:0]))


def test_strangers_that_share_buckets_make_no_row_a_pair(spark, monkeypatch):
    words = ["quarterbacks", "windjammers", "zephyrlike", "foxhunting", "vocabulary"]
    texts = [" ".join(order) for order in permutations(words)]  # the same words, so one SimHash; 7,140 pairs
    counts, written = [], lines.written

    def counting(df, name):
        out = written(df, name)
        counts.append((out.count(), name))
        return out

    monkeypatch.setattr(lines, "written", counting)
    monkeypatch.setattr("descry.llm.components.written", counting)
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id long, text string")
    lost = {r["doc"] for r in lines.duplicate_lines(docs).collect()}
    assert max(counts)[0] <= lines.BUCKETS * len(texts), max(counts)
    alike = [[lines.within_distance(a, b, (max(len(a), len(b))) // 5) for b in texts] for a in texts]
    first = list(range(len(texts)))
    for _ in texts:
        first = [min(f for f, near in zip(first, row) if near) for row in alike]
    assert lost == {i for i, f in enumerate(first) if f != i}
