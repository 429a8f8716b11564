"""Periodic runs, embedding near-duplicates and the filter interaction audit against plain versions."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from descry.llm import interaction, neighbours, periodic, queries
from descry.llm.common import ship

PATTERN = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, n string, runs string, part string, mask string, digest string, start string"


def row(doc_id, text, source="a"):
    return (doc_id, text, source, "x", "x", "x", "x", "x", "x")


def plain_runs(w, least=6, periods=4):
    """Every period of every stretch, compared place by place; of equal stretches the smallest period stays."""
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(4)
    for _ in range(1500):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 50))]
        if len(w) > 8 and rng.random() < 0.6:
            a, p = rng.randrange(len(w)), rng.randint(1, 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        for bounds in ((6, 4), (2, 2), (5, 3)):
            assert list(map(tuple, periodic.find_runs(np.array(w, np.int64), *bounds).tolist())) == plain_runs(w, *bounds)
            pair, doc = np.array(w + w, np.int64), np.repeat([0, 1], len(w))
            inside = [(a + s, n, q) for a, b in periodic.stretches(pair, doc, *bounds).tolist() for s, n, q in periodic.find_runs(pair[a:b], *bounds).tolist()]
            assert sorted(inside) == sorted(plain_runs(w, *bounds) + [(len(w) + s, n, q) for s, n, q in plain_runs(w, *bounds)])


def test_extensions_and_suffix_ranks():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))] + [0]
        found = periodic.Extensions(s, 4)
        n = len(s)
        assert np.argsort(found.rank).tolist() == sorted(range(n), key=lambda i: s[i:])
        assert np.argsort(found.mirrored()).tolist() == sorted(range(n), key=lambda i: [0 if x == 0 else 4 - x for x in s[i:]])
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        want = [next(k for k in range(n) if s[i + k] != s[j + k]) for i, j in pairs]
        assert found.common(*map(np.array, zip(*pairs))).tolist() == want


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    rows = [row(i, t) for i, t in enumerate(base)]
    rows += [row(100, "x " * 5), row(101, "x " * 6), row(102, "a b " * 4), row(103, "a b " * 4 + "a"), row(103, "a b " * 4 + "a"), row(104, None), row(105, ""), row(106, " \t\n"),
             row(None, "a b c " * 9), row(107, " ".join(f"w{i % 700}" for i in range(9000))), row(108, ("p q r\n" * 5) + "é " * 8 + "p q r " * 5)]
    return rows


def test_periodic_runs(spark, texts):
    docs = ship(spark).createDataFrame(texts, SCHEMA).repartition(4)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()), key=repr)
    want = []
    for doc_id, text, *_ in texts:
        words = PATTERN.findall(text or "")
        runs = plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((doc_id, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want, key=repr) and sum(len(r[2]) for r in got) > 8
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, periods=1)


def test_query_of_periodic_runs(spark, texts, tmp_path):
    ship(spark).createDataFrame(texts, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], tuple(r)[1:])
    for doc_id, text, *_ in texts:
        words = PATTERN.findall(text or "")
        n, h = len(words), crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = plain_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert got[doc_id] == (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                               hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def plain_links(vectors):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if g else None for v, g in zip(vectors, good)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    return {(i, j) for i, j in itertools.permutations(range(len(vectors)), 2)
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]) and (vectors[i] == vectors[j] or float(unit[i] @ unit[j]) >= 0.95)}


@pytest.mark.parametrize("tile", [1024, 8])
def test_near_vectors(spark, tile):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        centre = rng.normal(size=48)
        rows += [(centre + k * rng.normal(size=48) * 0.12).tolist() for k in range(1 + i % 4)]
    hub = rng.normal(size=48)
    rows += [(hub + rng.normal(size=48) * 0.05).tolist() for _ in range(40)] + [hub.tolist()] * 5 + [(hub * 1e-200).tolist(), (hub * 1e200).tolist()]
    rows += [None, [], [0.0] * 48, [float("nan")] + [1.0] * 47, [float("inf")] + [1.0] * 47, [None] + [1.0] * 47, hub.tolist()[:24], [1.0], [2.0], [-1.0]]
    ids = [*range(len(rows) - 2), 7, None]
    frame = ship(spark).createDataFrame([(i, v, "x", "y", 1.0) for i, v in zip(ids, rows)], "vec_id bigint, embedding array<double>, name string, label string, links double").repartition(5)
    got = sorted(map(tuple, neighbours.near_vectors(frame, tile=tile).collect()), key=repr)
    links, group = plain_links(rows), list(range(len(rows)))
    for i, j in sorted(links):
        if group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    want = []
    for i in range(len(rows)):
        least = min((ids[j] for j in range(len(rows)) if group[j] == group[i] and ids[j] is not None), default=None)
        want.append((ids[i], sum((i, j) in links for j in range(len(rows))), least, ids[i] == least))
    assert got == sorted(want, key=repr) and max(r[1] for r in got) >= 46
    assert neighbours.near_vectors(frame.limit(0)).count() == 0


def test_calibrated_count_and_recall():
    rng = np.random.default_rng(8)
    for cosine in (0.95, 0.99):
        x = rng.normal(size=(4000, 64))
        y = rng.normal(size=(4000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        cutting, counted = neighbours._lines(64)
        steps = [np.floor(v @ counted / neighbours.STEP) for v in (x, y)]
        met = (np.abs(steps[0] - steps[1]) <= neighbours.WINDOW).mean()
        assert abs(met - neighbours.collision_share(cosine)) < 0.005
        counts = (np.abs(steps[0] - steps[1]) <= neighbours.WINDOW).sum(axis=1)
        cells = ((x @ cutting > 0) == (y @ cutting > 0)).reshape(4000, neighbours.TABLES, neighbours.CUTS).all(axis=2)
        window = np.abs(steps[0] - steps[1])[:, : neighbours.TABLES] <= neighbours.WINDOW
        assert ((counts >= neighbours.least_count()) & (cells & window).any(axis=1)).mean() >= 0.9
    with pytest.raises(ValueError):
        neighbours.near_vectors(None, cosine=0.5)


def test_filter_orders(spark, tmp_path):
    rng = random.Random(9)
    words = ["the", "Sun", "#", "rain", "A", "LOUD", "b|c", "é", "snow", *[f"v{i}" for i in range(60)]]
    rows = [row(i, " ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 49, 50, 80, 300)))), rng.choice(["a", "b", None, ""])) for i in range(150)]
    rows += [row(1000 + i, rows[i % 7][1], rng.choice(["a", "c", None])) for i in range(40)] + [row(3, rows[3][1], "a"), row(None, rows[4][1], "a"), row(None, None, None), row(2000, None, "a"), row(2001, "", "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 1040, 2)] + [(4, 1, 1, "x"), (None, 1, 1, "x")]
    docs = ship(spark).createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string").repartition(2)
    least, good, toxic = {}, set(), set()
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, q, x, _ in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if x == 1 else set()
    facts = []
    for d, t, source, *_ in rows:
        t = t or ""
        w = PATTERN.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": d is not None and d > least[t]}
        facts.append((source or "", {f for f, x in fails.items() if x}, d is not None and d in good, d is not None and d in toxic))
    want, shapley = {}, {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = set(order[:step])
                gone = [f for f in mine if letter in f[1] and not f[1] & before]
                want[part, "".join(order), step + 1] = (sum(not f[1] & (before | {letter}) for f in mine), len(gone), sum(letter in f[1] and bool(f[1] & before) for f in mine),
                                                        sum(f[1] == {letter} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    got = interaction.audit_orders(docs, known).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()} and len(got) == len(want)
    assert interaction.audit_orders(docs.limit(0), known).count() == 0
    assert interaction.audit_orders(docs, known.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
