"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram vector binds the vectors of its letters, each rotated by its place,
by multiplication; a document is the bundle (sum) of its n-grams, and so is a language over its documents. Documents are
compared with the languages by cosine after the direction common to all languages is taken out of both.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import map_texts, written

#: Dimensions; letter classes beside a-z and the blank, shared by all other letters by code point; temperature of the score.
DIMENSIONS, OTHERS, SHARPNESS, SEED = 1024, 37, 8.0, 11
SYMBOLS = 27 + OTHERS
#: Rows of n-gram vectors that a task keeps.
KEPT_GRAMS = 20_000
UNDEFINED = "und"
BLANK = 26


def _letter(point: int) -> int:
    letter = chr(point).lower()[0]
    return BLANK if not letter.isalpha() else ord(letter) - 97 if "a" <= letter <= "z" else BLANK + 1 + ord(letter) % OTHERS


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter class of every code point that can be a letter; all others are blanks."""
    return np.array([BLANK if 0xD800 <= point < 0xE000 else _letter(point) for point in range(0x33480)] + [BLANK], np.int32)


def symbols(text: str) -> np.ndarray:
    """Letter classes of a text, in lower case, each run of other characters as one blank; empty if there is no letter."""
    table = _classes()
    found = table[np.minimum(np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32), len(table) - 1)]
    found = found[np.append(True, (found[1:] != BLANK) | (found[:-1] != BLANK))]
    return found if len(found) > 1 else found[:0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text, as numbers, and their counts."""
    s = symbols(text)
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)


class Space:
    """Letter vectors, and the n-gram vectors bound so far."""

    def __init__(self, dimensions: int = DIMENSIONS):
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (SYMBOLS, dimensions))
        self.turned = [np.roll(letters, k, axis=1) for k in (2, 1, 0)]
        self.where = np.full(SYMBOLS**3, -1, np.int32)
        self.kept = np.empty((256, dimensions), np.float32)
        self.used = 0

    def bind(self, gram: np.ndarray) -> np.ndarray:
        a, b, c = self.turned
        return a[gram // SYMBOLS**2] * b[gram // SYMBOLS % SYMBOLS] * c[gram % SYMBOLS]

    def bundle(self, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
        new = gram[self.where[gram] < 0]
        if len(new) and self.used + len(new) <= KEPT_GRAMS:
            while self.used + len(new) > len(self.kept):
                self.kept = np.concatenate([self.kept, np.empty_like(self.kept)])
            self.kept[self.used : self.used + len(new)] = self.bind(new)
            self.where[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        at = self.where[gram]
        known = at >= 0
        total = count[known].astype(np.float32) @ self.kept[at[known]]
        rest = np.flatnonzero(~known)
        for i in range(0, len(rest), 1024):
            part = rest[i : i + 1024]
            total = total + count[part].astype(np.float32) @ self.bind(gram[part])
        return total


@dataclass
class Profiles:
    """Language names in order, their unit vectors, and the direction that was taken out."""

    names: list[str]
    vectors: np.ndarray
    common: np.ndarray

    def scores(self, vector: np.ndarray) -> np.ndarray:
        own = vector / max(float(np.linalg.norm(vector)), 1e-9)
        own = own - (own @ self.common) * self.common
        cosine = self.vectors @ (own / max(float(np.linalg.norm(own)), 1e-9))
        odds = np.exp(SHARPNESS * (cosine - cosine.max()))
        return odds / odds.sum()


def _count_setup(_):
    def handle(batch: pa.RecordBatch) -> dict:
        totals: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            gram, count = grams(text or "")
            if len(gram):  # every document counts alike, whatever its length
                totals.setdefault(lang, np.zeros(SYMBOLS**3))[gram] += count / count.sum()
        found = [(lang, np.flatnonzero(sums), sums) for lang, sums in totals.items()]
        return {"lang": [lang for lang, at, _ in found for _ in at], "gram": np.concatenate([at for _, at, _ in found] or [np.zeros(0, np.int64)]),
                "weight": np.concatenate([sums[at] for _, at, sums in found] or [np.zeros(0)])}

    return handle


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> Profiles:
    """Profiles over all rows of ``labelled`` (text, lang) with a lang. N-gram sums are gathered per language, which is
    as many rows as the alphabet allows, and bundled once: bundling is linear."""
    fields = [("lang", "string", pa.string()), ("gram", "bigint", pa.int64()), ("weight", "double", pa.float64())]
    sums = map_texts(labelled.where("lang IS NOT NULL").select("text", "lang"), _count_setup, None, fields)
    sums = sums.groupBy("lang", "gram").agg(F.round(F.sum("weight"), 6).alias("weight"))  # the order of addition leaves no trace
    sums = written(sums, "grams")  # counted once, read once per language
    names, vectors, space = [], [], Space(dimensions)
    for lang in sorted(r["lang"] for r in sums.select("lang").distinct().collect()):
        rows = sums.where(F.col("lang") == lang).orderBy("gram").select("gram", "weight").toPandas()
        vector = space.bundle(rows["gram"].to_numpy(np.int64), rows["weight"].to_numpy())
        names.append(lang)
        vectors.append(vector / max(float(np.linalg.norm(vector)), 1e-9))
    if not names:
        return Profiles([], np.zeros((0, dimensions), np.float32), np.zeros(dimensions, np.float32))
    every = np.stack(vectors)
    common = every.mean(axis=0)
    common = common / max(float(np.linalg.norm(common)), 1e-9) if len(names) > 1 else np.zeros_like(common)
    every = every - np.outer(every @ common, common)
    return Profiles(names, (every / np.maximum(np.linalg.norm(every, axis=1, keepdims=True), 1e-9)).astype(np.float32), common.astype(np.float32))


def _predict_setup(profiles: Profiles):
    space = Space(profiles.vectors.shape[1])

    def one(text: str | None) -> tuple[str, float]:
        gram, count = grams(text or "")
        if not len(gram) or not profiles.names:
            return UNDEFINED, 0.0
        score = profiles.scores(space.bundle(gram, count))
        best = int(score.argmax())
        return profiles.names[best], float(score[best])

    def handle(batch: pa.RecordBatch) -> dict:
        found = [one(text) for text in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return handle


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) per document, from its whole text alone.

    ``und`` with score 0 for null, for texts without a letter, and where no language was learned. The first name in order
    wins a tie. Repeated rows and null doc_ids are treated like any other; columns besides doc_id and text are ignored.
    """
    fields = [("doc_id", "bigint", pa.int64()), ("lang_pred", "string", pa.string()), ("score", "double", pa.float64())]
    return map_texts(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), _predict_setup, profiles, fields)


def fold(parts: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(parts))
