"""Repetition as a quality rule: how many characters of a text stand in duplicated lines and word n-grams.

Words get random 64-bit values; the value of an n-gram is a rolling polynomial over them, computed for all windows of a
slice of documents at once. Windows with equal values in one document are duplicates, which is checked word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from descry.llm.common import map_texts, utf8

#: Largest share of characters in duplicated n-grams that a document may have, by n; the same for duplicated lines.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"
BASE_WIDTH, FEWEST_WORDS, BASE_PERCENT = 8, 20, 30
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _chars(data: bytes) -> int:
    return len(data.decode())


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def repeated_windows(ids: np.ndarray, doc: np.ndarray, width: int, values: np.ndarray) -> np.ndarray:
    """Start positions of the windows that occur twice or more in their document, first ones included."""
    count = len(ids) - width + 1
    if count < 2:
        return np.zeros(0, np.int64)
    rolled = np.zeros(count, np.uint64)
    for k in range(width):
        rolled = rolled * _FACTOR + values[ids[k : k + count]]
    rolled ^= doc[:count].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    inside = np.flatnonzero(doc[:count] == doc[width - 1 :])
    order = inside[np.argsort(rolled[inside], kind="stable")]
    same = np.zeros(len(order) + 1, bool)
    equal = np.flatnonzero(rolled[order[1:]] == rolled[order[:-1]])
    a, b = order[equal], order[equal + 1]
    true = doc[a] == doc[b]
    for k in range(width):
        true &= ids[a + k] == ids[b + k]
    same[equal[true] + 1] = True  # equal to the one before in this order
    if not true.all():  # different windows of one value: compare within the run, whatever the order
        seen: dict[tuple, list[int]] = {}
        runs = np.unique(np.concatenate([a, b]))
        for i in runs:
            seen.setdefault((doc[i], *ids[i : i + width]), []).append(i)
        return np.array(sorted(i for group in seen.values() if len(group) > 1 for i in group), np.int64)
    return order[same[:-1] | same[1:]]


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Mask of the words inside the windows that begin at ``starts``."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0


def _setup(limits: tuple):
    ngrams, line_limit = limits

    def handle(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch)
        per_doc = [t.split() for t in texts]
        sizes = np.array([len(w) for w in per_doc], np.int64)
        words = [w for doc in per_doc for w in doc]
        doc, total, n = np.repeat(np.arange(len(texts)), sizes), len(words), len(texts)
        ids = word_ids(words)
        values = np.random.default_rng(7).integers(0, 1 << 63, ids.max(initial=0) + 1, dtype=np.uint64)
        joined = b"".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, total))
        starters = np.concatenate([[0], np.cumsum(np.frombuffer(joined, np.uint8) & 0xC0 != 0x80)])
        chars = np.diff(starters[ends], prepend=0)  # code points of each word
        word_chars = np.bincount(doc, chars, n).astype(np.int64)
        out = {"doc_id": batch.column("doc_id"), "n_words": sizes, "word_chars": word_chars,
               "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)}
        dup_lines, dup_line_chars = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, text in enumerate(texts):
            seen = set()
            for line in text.split(b"\n"):
                if line in seen:
                    dup_lines[i] += 1
                    dup_line_chars[i] += _chars(b"".join(line.split()))
                elif not line.isspace() and line:
                    seen.add(line)
        out["n_dup_lines"] = dup_lines
        share, worst = lambda part: part / np.maximum(word_chars, 1), np.zeros(n)
        for width, limit in {BASE_WIDTH: None, **dict(ngrams)}.items():
            mask = covered(repeated_windows(ids, doc, width, values), width, total)
            if width == BASE_WIDTH:
                out["n_repeat_words"] = np.bincount(doc[mask], minlength=n)
            if limit is not None:
                worst = np.maximum(worst, share(np.bincount(doc[mask], chars[mask], n)) / limit)
        out["dup_line_share"] = share(dup_line_chars)
        out["repetition"] = np.maximum(worst, out["dup_line_share"] / line_limit)
        out["base_failed"] = (sizes < FEWEST_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * sizes)
        out["kept"] = ~out["base_failed"] & (out["repetition"] <= 1)
        return out

    return handle


def repetition(docs: DataFrame, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Measures and verdict per document. ``repetition`` is the largest share relative to its limit; above 1 is rejected.

    Null counts as empty: no words, rejected. Every word of a text is looked at, whatever its length. Repeated rows and
    null doc_ids are treated like any other; columns other than doc_id and text are ignored. No shuffle.
    """
    long, real, flag = ("bigint", pa.int64()), ("double", pa.float64()), ("boolean", pa.bool_())
    fields = [(name, *long) for name in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [("dup_line_share", *real), ("repetition", *real), ("base_failed", *flag), ("kept", *flag)]
    source = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return map_texts(source, _setup, (tuple(limits.items()), line_limit), fields)
