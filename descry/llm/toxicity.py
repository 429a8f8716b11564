"""Toxicity by a small convolutional text classifier, trained in numpy.

Words are embedded as the sum of two hashed vectors, so that a rare word that shares one bucket with a telling word does not
look like it. Filters of several widths slide over the words; each keeps its largest answer in the whole text, and a
logistic layer weighs these. All labelled texts take part in the training: shards of them are worked on side by side, and after
each epoch the model goes on from the means of what they came to. Thresholds are calibrated per language on labelled texts that the training has not seen; the
score is shifted so that the threshold of each language lies at the same value. The language is guessed from the words of
the text, by a naive Bayes table over the same buckets, and never read from a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from descry.llm.common import map_texts, slices, utf8, written
from descry.llm.lines import membership, passing

BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 15, 16, 12, (1, 2, 3)
#: The score of a text at the threshold of its language.
THRESHOLD = 0.7
_MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


@dataclass(frozen=True)
class Training:
    """Settings. Labelled texts, in the order of a hash of doc_id, are dealt out to shards of about ``texts`` texts, or fewer
    of about ``words`` words together; every ``holdout``-th of a shard serves for calibration only."""

    texts: int = 5000
    words: int = 4 << 20
    holdout: int = 4
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 5


class Buckets(dict):
    """Bucket pair of a word as one number; bounded."""

    def __missing__(self, word: bytes) -> int:
        bare = word.lower().strip(_MARKS)
        value = crc32(bare) % BUCKETS * BUCKETS + crc32(bare, 0x5EED) % BUCKETS
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def numbers(texts: list[bytes], buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """The bucket pairs of the words of all texts, one after the other, and the number of words of each."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    return np.fromiter((buckets[w] for doc in words for w in doc), np.int64, int(sizes.sum())), sizes


def laid_out(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two buckets for each word of all texts, with empty places (bucket BUCKETS) behind each text, and where texts start."""
    gap = max(WIDTHS)
    starts = np.cumsum(sizes + gap) - sizes - gap
    pairs = np.full((2, int((sizes + gap).sum())), BUCKETS, np.int64)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)) * gap, sizes)
    pairs[0, at], pairs[1, at] = flat // BUCKETS, flat % BUCKETS
    return pairs[0], pairs[1], starts


def encoded(texts: list[bytes], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return laid_out(*numbers(texts, buckets))


def window_ends(starts: np.ndarray, size: int) -> np.ndarray:
    """Where the windows of each text end: they start at its words, or at its first empty place if it has none. So none
    reaches over the empty places into the next text."""
    return np.maximum(np.append(starts[1:], size) - max(WIDTHS), starts + 1)


@dataclass
class Model:
    embedding: np.ndarray  # (BUCKETS + 1) x SIZE, the last row 0
    filters: dict[int, np.ndarray]  # width -> width x SIZE x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    offset: float = 0.0
    languages: list[str] = field(default_factory=list)
    word_log: np.ndarray | None = None  # (BUCKETS + 1) x languages
    thresholds: np.ndarray | None = None  # logits

    def projected(self) -> np.ndarray:
        """What each bucket adds to each place of each filter."""
        return np.concatenate([self.embedding @ f[k] for f in self.filters.values() for k in range(len(f))], axis=1).astype(np.float32)

    def pooled(self, first: np.ndarray, second: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Largest answer of each filter in each text, before the bias."""
        out, at, size = [], 0, len(first)
        # Every second part of reduceat, the empty places, is left out.
        bounds = np.stack([starts, window_ends(starts, size)], axis=1).ravel()
        for width in self.filters:
            total = np.zeros((size, FILTERS), np.float32)
            for k in range(width):
                part = table[:, at : at + FILTERS]
                total[: size - k] += part[first[k:]] + part[second[k:]]
                at += FILTERS
            out.append(np.maximum.reduceat(total, bounds, axis=0)[::2])
        return np.concatenate(out, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.weights + self.offset

    def guessed(self, first: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.word_log[first], starts, axis=0).argmax(axis=1)


#: Places of a batch that are looked at together.
_PLACES = 1 << 18
#: Rows of SIZE numbers: the embedding, then filters, bias and weights; rows that are merged together.
_DENSE = sum(WIDTHS) * SIZE * FILTERS + 2 * len(WIDTHS) * FILTERS
_ROWS, _BLOCK = BUCKETS + 1 + -(-_DENSE // SIZE), 1 << 11


@dataclass
class _State:
    """A model in training: its numbers and their moments (Adam) as rows of SIZE, the offset with its moments, and steps."""

    rows: np.ndarray  # 3 x _ROWS x SIZE
    offset: np.ndarray  # 3
    steps: int = 0

    def copy(self) -> _State:
        return _State(self.rows.copy(), self.offset.copy(), self.steps)

    def views(self, which: int) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray]:
        """Embedding, filters, bias and weights, or the moments of these."""
        rest, at, filters, wide = self.rows[which, BUCKETS + 1 :].reshape(-1), 0, {}, len(WIDTHS) * FILTERS
        for width in WIDTHS:
            filters[width] = rest[at : at + width * SIZE * FILTERS].reshape(width, SIZE, FILTERS)
            at += width * SIZE * FILTERS
        return self.rows[which, : BUCKETS + 1], filters, rest[at : at + wide], rest[at + wide : at + 2 * wide]

    def model(self) -> Model:
        return Model(*self.views(0), float(self.offset[0]))


def _start(settings: Training) -> _State:
    rng = np.random.default_rng(settings.seed)
    state = _State(np.zeros((3, _ROWS, SIZE), np.float32), np.zeros(3))
    embedding, filters, _, weights = state.views(0)
    embedding[:BUCKETS] = rng.normal(0, 0.02, (BUCKETS, SIZE))
    for w in WIDTHS:
        filters[w][:] = rng.normal(0, (2 / (w * SIZE)) ** 0.5, (w, SIZE, FILTERS))
    weights[:] = rng.normal(0, 0.3, len(weights))
    return state


def _best(model: Model, first: np.ndarray, second: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each width the largest answers (text, filter), and the places that gave them; some places at a time."""
    ends = window_ends(starts, len(first))
    values = [np.full((len(starts), FILTERS), -np.inf, np.float32) for _ in model.filters]
    where = [np.zeros((len(starts), FILTERS), np.int64) for _ in model.filters]
    for at in range(0, len(first), _PLACES):
        to = min(at + _PLACES, len(first))
        x = model.embedding[first[at : to + max(WIDTHS) - 1]] + model.embedding[second[at : to + max(WIDTHS) - 1]]
        here = np.flatnonzero((starts < to) & (ends > at))
        for j, (width, f) in enumerate(model.filters.items()):
            total = np.zeros((to - at, FILTERS), np.float32)
            for k in range(width):
                part = x[k : k + to - at] @ f[k]
                total[: len(part)] += part
            for i in here:
                a = max(starts[i], at) - at
                top = a + total[a : ends[i] - at].argmax(axis=0)
                found = total[top, np.arange(FILTERS)]
                better = found > values[j][i]
                values[j][i][better], where[j][i][better] = found[better], at + top[better]
    return values, where


def _epoch(state: _State, flat: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, order: np.ndarray, settings: Training) -> np.ndarray:
    """Adam on the logistic loss, once over the texts in this order; of a text only the words that gave the largest answers get
    a gradient. Returns how often each row of the state was changed."""
    model, changed, ends = state.model(), np.zeros(_ROWS, np.int64), np.cumsum(sizes)
    moments = list(zip(*(state.views(k) for k in (1, 2))))

    def adam(m: np.ndarray, v: np.ndarray, value: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
        m[rows] = 0.9 * m[rows] + 0.1 * gradient
        v[rows] = 0.999 * v[rows] + 0.001 * gradient**2
        value[rows] -= settings.rate * (m[rows] / (1 - 0.9**state.steps)) / (np.sqrt(v[rows] / (1 - 0.999**state.steps)) + 1e-8)

    for i in range(0, len(order), settings.batch):
        chosen = order[i : i + settings.batch]
        first, second, starts = laid_out(np.concatenate([flat[ends[c] - sizes[c] : ends[c]] for c in chosen]).astype(np.int64), sizes[chosen])
        pooled, where = _best(model, first, second, starts)
        raw = np.concatenate(pooled, axis=1) + model.bias
        active = np.maximum(raw, 0)
        error = (1 / (1 + np.exp(-(active @ model.weights + float(state.offset[0])))) - toxic[chosen]) / len(chosen)
        state.steps += 1
        back = np.outer(error, model.weights) * (raw > 0)
        adam(*moments[3], model.weights, active.T @ error + 1e-4 * model.weights)
        adam(state.offset[1:2], state.offset[2:3], state.offset[:1], np.array([error.sum()]))
        adam(*moments[2], model.bias, back.sum(axis=0))
        rows, values = [], []
        for j, (width, f) in enumerate(model.filters.items()):
            g = back[:, j * FILTERS : (j + 1) * FILTERS]
            gradient = np.zeros_like(f)
            for k in range(width):
                place = np.minimum(where[j] + k, len(first) - 1)
                gradient[k] = np.einsum("df,dfs->sf", g, model.embedding[first[place]] + model.embedding[second[place]])
                for hashed in (first, second):
                    rows.append(hashed[place].ravel())
                    values.append((g[:, :, None] * f[k].T[None]).reshape(-1, SIZE))
            adam(*(m[width] for m in moments[1]), f, gradient)
        row, at = np.unique(np.concatenate(rows), return_inverse=True)
        sums = np.zeros((len(row), SIZE), np.float32)
        np.add.at(sums, at, np.concatenate(values))
        keep = row < BUCKETS
        adam(*moments[0], model.embedding, sums[keep] + settings.decay * model.embedding[row[keep]], row[keep])
        changed[row[keep]] += 1
    changed[BUCKETS + 1 :] = len(order)
    return changed


def _labelled_setup(packed: bytes | None):
    def handle(batch: pa.RecordBatch) -> dict:
        some = batch.filter(pa.array(passing(batch.column("doc_id").to_numpy(), packed)))
        return dict(zip(some.schema.names, some.columns))

    return handle


def _number_setup(_):
    buckets = Buckets()

    def handle(batch: pa.RecordBatch) -> dict:
        flat, sizes = numbers(utf8(batch), buckets)
        parts = np.split(flat.astype(np.int32), np.cumsum(sizes)[:-1])
        return {"words": pa.array([p.tobytes() for p in parts], pa.binary()), "n_words": sizes} | {
            name: batch.column(name) for name in ("doc_id", "rank", "toxic", "lang")}

    return handle


def _pack(shard: pa.Table) -> pa.Table:
    shard = shard.sort_by([("rank", "ascending"), ("doc_id", "ascending"), ("toxic", "ascending")])
    columns = {"shard": shard["shard"][:1].cast(pa.int32()).combine_chunks(), "words": pa.array([b"".join(shard["words"].to_pylist())], pa.binary()),
               "sizes": pa.array([shard["n_words"].to_pylist()], pa.list_(pa.int64())), "toxic": pa.array([shard["toxic"].to_pylist()], pa.list_(pa.int32())),
               "lang": pa.array([shard["lang"].to_pylist()], pa.list_(pa.string()))}
    return pa.table(columns)


def labelled_shards(docs: DataFrame, labels: DataFrame, settings: Training) -> DataFrame:
    """(shard, words, sizes, toxic, lang): the bucket pairs of all labelled texts, their numbers of words, labels and languages,
    a row for each shard. Texts are scanned once, and only those that may be labelled are moved."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    ids = known.select(F.col("doc_id").alias("h1")).distinct()
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    kinds = [("doc_id", "bigint", pa.int64()), ("text", "string", pa.string()), ("lang", "string", pa.string())]
    some = map_texts(source, _labelled_setup, membership(ids, ids.count()), kinds)
    # Of several rows with one doc_id the smallest text counts; null counts as empty.
    least = some.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("row"))
    rows = least.join(known, "doc_id").select("doc_id", F.xxhash64("doc_id", F.lit(settings.seed)).alias("rank"), "toxic", "row.*")
    kinds = [("doc_id", "bigint", pa.int64()), ("rank", "bigint", pa.int64()), ("toxic", "int", pa.int32()), ("lang", "string", pa.string()),
             ("words", "binary", pa.binary()), ("n_words", "bigint", pa.int64())]
    rows = written(map_texts(rows, _number_setup, None, kinds), "labelled")
    size = rows.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    count = max(1, -(-size["texts"] // settings.texts), -(-size["words"] // settings.words))
    place = F.least(F.floor((F.col("rank") / 2.0**64 + 0.5) * count), F.lit(count - 1)).cast("int")
    dealt = rows.withColumn("shard", place).repartition(count, "shard").groupBy("shard")
    return written(dealt.applyInArrow(_pack, "shard int, words binary, sizes array<bigint>, toxic array<int>, lang array<string>"), "shards")


def _shards(batches: Iterator[pa.RecordBatch], holdout: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """(shard, words, sizes, toxic, held, lang) of each shard; without ``holdout`` none is held out."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            sizes, toxic = (row.column(name).flatten().to_numpy() for name in ("sizes", "toxic"))
            held = np.arange(len(sizes)) % holdout == 0 if holdout else np.zeros(len(sizes), bool)
            flat = np.frombuffer(row.column("words")[0].as_buffer(), np.int32)
            yield row.column("shard")[0].as_py(), flat, sizes, toxic.astype(np.float32), held, row.column("lang")[0].as_py()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard and language the words of each first bucket."""
    for shard, flat, sizes, _, _, lang in _shards(batches, 0):
        ends = np.cumsum(sizes)
        for name in sorted({x for x in lang if x is not None}):
            mine = [flat[e - n : e] // BUCKETS for e, n, x in zip(ends.tolist(), sizes.tolist(), lang) if x == name]
            counts = np.bincount(np.concatenate(mine), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.astype(np.int64).tobytes()], pa.binary())], names=["lang", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, total = None, None
    for batch in batches:
        for name, counts in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist()):
            if name != last:
                if last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])
                last, total = name, np.zeros(BUCKETS, np.int64)
            total += np.frombuffer(counts, np.int64)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])


_PARTS = "block int, shard int, steps bigint, weights binary, place binary, rows binary"


def _part(block: int, shard: int, steps: int, weights: np.ndarray, place: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    binary = [pa.array([x.tobytes()], pa.binary()) for x in (weights, place, rows)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([steps], pa.int64()), *binary],
                                      names=["block", "shard", "steps", "weights", "place", "rows"])


def _pass(batches: Iterator[pa.RecordBatch], state: _State, settings: Training, holdout: int, number: int) -> Iterator[pa.RecordBatch]:
    """The state after one epoch over each shard, as far as it changed, in blocks of rows; block -1 has the offset."""
    for shard, flat, sizes, toxic, held, _ in _shards(batches, holdout):
        rng = np.random.default_rng((settings.seed, shard) if shard else settings.seed)
        fit = np.flatnonzero(~held)
        for _ in range(number + 1):
            order = rng.permutation(len(fit))
        if not len(fit):
            continue
        mine = state.copy()
        changed = _epoch(mine, flat, sizes, toxic, fit[order], settings)
        yield _part(-1, shard, mine.steps, np.array([len(fit)], np.int64), np.zeros(1, np.int64), mine.offset)
        for block in range(-(-_ROWS // _BLOCK)):
            at = np.flatnonzero(changed[block * _BLOCK : (block + 1) * _BLOCK]) + block * _BLOCK
            if len(at):
                yield _part(block, shard, mine.steps, changed[at], at, mine.rows[:, at])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means over the shards, each row weighted by how often a shard changed it. Blocks come whole, shards in order."""
    block, steps, weights, sums = None, 0, None, None

    def mean() -> pa.RecordBatch:
        place = np.flatnonzero(weights)
        rows = sums[:, place] / weights[place][:, None]
        return _part(block, 0, steps, weights[place], place + max(block, 0) * _BLOCK, rows.astype(np.float32) if block >= 0 else rows)

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                if block is not None:
                    yield mean()
                block, steps = row["block"], 0
                size, width = (1, 1) if block < 0 else (_BLOCK, SIZE)
                weights, sums = np.zeros(size, np.int64), np.zeros((3, size, width))
            place, weight = np.frombuffer(row["place"], np.int64) - max(block, 0) * _BLOCK, np.frombuffer(row["weights"], np.int64)
            rows = np.frombuffer(row["rows"], np.float64 if block < 0 else np.float32).reshape(3, len(place), -1).astype(np.float64)
            steps = max(steps, row["steps"])
            weights[place] += weight
            sums[:, place] += rows * weight[:, None]
    if block is not None:
        yield mean()


def _fit(shards: DataFrame, settings: Training, holdout: int) -> _State:
    """In each epoch all shards go on from the same state, and the means of what they come to are the next one."""
    state = _start(settings)
    for number in range(settings.epochs):
        found = shards.mapInArrow(partial(_pass, state=state, settings=settings, holdout=holdout, number=number), _PARTS)
        means = found.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_merged, _PARTS)
        state = state.copy()
        for row in means.toLocalIterator():
            place = np.frombuffer(row["place"], np.int64)
            if row["block"] < 0:
                state.offset, state.steps = np.frombuffer(row["rows"], np.float64).copy(), row["steps"]
            else:
                state.rows[:, place] = np.frombuffer(row["rows"], np.float32).reshape(3, len(place), SIZE)
    return state


#: Held-out texts from which on logits are rounded to this before they are counted, so that few come to the driver.
_MANY, _GRAIN = 100_000, 2.0**-10


def _judged(batches: Iterator[pa.RecordBatch], model: Model, holdout: int) -> Iterator[pa.RecordBatch]:
    """Guessed language, logit and label of the texts that the training has not seen, or of all if there are none."""
    table = model.projected()
    for _, flat, sizes, toxic, held, _ in _shards(batches, holdout):
        guessed, logits, ends = [], [], np.cumsum(sizes)
        some = np.flatnonzero(held) if holdout else np.arange(len(sizes))
        for i in some:
            first, second, starts = laid_out(flat[ends[i] - sizes[i] : ends[i]].astype(np.int64), sizes[i : i + 1])
            logits.append(model.logits(model.pooled(first, second, starts, table))[0])
            guessed.append(model.guessed(first, starts)[0])
        yield pa.RecordBatch.from_arrays([pa.array(guessed, pa.int32()), pa.array(np.array(logits, np.float64)), pa.array(toxic[some].astype(np.int64))],
                                         names=["guessed", "logit", "toxic"])


def _threshold(logits: np.ndarray, toxic: np.ndarray, others: np.ndarray) -> float:
    """The middle of the gap in the logits, all different, at which precision and recall together (F1) are best; how many
    toxic and other texts have each."""
    order = np.argsort(-logits)
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (hits + np.cumsum(others[order]) + toxic.sum())
    best = int(f1.argmax())
    after = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 2
    return float((logits[order[best]] + after) / 2)


def train(docs: DataFrame, labels: DataFrame, settings: Training = Training()) -> Model:
    """A model from documents (doc_id, text, lang) and all labels (doc_id, toxic) of these; shards of them are worked on side by
    side. ``lang`` serves only to learn how languages look and to calibrate; null is no language. Labels other than 0 and 1 and
    null doc_ids are left out.

    Without any toxic or any other text the model answers with the share of toxic ones and keeps the middle as threshold.
    """
    shards = labelled_shards(docs, labels, settings)
    index, held = F.posexplode("toxic").alias("i", "t"), F.col("i") % settings.holdout == 0
    counted = shards.select(index).agg(F.count("*").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("toxic"), F.count_if(held).alias("n_held"),
                                       F.coalesce(F.sum(F.when(held, F.col("t"))), F.lit(0)).alias("toxic_held")).first()
    words = shards.mapInArrow(_counted, "lang string, counts binary").repartition("lang").sortWithinPartitions("lang").mapInArrow(_added, "lang string, counts binary")
    words = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in words.toLocalIterator()}
    languages = sorted(words) or [""]
    counts = np.ones((BUCKETS + 1, len(languages)), np.float32)
    for i, name in enumerate(languages):
        counts[:BUCKETS, i] += words.get(name, 0)
    word_log = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    word_log[BUCKETS] = 0
    constant = not 0 < counted["toxic"] < counted["n"]
    fit, toxic_fit = counted["n"] - counted["n_held"], counted["toxic"] - counted["toxic_held"]
    holdout = settings.holdout if 0 < counted["toxic_held"] < counted["n_held"] and 0 < toxic_fit < fit else 0
    model = (_start(settings) if constant else _fit(shards, settings, holdout)).model()
    model.languages, model.word_log, model.thresholds = languages, word_log, np.zeros(len(languages))
    if constant:
        model.weights[:] = 0
        model.offset = -4.0 if not counted["toxic"] else 4.0
        return model
    logit = F.col("logit") if counted["n_held"] <= _MANY else F.round(F.col("logit") / _GRAIN) * _GRAIN
    judged = shards.mapInArrow(partial(_judged, model=model, holdout=holdout), "guessed int, logit double, toxic bigint").withColumn("logit", logit)
    judged = judged.groupBy("guessed", "logit").agg(F.sum("toxic"), F.count("*")).collect()
    guessed, logits, toxic, n = (np.array(x) for x in zip(*judged))
    overall, at = np.unique(logits, return_inverse=True)
    model.thresholds[:] = _threshold(overall, np.bincount(at, toxic), np.bincount(at, n - toxic))
    for i in range(len(languages)):
        mine = guessed == i
        if min(toxic[mine].sum(), (n - toxic)[mine].sum()) >= 20:
            model.thresholds[i] = _threshold(logits[mine], toxic[mine], (n - toxic)[mine])
    return model


#: Bytes of texts scored at a time: words take about fifty times their memory.
SCORED_BYTES = 1 << 20


def _scorer(model: Model):
    buckets, table = Buckets(), model.projected()
    shift = np.log(THRESHOLD / (1 - THRESHOLD))

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        found = [np.zeros(0)]
        for part in slices(batch, "text", SCORED_BYTES):
            first, second, starts = encoded(utf8(part), buckets)
            logits = model.logits(model.pooled(first, second, starts, table)) - model.thresholds[model.guessed(first, starts)] + shift
            found.append(1 / (1 + np.exp(-np.clip(logits, -30, 30))))
        return np.concatenate(found)

    return scores


def _score_setup(model: Model):
    scores = _scorer(model)

    def handle(batch: pa.RecordBatch) -> dict:
        score = scores(batch)
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    return handle


def _keep_setup(model: Model):
    scores = _scorer(model)

    def handle(batch: pa.RecordBatch) -> dict:
        kept = batch.filter(pa.array(scores(batch) < THRESHOLD))
        return dict(zip(kept.schema.names, kept.columns))

    return handle


def not_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""
    fields = [(f.name, f.dataType.simpleString(), to_arrow_type(f.dataType)) for f in docs.schema]
    return map_texts(docs, _keep_setup, model, fields)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) per document, from its whole text alone; predicted is 1 from a score of 0.7 on.

    Null counts as empty; an empty text has a score too. Repeated rows and null doc_ids are scored like any other; columns
    besides doc_id and text are ignored. No shuffle.
    """
    fields = [("doc_id", "bigint", pa.int64()), ("score", "double", pa.float64()), ("predicted", "int", pa.int32())]
    return map_texts(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), _score_setup, model, fields)
