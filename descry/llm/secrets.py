"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they do not name.

Tokens are tagged as outside, beginning or inside of a secret. Features are the shape of a token, its neighbouring words,
the characters before it, and features of the whole file. The field is trained in numpy by its log-likelihood on windows of a
bounded sample of the documents, where the spans of the fixed patterns are the labels and made-up secrets and harmless
look-alikes of public formats are put in. Decoding is Viterbi, exact, over whole texts: a token whose score for outside
beats the others by more than any change of its neighbours can give back is outside on the best path, so the path is found
between such tokens, for all stretches of a slice of documents at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import map_texts
from descry.llm.samples import hashed_ids

#: Fixed patterns in the order in which kinds are listed, each with its least length (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind: leftmost non-overlapping for each, too short ones dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


OUT, BEGIN, INSIDE = range(3)
HASHED = 2048
#: Rows of the weight table by feature: shape, digits and changes of class, characters before, two words before, one after,
#: the word itself, file.
SIZES = {"shape": 256, "mix": 128, "gap": 16, "before": HASHED, "before2": HASHED, "after": HASHED, "word": HASHED, "file": 16}
OFFSETS = dict(zip(SIZES, np.cumsum([0, *SIZES.values()])))
_NEVER = -1e4


def _char_classes() -> np.ndarray:
    """0 blank, 1 lower, 2 upper, 3 digit, 4 other character of a token, 5 quote, 6 colon or equals sign, 7 line end, 8 other."""
    table = np.full(256, 8, np.uint8)
    for letters, value in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), ("_+/-.", 4),
                           (" \t\r\x0b\x0c", 0), ("\"'`", 5), (":=", 6), ("\n", 7)):
        table[[ord(c) for c in letters]] = value
    table[128:] = 1
    return table


_CLASSES = _char_classes()


def tokens(points: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens of code points (0 ends a document): start, end, and one row of feature numbers each but for the file's."""
    kind = _CLASSES[np.minimum(points, 255).astype(np.uint8)]
    part = (kind >= 1) & (kind <= 4)
    edge = np.diff(np.concatenate([[False], part, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(start)
    if not n:
        return {"start": start, "end": end, "features": np.zeros((0, len(SIZES)), np.int32)}
    ones = [np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)]) for k in range(9)]
    inside = [c[end] - c[start] for c in ones]
    change = np.concatenate([[0], np.cumsum(np.append(False, (kind[1:] != kind[:-1]) & part[1:] & part[:-1]), dtype=np.int32)])
    changes = change[end] - change[np.minimum(start + 1, end)]
    length = end - start
    size = np.searchsorted([3, 5, 8, 12, 16, 20, 24, 28, 32, 36, 40, 48, 64, 100, 200], length, side="right")
    has = sum((inside[k] > 0).astype(np.int32) << i for i, k in enumerate((1, 2, 3, 4)))
    features = np.empty((n, len(SIZES)), np.int32)
    features[:, 0] = size * 16 + has
    features[:, 1] = np.minimum(np.searchsorted([1, 2, 3, 5, 8, 12, 20], inside[3], side="right"), 7) * 16 + np.minimum(changes, 15)
    last = np.concatenate([[0], end[:-1]])
    gap = [c[start] - c[last] for c in ones]
    features[:, 2] = (gap[5] > 0) + 2 * (gap[6] > 0) + 4 * (gap[7] > 0) + 8 * (gap[8] > 0)
    power = np.cumprod(np.full(16, 31, np.uint32), dtype=np.uint32)
    word = np.zeros(n, np.uint32)
    lower = np.where(kind == 2, points + 32, points).astype(np.uint32)
    for i in range(16):  # the first 16 characters of a word name it
        here = start + i < end
        word[here] += lower[start[here] + i] * power[i]
    word = ((word * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int32)
    prose = (length <= 12) & (inside[3] == 0)
    features[:, 3] = np.concatenate([[0], word[:-1]])
    features[:, 4] = np.concatenate([[0, 0], word[:-2]])[:n]
    features[:, 5] = np.concatenate([word[1:], [0]])
    features[:, 6] = np.where(prose, word, 0)
    features[:, 7] = 0
    return {"start": start, "end": end, "features": features, "digits": inside[3] > 0, "marks": gap[6] + gap[8]}


def featured(texts: list[str]) -> dict[str, np.ndarray]:
    """Tokens of all texts with complete features, the document of each, and where documents start."""
    joined = "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    found = tokens(points)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    doc = np.searchsorted(starts, found["start"], side="right") - 1
    features = found["features"]
    if len(doc):
        count = np.bincount(doc, minlength=len(texts))
        digits = np.bincount(doc, found["digits"], len(texts)) / np.maximum(count, 1)
        marks = np.bincount(doc, found["marks"], len(texts)) / np.maximum(count, 1)
        features[:, 7] = (np.searchsorted([0.02, 0.1, 0.3], digits) * 4 + np.searchsorted([0.2, 0.6, 1.5], marks))[doc]
        first = np.append(True, doc[1:] != doc[:-1])  # neighbours end with the document
        features[first, 3] = features[first, 2] = 0
        features[first | np.append(False, first[:-1]), 4] = 0
        features[np.append(first[1:], True), 5] = 0
    return found | {"doc": doc, "starts": starts, "features": features + np.fromiter(OFFSETS.values(), np.int32)}


@dataclass
class Field:
    """Weights of the features (rows x tags) and of the transitions."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3), np.float32)
        for column in features.T:
            out += self.weights[column]
        return out

    def margin(self, most_inside: float) -> float:
        """By how much outside must win at a token for the best path to be outside there, whatever stands beside it.

        Any path that is not outside there can be changed: the token to outside, and a next token that is inside to a
        beginning. ``most_inside`` bounds what the latter costs.
        """
        t, worst = self.moves.astype(float), 0.0
        for before in range(3):
            for here in (BEGIN, INSIDE):
                for after in range(3):
                    for then in range(3):
                        if min(t[before, here], t[here, after], t[after, then]) <= _NEVER:
                            continue
                        new = BEGIN if after == INSIDE else after
                        change = t[before, here] + t[here, after] + t[after, then] - t[before, OUT] - t[OUT, new] - t[new, then]
                        worst = max(worst, change + (most_inside if after == INSIDE else 0.0))
        return worst

    def decode(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tags of the best path; ``first`` marks the tokens that begin a document."""
        tags = np.zeros(len(emissions), np.int8)
        if not len(emissions):
            return tags
        most = float((emissions[:, INSIDE] - emissions[:, BEGIN]).max())
        open_ = emissions[:, OUT] - emissions[:, 1:].max(axis=1) <= self.margin(max(most, 0.0))
        at = np.flatnonzero(open_)
        if not len(at):
            return tags
        cut = np.append(True, (np.diff(at) != 1) | first[at[1:]])  # a stretch: neighbours in one document
        begin, size = at[cut], np.diff(np.append(np.flatnonzero(cut), len(at)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        longest = int(size[0])
        after = begin + size
        closed = (after < len(tags)) & ~first[np.minimum(after, len(tags) - 1)]  # a token outside follows
        total = emissions[begin] + np.where(first[begin], 0, 1)[:, None] * self.moves[OUT]
        total[first[begin], INSIDE] += _NEVER
        back: list[np.ndarray] = []
        ends = [total]
        for step in range(1, longest):
            alive = int(np.searchsorted(-size, -step, side="left"))
            scores = total[:alive, :, None] + self.moves
            back.append(scores.argmax(axis=1).astype(np.int8))
            total = scores.max(axis=1) + emissions[begin[:alive] + step]
            ends.append(total)
        final = np.stack([ends[s - 1][i] for i, s in enumerate(size)]) + np.where(closed, 1, 0)[:, None] * self.moves[:, OUT]
        tag = final.argmax(axis=1).astype(np.int8)
        for step in range(longest - 1, -1, -1):
            alive = int(np.searchsorted(-size, -step, side="left"))
            tags[begin[:alive] + step] = tag[:alive]
            if step:
                tag[:alive] = back[step - 1][np.arange(alive), tag[:alive]]
        return tags


@dataclass(frozen=True)
class Training:
    """At most ``documents`` sampled documents give ``windows`` windows of ``characters`` characters each, from anywhere."""

    documents: int = 1500
    windows: int = 3
    characters: int = 240
    epochs: int = 12
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 3


def _made_up(rng: np.random.Generator) -> tuple[str, int, int]:
    """A piece of text with a secret, and the secret's span in it."""
    def draw(letters: str, n: int) -> str:
        return "".join(rng.choice(list(letters), n))

    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed, hexa = lower + upper + digit, digit + "abcdef"
    secret = [
        lambda: draw(mixed, rng.integers(20, 64)), lambda: draw(hexa, rng.choice([32, 40, 64])), lambda: "AKIA" + draw(upper + digit, 16),
        lambda: "ghp_" + draw(mixed, 36), lambda: "sk_live_" + draw(mixed, 24), lambda: "xoxb-" + draw(digit, 12) + "-" + draw(mixed, 24),
        lambda: "AIza" + draw(mixed + "_-", 35), lambda: "eyJ" + draw(mixed, 20) + "." + draw(mixed, 40) + "." + draw(mixed + "_-", 43),
        lambda: draw(mixed + "+/", rng.integers(40, 88)), lambda: "glpat-" + draw(mixed + "-", 20),
    ][rng.integers(10)]()
    before, after = [("", ""), ("token = \"", "\""), ("password: ", ""), ("Authorization: Bearer ", ""), ("api_key='", "'"), ("key ", ""),
                     ("secret=", ""), ("credentials ", ""), ("access_key: ", ""), ("private key:\n", "\n")][rng.integers(10)]
    return before + secret + after, len(before), len(before) + len(secret)


def _look_alike(rng: np.random.Generator) -> str:
    """Harmless text that has something of a secret."""
    def draw(letters: str, n: int) -> str:
        return "".join(rng.choice(list(letters), n))

    lower, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return [
        lambda: draw(lower, 6) + "." + draw(digit, 2) + "@" + draw(lower, 6) + ".example.com", lambda: draw(digit, 16), lambda: draw(digit, 10),
        lambda: f"({draw(digit, 3)}) {draw(digit, 3)}-{draw(digit, 4)}", lambda: "https://" + draw(lower, 8) + ".example.org/" + draw(lower, 10) + "/" + draw(digit, 4),
        lambda: f"20{draw(digit, 2)}-0{rng.integers(1, 9)}-1{draw(digit, 1)}", lambda: draw(lower, rng.integers(18, 40)), lambda: f"10.{draw(digit, 2)}.{draw(digit, 1)}.{draw(digit, 2)}",
        lambda: "DE" + draw(digit, 20), lambda: " ".join(draw(digit, 4) for _ in range(4)), lambda: draw(lower, 9).upper(), lambda: draw(lower, 5) + "_" + draw(lower, 7) + "-" + draw(lower, 6),
    ][rng.integers(12)]()


def _windows(cut: list[list[str]], settings: Training) -> list[tuple[str, list[tuple[int, int]]]]:
    """Examples from the windows of each document: as they are or with something put in, a made-up secret or a look-alike."""
    rng, out = np.random.default_rng(settings.seed), []
    for windows in cut:
        for k, window in enumerate(windows):
            place = window.find(" ", int(rng.integers(0, max(1, len(window)))))
            place = len(window) if place < 0 else place + 1
            put, spans = ("", []) if k == 2 else (_look_alike(rng), []) if rng.random() < 0.5 else (None, None)
            if put is None:
                put, a, b = _made_up(rng)
                spans = [(place + a, place + b)]
            window = window[:place] + put + " " * bool(put) + window[place:]
            for start, kind, end in base_spans(window):
                if kind:
                    spans.append((start, end))
                else:
                    match = ASSIGN.match(window, start)
                    spans.append((match.start(2), match.end(2)))
            out.append((window, spans))
    return out


def train(docs: DataFrame, settings: Training = Training()) -> Field:
    """A field trained on windows of the documents with the smallest hash of doc_id, a bounded sample; see ``Training``.

    Ids are chosen first; the windows are cut at hashed places of the whole texts where the texts are. Null texts and
    null doc_ids give no examples; of several rows with one doc_id one counts.
    """
    known = docs.where("text IS NOT NULL")
    ids = hashed_ids(known, settings.documents, settings.seed)  # at most ``documents`` rows
    room = F.greatest(F.length("text") - settings.characters + 1, F.lit(1))
    cuts = [F.substring("text", 1 + F.pmod(F.xxhash64("doc_id", F.lit(settings.seed), F.lit(k)), room).cast("int"), F.lit(settings.characters)) for k in range(settings.windows)]
    cut = known.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", "rank", F.array(*cuts).alias("windows"))
    rows = cut.groupBy("doc_id", "rank").agg(F.min("windows").alias("windows")).orderBy("rank", "doc_id").collect()
    rng = np.random.default_rng(settings.seed)
    field = Field(np.zeros((sum(SIZES.values()), 3), np.float32), np.array([[0, 0, _NEVER], [0, 0, 0], [0, 0, 0]], np.float32))
    windows = _windows([r["windows"] for r in rows] or [[""] * settings.windows], settings)
    examples = []
    for window, spans in windows:
        found = featured([window])
        tags = np.zeros(len(found["start"]), np.int64)
        for a, b in spans:
            mine = np.flatnonzero((found["start"] < b) & (found["end"] > a))
            tags[mine] = INSIDE
            tags[mine[:1]] = BEGIN
        if len(tags):
            examples.append((found["features"], tags))
    first, second, steps = np.zeros_like(field.weights), np.zeros_like(field.weights), 0
    moves_first, moves_second = np.zeros((3, 3)), np.zeros((3, 3))
    for _ in range(settings.epochs):
        order = rng.permutation(len(examples))
        for i in range(0, len(order), settings.batch):
            batch = [examples[j] for j in order[i : i + settings.batch]]
            gradient, moved = _gradient(field, batch)
            gradient = gradient / len(batch) + settings.decay * field.weights
            steps += 1
            for value, g, m, v in ((field.weights, gradient, first, second), (field.moves, moved / len(batch), moves_first, moves_second)):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g**2
                value -= (settings.rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
            field.moves[OUT, INSIDE] = _NEVER
    return field


def _gradient(field: Field, batch: list) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood: expected minus observed counts, by forward and backward sums over a padded batch."""
    size, width = len(batch), max(len(t) for _, t in batch)
    emissions, mask = np.zeros((size, width, 3)), np.zeros((size, width), bool)
    tags = np.zeros((size, width), np.int64)
    for i, (features, known) in enumerate(batch):
        emissions[i, : len(known)], tags[i, : len(known)], mask[i, : len(known)] = field.emissions(features), known, True
    t = field.moves.astype(float)

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    alpha, beta = np.zeros_like(emissions), np.zeros_like(emissions)
    alpha[:, 0] = emissions[:, 0] + np.array([0, 0, _NEVER])
    for s in range(1, width):
        alpha[:, s] = np.where(mask[:, s, None], total(alpha[:, s - 1, :, None] + t, 1) + emissions[:, s], alpha[:, s - 1])
    for s in range(width - 2, -1, -1):
        beta[:, s] = np.where(mask[:, s + 1, None], total(t + (emissions[:, s + 1] + beta[:, s + 1])[:, None, :], 2), 0)
    norm = total(alpha[:, -1], 1)
    node = np.exp(alpha + beta - norm[:, None, None])
    observed = np.eye(3)[tags]
    difference = (node - observed)[mask]
    gradient = np.zeros_like(field.weights)
    features = np.concatenate([f for f, _ in batch])
    for column in features.T:
        np.add.at(gradient, column, difference)
    pair = np.exp(alpha[:, :-1, :, None] + t + (emissions[:, 1:] + beta[:, 1:])[:, :, None, :] - norm[:, None, None, None])
    both = mask[:, 1:]
    moved = pair[both].sum(axis=0) - np.einsum("ni,nj->ij", observed[:, :-1][both], observed[:, 1:][both])
    return gradient, moved


def _scan_setup(field: Field):
    def handle(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        spans = [base_spans(t) for t in texts]
        found = featured(texts)
        doc = found["doc"]
        first = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
        tags = field.decode(field.emissions(found["features"]), first)
        begin = np.flatnonzero(tags == BEGIN)
        for i in begin:
            last = i
            while last + 1 < len(tags) and tags[last + 1] == INSIDE and not first[last + 1]:
                last += 1
            d = doc[i]
            a, b = int(found["start"][i] - found["starts"][d]), int(found["end"][last] - found["starts"][d])
            if all(b <= start or a >= end for start, kind, end in spans[d] if kind < 3):
                spans[d].append((a, 3, b))
        names = [[KINDS[k] for _, k, _ in sorted(s)] for s in spans]
        return {"doc_id": batch.column("doc_id"), "kinds": names, "starts": [[a for a, _, _ in sorted(s)] for s in spans],
                "ends": [[b for _, _, b in sorted(s)] for s in spans]}

    return handle


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans) per document: an array of (kind, start, end) by start, then kind; code points, end exclusive.

    Kinds are assign, access, hex and crf. Spans of the field are added where no pattern has matched. Null counts as empty
    and has no spans. Whole texts are scanned, however long. Repeated rows and null doc_ids are scanned like any other;
    columns besides doc_id and text are ignored. No shuffle.
    """
    fields = [("doc_id", "bigint", pa.int64()), ("kinds", "array<string>", pa.list_(pa.string())),
              ("starts", "array<int>", pa.list_(pa.int32())), ("ends", "array<int>", pa.list_(pa.int32()))]
    found = map_texts(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), _scan_setup, field, fields)
    joined = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.struct(s["kinds"].alias("kind"), s["starts"].alias("start"), s["ends"].alias("end")))
    return found.select("doc_id", joined.alias("spans"))
