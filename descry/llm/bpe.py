"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental inverse.

BPE decides merges by rank, not from left to right, but how far to the right a decision can depend is bounded: a merge
(u, v) can only be prevented by an earlier rule that takes v, or the last part of u, with what follows, and that rule by a
still earlier one, and so on along strictly falling ranks. ``sufficient_lookahead`` follows these chains over the whole
merge list. A token that ends at least so many bytes before the end of the window is stable: it is emitted and left behind,
since merges never cross a token boundary, and so the window keeps a constant size whatever the length of the input.

Vocabulary files are read where the text is processed; only their path travels.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from descry.llm.common import list_array, map_texts

#: Fixed value: the pattern by which byte-level vocabularies of this kind split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes added to the window at a time.
WINDOW = 4096
#: Pieces up to so many characters are kept with their ids, at most so many of them in each of two generations.
KEPT_LENGTH, KEPT_PIECES = 32, 300_000


def byte_alphabet() -> dict[str, int]:
    """Characters by which vocabulary files print bytes: printable ones stand for themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after the end of a token that suffice to know that it stays as it is.

    ``right[t]`` is the context needed to know that the rule that makes t fires, ``taken[v]`` the context within which some
    rule so far takes v together with what follows.
    """
    right: dict[bytes, int] = defaultdict(int)
    taken: dict[bytes, int] = defaultdict(int)
    for u, v in merges:
        need = max(right[v], taken[v], right[u] - len(v), 0)
        right[u + v] = max(right[u + v], need)
        taken[u] = max(taken[u], len(v) + need)
    return max([0, *right.values(), *taken.values()])


class _Kept(dict):
    """A table of results with two generations: when the young one is full, the old one is forgotten."""

    def __init__(self, compute):
        self.compute, self.old = compute, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        alphabet = byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        printed = content["model"]["vocab"]
        to_bytes = {t: bytes(alphabet[c] for c in t) for t in printed if t not in self.specials}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content["model"]["merges"]]
        merges = [(to_bytes[u], to_bytes[v]) for u, v in pairs]
        self.lookahead = sufficient_lookahead(merges)
        self.ids = {data: printed[t] for t, data in to_bytes.items()}
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.data = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.specials.items()}
        self.longest: dict[bytes, bytes] = {}  # of each prefix of a token: the longest token that it begins with
        self.shorter: dict[bytes, bytes] = {}  # of each token: the next shorter one that it begins with
        for t in sorted((t for t in self.ids if merged(t, self.rank) == [t]), key=len):
            self.shorter[t] = next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.shorter), b"")
        for t in self.shorter:
            known = b""
            for n in range(1, len(t) + 1):
                known = t[:n] if t[:n] in self.shorter else known
                self.longest[t[:n]] = known
        self.neighbours = _Kept(lambda pair: merged(pair[0] + pair[1], self.rank) == [*pair])
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merged(data: bytes, rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The BPE tokens of one window: lowest rank first, leftmost first, with a heap over a linked list."""
    parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue  # one of the two was merged meanwhile
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and (right := after[left]) < len(parts):
                if (r := rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
    return [p for p in parts if p is not None]


def stream(chunks: Iterable[bytes], vocab: Vocabulary) -> Iterator[bytes]:
    """Tokens of one pre-token that arrives in chunks. Holds at most a chunk, the lookahead and the longest token."""
    window = b""
    for chunk in chunks:
        window += chunk
        if len(window) < WINDOW:
            continue
        stable, end = len(window) - vocab.lookahead, 0
        for token in merged(window, vocab.rank):
            if end + len(token) > stable:
                break
            end += len(token)
            yield token
        window = window[end:]
    yield from merged(window, vocab.rank)


def walked(data: bytes, vocab: Vocabulary) -> list[bytes]:
    """The BPE tokens of a window from left to right, by another way than ``stream``, which the tests hold against it.

    Tokens are the BPE result exactly if each two neighbours are the result for the two alone. So the longest token that
    may follow its predecessor is taken, and given up for a shorter one where nothing can follow it. A position that was
    given up is no boundary and is not tried again.
    """
    tokens: list[bytes] = []
    closed, at, size, last = set(), 0, len(data), b""
    longest, shorter, neighbours = vocab.longest.get, vocab.shorter, vocab.neighbours
    token = None
    while at < size:
        if token is None:
            token, end = data[at : at + 1], at + 2
            while end <= size and (found := longest(data[at:end])) is not None:
                token, end = found, end + 1
        while token and (at + len(token) in closed or last and not neighbours[last, token]):
            token = shorter[token]
        if token:
            tokens.append(token)
            at, last, token = at + len(token), token, None
        else:
            closed.add(at)
            token = shorter[tokens.pop()]
            at, last = at - len(last), tokens[-1] if tokens else b""
    return tokens


class _Irregular(Exception):
    """A piece that may not be encoded on its own."""


class Encoder:
    """Text to ids (int32 as bytes), with the pieces and pre-tokens seen lately kept in tables of bounded size."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.pattern = vocab, regex.compile(PATTERN)
        self.packed = {t: np.int32(i).tobytes() for t, i in vocab.ids.items()}
        self.token_ids = _Kept(self._merge)
        self.first, self.rest = _Kept(partial(self._piece, "")), _Kept(partial(self._piece, " "))

    def _merge(self, pretoken: str) -> bytes:
        data, packed = pretoken.encode(), self.packed
        chunks = (data[i : i + WINDOW] for i in range(0, len(data), WINDOW))
        return b"".join([packed[t] for t in stream(chunks, self.vocab)])

    def _piece(self, prefix: str, piece: str) -> bytes:
        """A text between single spaces, with the space that stood before it."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Irregular
        return self.pretokens(prefix + piece)

    def pretokens(self, text: str) -> bytes:
        return b"".join([self.token_ids[m.group()] for m in self.pattern.finditer(text)])

    def segment(self, text: str) -> bytes:
        """A single space between two other characters always starts a pre-token, so the pieces are independent."""
        pieces = text.split(" ")
        try:
            return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))
        except _Irregular:
            return self.pretokens(text)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.vocab.special is None or not self.vocab.special.search(text):
            return self.segment(text)
        out, at = [], 0
        for match in self.vocab.special.finditer(text):
            out += [self.encode_plain(text[at : match.start()]), np.int32(self.vocab.specials[match.group()]).tobytes()]
            at = match.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def encode_plain(self, text: str) -> bytes:
        return self.segment(text) if text else b""


def decode(ids: np.ndarray, data: dict[int, bytes], step: int = 65_536) -> str:
    """Ids to text: bytes pass through an incremental state machine that holds back an unfinished character."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    texts = (machine.decode(b"".join(map(data.__getitem__, ids[i : i + step].tolist()))) for i in range(0, len(ids), step))
    return "".join(chain(texts, [machine.decode(b"", True)]))


def _encode_setup(path: str):
    encoder = Encoder(vocabulary(path))

    def handle(batch: pa.RecordBatch) -> dict:
        found = [encoder.encode(text or "") for text in batch.column("text").to_pylist()]
        offsets = np.cumsum([0, *(len(f) // 4 for f in found)])
        return {"row": batch.column("row"), "ids": list_array(offsets, np.frombuffer(b"".join(found), np.int32), pa.int32())}

    return handle


def _round_trip_setup(path: str):
    encode, data = _encode_setup(path), vocabulary(path).data

    def handle(batch: pa.RecordBatch) -> dict:
        out = encode(batch)
        offsets, values = out["ids"].offsets.to_numpy(), out["ids"].values.to_numpy()
        return out | {"decoded": [decode(values[a:b], data) for a, b in zip(offsets, offsets[1:])]}

    return handle


def _decode_setup(path: str):
    data = vocabulary(path).data

    def handle(batch: pa.RecordBatch) -> dict:
        lists = batch.column("ids")
        return {"row": batch.column("row"), "text": [decode(np.asarray(v.values, np.int32), data) if v.is_valid else "" for v in lists]}

    return handle


_ROW = ("row", "bigint", pa.int64())
_IDS = ("ids", "array<int>", pa.list_(pa.int32()))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row (doc_id, ids) per document, in no order. No shuffle.

    Null and empty texts give no ids. Repeated rows and rows without a doc_id are encoded like any other. Columns other
    than doc_id and text are ignored.
    """
    return map_texts(docs.selectExpr("doc_id AS row", "text"), _encode_setup, path, [_ROW, _IDS]).withColumnRenamed("row", "doc_id")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """One row (doc_id, text) per row (doc_id, ids). Null gives an empty text; bytes that are not UTF-8 give U+FFFD."""
    fields = [_ROW, ("text", "string", pa.string())]
    return map_texts(encoded.selectExpr("doc_id AS row", "ids"), _decode_setup, path, fields, "ids").withColumnRenamed("row", "doc_id")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row (doc_id, ids, decoded) per document: both directions in one pass, with the conventions of the two above."""
    fields = [_ROW, _IDS, ("decoded", "string", pa.string())]
    return map_texts(docs.selectExpr("doc_id AS row", "text"), _round_trip_setup, path, fields).withColumnRenamed("row", "doc_id")
