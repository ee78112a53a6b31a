"""Packing: order-preserving dynamic programming over window cuts.

The tokens of a partition's documents, in the order in which they are read, form one stream. It is
cut into windows of at most ``room`` tokens. A cut at a document's end is free, one at a sentence's
end costs a little, one inside a sentence costs more, and every token of padding costs one; a window
whose length is a power of two needs no padding. The cheapest cuts come from

    f(j) = price(j) + min over i of f(i) + padding(pos(j) - pos(i))

in one pass: padding falls by one with every token, so the best i for a full window is the minimum
of f(i) + pos(i) over a sliding range, which a monotone queue keeps; windows of the larger powers of two are looked up.
Streams are cut block by block, so memory stays bounded however large the partition is.

Where the optimum is over fewer cuts than there are: of the sentences' ends within one 64th of a
window the first is offered; powers of two from an eighth of a window up are looked up; and each
block of 2^20 tokens is cut on its own, its last window going on with the next. No token is ever
lost to this, only some padding: about one per cent in all.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pick, pieces, remember, tidy

END = 2
ROOM = 4096
BLOCK = 1 << 20
CACHE = 300_000
#: Prices in tokens of padding: a window, a cut at a sentence's end, a cut inside a sentence.
WINDOW, SENTENCE, WORD = 8, 16, 256

# Texts of these characters alone are split here and looked up word by word; the tokenizer does the rest.
SIMPLE = re.compile(r"[\t\n\r\x20-\x7e\xa0-įı-ſ]*+")
L, N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-įı-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+")


class Numbers(dict):
    """Gives every new word the next number."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Tokens:
    """Texts to ids, with a bounded cache of words; equal to the tokenizer's own encoding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.closes = np.zeros(len(self.ends), bool)
        for token, i in vocab.items():
            self.closes[i] = token.endswith("</w>")
            if token.endswith("</w>") and token[:-4].rstrip("\"')")[-1:] in (".", "!", "?"):
                self.ends[i] = True
        self.clear()

    def clear(self) -> None:
        self.at = Numbers()
        self.flat: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.length: list[np.ndarray] = [np.zeros(0, np.int64)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has: its last id closes a word."""
        ids = np.array(self.encode([" ".join(words)])[0], np.uint32)
        stop = np.flatnonzero(self.closes[ids]) + 1
        if len(stop) != len(words):
            raise ValueError("a word is not one word to the tokenizer")
        return ids, np.diff(stop, prepend=0)

    def encode(self, texts: list[str]) -> list[list[int]]:
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with END after it."""
        texts = [t or "" for t in texts]
        simple = ["<|" not in t and SIMPLE.fullmatch(t) is not None for t in texts]
        if len(self.at) > CACHE:
            self.clear()
        known = len(self.at)
        numbers = []
        for t, s in zip(texts, simple, strict=True):
            ws = SPLIT.findall(t.lower()) if s else []
            numbers.append(np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws)))
        if len(self.at) > known:
            ids, length = self.words(list(islice(self.at, known, None)))
            self.flat = [np.concatenate([*self.flat, ids])]
            self.length = [np.concatenate([*self.length, length])]
        flat, length = self.flat[0], self.length[0]
        first = np.cumsum(length) - length
        hard = iter(self.encode([t for t, s in zip(texts, simple, strict=True) if not s]))
        out = []
        for at, s in zip(numbers, simple, strict=True):
            if s:
                n = length[at]
                where = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                ids = flat[where]
            else:
                ids = np.array(next(hard), np.uint32)
            out.append(np.append(ids, np.uint32(END)))
        return out


@cache
def tokens_of(path: str) -> Tokens:
    """One a worker, so that words stay known from task to task."""
    return Tokens(path)


def cuts(ends: np.ndarray, docs: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, with their prices.

    ends: positions after a sentence's last token. docs: those after a document's last token. Where
    these lie further apart than a quarter of a window, places inside the sentence are added.
    """
    # a few sentences' ends within some tokens of each other are as good as one
    if len(ends):
        ends = ends[np.diff(ends // max(1, room // 64), prepend=-1) > 0]
    pos = np.union1d(ends, docs)
    gap = np.diff(pos, prepend=0)
    step = max(1, room // 4)
    wide = np.flatnonzero(gap > step)
    inside = [np.arange(pos[i] - gap[i] + step, pos[i], step) for i in wide]
    every = np.union1d(pos, np.concatenate(inside)) if inside else pos
    price = np.full(len(every), float(WORD))
    price[np.isin(every, ends)] = SENTENCE
    price[np.isin(every, docs)] = 0.0
    return every, price


def cheapest(every: np.ndarray, price: np.ndarray, room: int = ROOM) -> tuple[list[float], list[int]]:
    """For each place (0 is the start) the least cost of the stream up to it, and the cut before it."""
    pos = [0, *every.tolist()]
    cost = [0.0, *price.tolist()]
    array = np.array(pos)
    exact: dict[int, list[int]] = {}
    for size in (1 << k for k in range(max(0, room.bit_length() - 4), room.bit_length()) if 1 << k < room):
        i = np.minimum(np.searchsorted(array, array - size), len(array) - 1)
        for j in np.flatnonzero(array[i] == array - size).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    f, back = [0.0] * len(pos), [0] * len(pos)
    queue, least = deque([0]), [0.0] * len(pos)
    none: list[int] = []
    for j in range(1, len(pos)):
        p = pos[j]
        while p - pos[queue[0]] > room:
            queue.popleft()
        i = queue[0]
        best = least[i] + room - p
        for k in exact.get(j, none):
            if f[k] < best:
                i, best = k, f[k]
        f[j], back[j] = best + cost[j] + WINDOW, i
        low = least[j] = f[j] + p
        while queue and least[queue[-1]] >= low:
            queue.pop()
        queue.append(j)
    return f, back


@dataclass
class Packer:
    """Takes documents one by one, gives pieces; holds about one block of tokens."""

    ends_of: np.ndarray
    base: int
    room: int = ROOM
    block: int = BLOCK

    def __post_init__(self):
        self.held: list[tuple[object, int, np.ndarray, int]] = []  # id, tokens before, ids, tokens of the document
        self.size = 0
        self.made = 0

    def add(self, doc_id, ids: np.ndarray):
        self.held.append((doc_id, 0, ids, len(ids)))
        self.size += len(ids)
        if self.size >= self.block:
            yield from self.flush(last=False)

    def flush(self, last: bool = True):
        if not self.held:
            return
        ids = np.concatenate([h[2] for h in self.held])
        docs = np.cumsum([len(h[2]) for h in self.held])
        ends = np.flatnonzero(self.ends_of[ids]) + 1
        every, price = cuts(ends, docs, self.room)
        f, back = cheapest(every, price, self.room)
        pos = [0, *every.tolist()]
        j = len(pos) - 1
        if not last:  # what the last window would hold waits for the next block
            near = [k for k in range(1, len(pos)) if pos[k] > pos[-1] - self.room and pos[k] < pos[-1]]
            j = min(near, key=lambda k: (f[k], -k), default=j)
        chosen = []
        end = pos[j]
        while j:
            chosen.append((pos[back[j]], pos[j]))
            j = back[j]
        starts = docs - [len(h[2]) for h in self.held]
        d = 0
        for a, b in reversed(chosen):
            number = self.base + self.made
            self.made += 1
            while docs[d] <= a:
                d += 1
            k = d
            while k < len(docs) and starts[k] < b:
                lo, hi = max(a, int(starts[k])), min(b, int(docs[k]))
                doc_id, before, _, total = self.held[k]
                crc = zlib.crc32(np.ascontiguousarray(ids[lo:hi], "<u4").tobytes())
                yield doc_id, before + lo - int(starts[k]), hi - lo, crc, total, number, lo - a
                k += 1
        rest = []
        for k in range(len(self.held)):
            if docs[k] > end:
                doc_id, before, own, total = self.held[k]
                skip = max(0, end - int(starts[k]))
                rest.append((doc_id, before + skip, own[skip:], total))
        self.held = rest
        self.size = sum(len(h[2]) for h in rest)


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """One row for each piece of a document in a sequence: where it starts, how long it is, where it lies.

    tokenizer: path of a tokenizer file. Every row is a document of its own, also where ids repeat
    or are null; a null or empty text is its end token alone. Documents stay in the order in which
    a partition reads them; no shuffle is made. Sequence numbers hold the partition's number in
    their upper half, so a task that runs again gives the same rows.
    """

    def run(batches):
        remember("tokens", tokens_of.cache_clear)
        tokens = tokens_of(tokenizer)
        packer = Packer(tokens.ends, TaskContext.get().partitionId() << 32, room)
        rows: list[tuple] = []

        def table():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES)
            rows.clear()
            return out

        for batch in batches:
            for part in pieces(batch, "text"):
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens(part.column(1).to_pylist()), strict=True):
                    rows += packer.add(doc_id, ids)
                if len(rows) > 10_000:
                    yield table()
        rows += packer.flush()
        if rows:
            yield table()
        tidy()

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
