"""Words and their hashes, whole texts at a time, for the operators that compare word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import remember

#: Distinct words that a worker remembers.
CACHE = 200_000


class Hashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_known = Hashes()


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed, carriage return; A-Z lowered on request.

    UTF-8 keeps ASCII bytes to ASCII characters, and bytes.split() and bytes.lower() know ASCII only.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes(words: list[bytes]) -> np.ndarray:
    remember("words", _known.clear)
    if len(_known) > CACHE:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, size: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of every ``size`` hashes in a row; empty if there are fewer.

    Windows of doubling lengths are put together, so the work grows with log(size).
    """
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out: np.ndarray | None = None
    done, part, length, power = 0, h, 1, factor
    rest = size
    while rest:
        if rest & 1:
            if out is None:
                out = part
            else:  # the new piece lies after what is done
                n = len(h) - done - length + 1
                out = out[:n] * np.uint64(power) + part[done : done + n]
            done += length
        rest >>= 1
        if rest:
            n = len(part) - length
            part = part[:n] * np.uint64(power) + part[length : length + n]
            length *= 2
            power = power * power & (1 << 64) - 1
    out = out.copy()
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out
