"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E6C63D0876A9A4B)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: The key of word hashes where no result hangs on them.
KEY = 0x6A09E667F3BCC908
#: Bytes of text that are hashed together (a longer text is hashed alone); powers that are kept ready.
CHUNK = 2 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers from 0 to n, and their inverses modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, CHUNK + 4096)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            _POWERS[name] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, factor, np.uint64)]))
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums of bytes times powers, so that any substring's hash is a difference times an inverse power.

    Modulo 2**64 such sums meet on patterns that can be planned: they may choose where to look, never decide what is equal.
    """
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, key: int = KEY) -> np.ndarray:
    """64-bit hashes of the byte runs from ``start`` to before ``stop``: twice a multilinear sum of four-byte lanes, upper halves.

    For whoever doesn't know ``key`` two different runs meet with a chance of 2**-64, whatever they are; operators that decide by these
    hashes draw a key for each run.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = stop - start
    lanes = (size + 3) // 4
    first = np.cumsum(lanes) - lanes
    turn = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
    at = np.repeat(start, lanes) + 4 * turn
    padded = np.concatenate([raw, np.zeros(4, np.uint8)])
    lane = np.zeros(len(at), np.uint64)
    left = np.repeat(stop, lanes) - at
    for k in range(4):
        lane |= np.where(left > k, padded[np.minimum(at + k, len(padded) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
    keys = mix(np.arange(2 * (int(lanes.max()) + 2), dtype=np.uint64) + np.uint64(key)).reshape(-1, 2).T  # a lane's keys are the same whatever else is hashed
    out = np.zeros(len(start), np.uint64)
    for half in keys:
        sums = np.add.reduceat(lane * half[turn + 2], first) + half[0] + size.astype(np.uint64) * half[1]
        out = out << np.uint64(32) | sums >> np.uint64(32)
    return out


def chained(word: np.ndarray, words: int, size: int) -> np.ndarray:
    """Hashes of all runs of ``words`` word hashes; a run's length (``size``) is part of its hash."""
    n = len(word) - words + 1
    out = mix(np.full(n, size + 1, np.uint64) * _BASE)
    for k in range(words):
        out = mix(out * _BASE + np.uint64(1) ^ word[k : k + n])
    return out


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


def shingle_sets(texts: list[str | None], words: int = 5, key: int = KEY) -> list[np.ndarray]:
    """Of each text the ascending distinct hashes of its ``words``-word shingles.

    A-Z are lower-cased; words are runs of other bytes than 9-13 and 32. A text of fewer words is
    one shingle, its whole sequence; one without words has an empty set. No text is cut. Words are
    named by :func:`word_hashes` and chained without a linear form.
    """
    out: list[np.ndarray] = []
    for held in _chunks([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        raw = np.frombuffer(b" " + b" ".join(held) + b" ", np.uint8)
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start, stop = turns[0::2], turns[1::2]
        word = word_hashes(raw, start, stop, key)
        ends = np.cumsum([len(t) + 1 for t in held])
        bounds = np.concatenate([[0], np.searchsorted(start, ends, "right")]).tolist()
        rolled = chained(word, words, words) if len(word) >= words else word
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            else:
                out.append(chained(word[a:b], b - a, b - a) if b > a else np.zeros(0, np.uint64))
    return out
