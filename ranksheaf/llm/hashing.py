"""Word and shingle hashes of many texts at a time, with numpy.

A word's hash is the difference of two prefix sums of byte * R**position, divided by R**start, all modulo
2**64 (R is odd, so it has an inverse), then mixed. Long inputs are cut at white space, so memory stays
bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 20
R = np.uint64(0x9E3779B97F4A7C15 | 1)
R_INVERSE = np.uint64(pow(int(R), -1, 1 << 64))
#: ASCII white space.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", R), ("down", R_INVERSE)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_words(buffer: np.ndarray) -> np.ndarray:
    space = IS_SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(buffer) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def words(text: bytes) -> np.ndarray:
    """Hashes of the words of one buffer, A-Z lower-cased, in order."""
    text, found, at = text.lower(), [], 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                ahead = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(c, end)) >= 0]
                cut = min(ahead, default=len(text))
            end = cut
        found.append(_segment_words(np.frombuffer(text, np.uint8, min(end, len(text)) - at, at)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def batches(texts: list[str | None], size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` characters."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and each text's number of words."""
    raw = [(t or "").encode() for t in texts]
    if sum(map(len, raw)) > 4 * SEGMENT:
        each = [words(r) for r in raw]
        return np.concatenate(each) if each else np.zeros(0, np.uint64), np.array([len(e) for e in each], dtype=np.int64)
    buffer = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    all_words = _segment_words(buffer)
    first = np.concatenate(([True], IS_SPACE[buffer[:-1]])) & ~IS_SPACE[buffer]
    counts = np.add.reduceat(first.astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1]))) if raw else np.zeros(0, np.int64)
    return all_words, counts


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; the run's order counts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * R + hashes[i : len(hashes) - n + 1 + i]
    return mixed(out)


def shingle_set(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct shingles; with fewer than n words the whole sequence is the only one."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < n:
        return mixed(grams(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(grams(hashes, n))
