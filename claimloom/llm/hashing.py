"""64-bit hashes of all words of many texts at once, by array operations on their bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(folded: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in which all that separates words is a space.

    Returns the hashes in order and the offsets of each text's words: text i has offsets[i] to offsets[i+1].
    Two words agree in all 64 bits with a chance of about 1 in 2**64 for each pair.
    """
    joined = b" ".join([*folded, b""])
    data = np.frombuffer(joined, np.uint8)
    inside = np.concatenate([[False], data != 0x20, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverses = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)])
        hashes = (sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    places = np.concatenate([[0], np.cumsum([len(f) + 1 for f in folded])]).astype(np.int64)
    return mix(hashes), np.searchsorted(starts, places)


def batches(texts: Sequence[str], size: int = 1 << 21):
    """Index ranges of consecutive texts of about ``size`` characters; a longer text is a range of its own."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)
