"""Words and word sequences as 64-bit numbers, vectorised over one text at a time.

A word is a run of bytes other than ASCII white space (space, tab to carriage return).  Its
number is a polynomial over its bytes, a sequence's number a polynomial over its words, both
modulo 2^64 and scrambled at the end, so equal sequences have equal numbers on any machine.
"""

from __future__ import annotations

import numpy as np

_LETTERS = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTERS_ALL = _LETTERS.copy()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS[_SPACE] = 0
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_POWERS = _powers(_BYTE_BASE, 256)


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(data: bytes) -> np.ndarray:
    """One number per word of a UTF-8 text."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = starts[0]
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(first, len(raw)) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    powers = _BYTE_POWERS if longest <= 256 else _powers(_BYTE_BASE, longest)
    return scramble(np.add.reduceat(_LETTERS[raw[first:]] * powers[place], starts - first))


def spelled_numbers(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per word; word i is ``letters[ends[i]:ends[i + 1]]``, and none is empty."""
    if len(ends) < 2:
        return np.zeros(0, np.uint64)
    lengths = np.diff(ends)
    place = np.arange(len(letters)) - np.repeat(ends[:-1], lengths)
    longest = int(lengths.max())
    powers = _BYTE_POWERS if longest <= 256 else _powers(_BYTE_BASE, longest)
    return scramble(np.add.reduceat(_LETTERS_ALL[letters] * powers[place], ends[:-1]))


def sequence_numbers(words: np.ndarray, k: int) -> np.ndarray:
    """One number per run of k words; none if there are fewer."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    return scramble(_rolled(words, k) + np.uint64(k))


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Sum of word * base^place over each run of k, by doubling."""
    run, width, total, done = words, 1, None, 0
    power, shift = int(_WORD_BASE), 1
    while True:
        if k & width:
            if total is None:
                total, shift = run, power
            else:
                n = len(words) - (done + width) + 1
                total = total[:n] + np.uint64(shift) * run[done:done + n]
                shift = shift * power % (1 << 64)
            done += width
        if done == k:
            return total[: len(words) - k + 1]
        run = run[: len(run) - width] + np.uint64(power) * run[width:]
        power = power * power % (1 << 64)
        width *= 2


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of k words that begins at one of the starts."""
    edge = np.bincount(starts, minlength=n + k + 1)[: n + k + 1]
    edge = edge - np.concatenate((np.zeros(k, edge.dtype), edge[:-k]))
    return np.cumsum(edge)[:n] > 0
