"""Words of texts in numpy: where they are, and hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Values that are summed up at once; the tables of powers that a worker keeps are as long.
STEP = 1 << 18


def _odd(seed: int) -> tuple[np.uint64, np.uint64]:
    p = (seed * 2 + 1) * 0x9E3779B97F4A7C15 * 4 + 5 & (1 << 64) - 1
    return _U(p), _U(pow(p, -1, 1 << 64))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """The powers 0 to n - 1 of an odd number, or of its inverse, mod 2 ** 64."""
    found = _powers.get((seed, inverse))
    if found is None or len(found) < n:
        found = np.full(max(n, STEP + 64), _odd(seed)[inverse], _U)
        found[0] = 1
        np.cumprod(found, out=found)
        if len(found) <= 2 * STEP:  # those for a longer word are not kept
            _powers[seed, inverse] = found
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_letters = [mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(s)) for s in (11, 77)]


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts start and end in their bytes, and the text of each."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_WHITE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], from one running sum."""
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _power(seed, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * _power(seed, len(values) + 1, True)[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of words; which is 0 or 1, for two independent ones."""
    out, k = np.zeros(len(starts), _U), 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(ends, starts[k] + STEP, side="right")))
        a, b = starts[k], ends[to - 1]
        out[k:to] = mix(_spans(_letters[which][data[a:b]], starts[k:to] - a, ends[k:to] - a, which) + (ends[k:to] - starts[k:to]).astype(_U))
        k = to
    return out


def run_hashes(words: np.ndarray, first: np.ndarray, size: int, which: int) -> np.ndarray:
    """64-bit hashes of the runs of size words that begin at first (in order), from the words' hashes."""
    out, k = np.zeros(len(first), _U), 0
    while k < len(first):
        to = int(np.searchsorted(first, first[k] + STEP))
        at = first[k:to]
        a, b = at[0], at[-1] + size
        out[k:to] = mix(_spans(words[a:b], at - a, at - a + size, 2 + which))
        k = to
    return out
