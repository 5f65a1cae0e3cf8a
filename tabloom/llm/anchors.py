"""Content-defined anchors: equal windows of symbols pick equal positions.

Every window of ``span`` consecutive symbols is represented by the ``gram``-symbol piece inside it
with the smallest hash (the leftmost of equals). Equal windows therefore share the anchor's hash and
their offset from it, wherever they occur, and neighbouring windows usually share one anchor, so a
table of anchors is a small complete index of all windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Low bits that hold a position while minima are taken; windows are handled in chunks below that.
POSITION_BITS = np.uint64(24)
CHUNK = 1 << 22
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _A
    out ^= right * _B
    out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return out


def gram_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` symbols (uint64 codes), by doubling."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out, piece, size = 0, None, symbols, 1
    while True:
        if length & size:
            out = piece[:n] if out is None else _join(out[:n], piece[done : done + n])
            done += size
        if done == length:
            return out
        piece = _join(piece[:-size], piece[size:])
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Symbols hashed at a time by ``rolling_hashes``, and its powers of an odd number and of that number's inverse.
ROLL = 1 << 18
_UP, _DOWN = _powers(int(_A), ROLL), _powers(pow(int(_A), -1, 1 << 64), ROLL)


def rolling_hashes(symbols: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Polynomial hashes of every run of each of ``lengths`` symbols; at most ``ROLL`` symbols. Cheaper than
    ``gram_hashes``, and good for choosing and filtering only: some runs collide by their form."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _UP[: len(symbols)], out=sums[1:])
    out = []
    for length in lengths:
        hashes = sums[length:] - sums[: max(0, len(sums) - length)]
        hashes *= _DOWN[: len(hashes)]
        hashes ^= hashes >> np.uint64(32)
        hashes *= _B
        out.append(hashes)
    return out


def least_runs(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end window and place of the least hash of every run of windows of ``width`` hashes that share it."""
    packed = (hashes >> POSITION_BITS << POSITION_BITS) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(packed, width)
    begin = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return begin, np.append(begin[1:], len(least)), (least[begin] & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)


def anchor_runs(symbols: np.ndarray, span: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of windows: first window, end window, anchor position and anchor hash of every
    run of windows that share an anchor."""
    windows = len(symbols) - span + 1
    for start in range(0, max(0, windows), CHUNK):
        hashes = gram_hashes(symbols[start : min(windows, start + CHUNK) + span - 1], gram)
        begin, end, at = least_runs(hashes, span - gram + 1)
        yield begin + start, end + start, at + start, hashes[at]
