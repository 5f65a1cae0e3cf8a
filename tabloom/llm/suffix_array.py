"""Suffix arrays by induced sorting, and permuted longest common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of integer symbols in linear time.

    Suffixes are classified as smaller or larger than their right neighbour; the leftmost-smaller
    (LMS) substrings are sorted by one induction, named, and sorted recursively where names repeat;
    a second induction from the sorted LMS suffixes yields the whole order."""
    text = np.asarray(text, np.int64)
    if len(text) < 2:
        return np.arange(len(text))
    _, dense = np.unique(text, return_inverse=True)
    closed = np.append(dense + 1, 0)  # a least symbol at the end
    return np.array(_induced(closed)[1:], np.int64)


def _induced(s: np.ndarray) -> list[int]:
    n = len(s)
    # smaller-type: s[i] < s[i+1], or equal and the right neighbour is smaller-type
    step = np.append(np.sign(s[1:] - s[:-1]), 1)
    decided = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    small = step[following] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(s)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    symbols, is_small = s.tolist(), small.tolist()

    def induce(seeds: list[int]) -> list[int]:
        order = [-1] * n
        tail = tails.tolist()
        for i in reversed(seeds):
            c = symbols[i]
            tail[c] -= 1
            order[tail[c]] = i
        head = heads.tolist()
        for i in order:  # grows while it is read: larger-type suffixes, left to right
            if i > 0 and not is_small[i - 1]:
                c = symbols[i - 1]
                order[head[c]] = i - 1
                head[c] += 1
        tail = tails.tolist()
        for at in range(n - 1, -1, -1):  # smaller-type suffixes, right to left
            i = order[at]
            if i > 0 and is_small[i - 1]:
                c = symbols[i - 1]
                tail[c] -= 1
                order[tail[c]] = i - 1
        return order

    if len(lms) == 1:
        return induce(lms.tolist())
    rough = np.array(induce(lms.tolist()), np.int64)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = rough[is_lms[rough]]
    end_of = np.full(n, n, np.int64)
    end_of[lms[:-1]] = lms[1:]
    names, name, previous = np.zeros(n, np.int64), 0, -1
    for i in ranked.tolist():
        if previous >= 0:
            length, before = int(end_of[i]) - i, int(end_of[previous]) - previous
            same = length == before and end_of[i] < n and end_of[previous] < n and np.array_equal(s[i : i + length + 1], s[previous : previous + length + 1])
            name += not same
        names[i], previous = name, i
    shorter = names[lms]
    order = np.argsort(shorter) if name + 1 == len(lms) else np.array(_induced(shorter))
    return induce(lms[order].tolist())


def permuted_lcp(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By text position: symbols shared with the suffix just before it in the suffix array."""
    n, s = len(text), np.asarray(text).tolist()
    before = [-1] * n
    for prev, here in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        before[here] = prev
    out, length = [0] * n, 0
    for i, j in enumerate(before):
        if j < 0:
            length = 0
            continue
        top = n - max(i, j)
        while length < top and s[i + length] == s[j + length]:
            length += 1
        out[i] = length
        length = max(0, length - 1)
    return np.array(out, np.int64)


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """True where a string of ``length`` symbols starts that also starts elsewhere in the text."""
    if len(text) < 2:
        return np.zeros(len(text), bool)
    order = suffix_array(text)
    shared = permuted_lcp(text, order) >= length  # with the suffix before
    out = shared.copy()
    out[order[:-1]] |= shared[order[1:]]  # with the suffix after
    return out


def _rows_ranked(rows: np.ndarray) -> np.ndarray:
    """Symbols of each row replaced by their rank among the row's own symbols."""
    order = np.argsort(rows, axis=1, kind="stable")
    ordered = np.take_along_axis(rows, order, 1)
    rank = np.zeros_like(order)
    rank[:, 1:] = np.cumsum(ordered[:, 1:] != ordered[:, :-1], axis=1)
    out = np.empty_like(order)
    np.put_along_axis(out, order, rank, 1)
    return out


def _padded(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of unequal length closed by falling symbols that are smaller than all others; they sort first."""
    width = rows.shape[1]
    column = np.arange(width)
    lift = (width - sizes)[:, None]
    return np.where(column < sizes[:, None], rows + lift, width - 1 - column)


def induced_rows(rows: np.ndarray) -> np.ndarray:
    """Suffix arrays of many rows of one length, each closed by a symbol smaller than all its others.

    The induced sorting of ``suffix_array`` in step for all rows: every scan position is one array operation
    over the rows, the leftmost-smaller substrings of all rows are named and sorted recursively together."""
    count, n = rows.shape
    s = rows.ravel()
    base = np.arange(count) * n
    kinds = int(rows.max()) + 1
    step = np.ones((count, n), np.int8)
    step[:, :-1] = np.sign(rows[:, 1:] - rows[:, :-1])
    decided = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(decided[:, ::-1], axis=1)[:, ::-1]
    small = np.take_along_axis(step, following, 1) > 0
    is_lms = np.zeros((count, n), bool)
    is_lms[:, 1:] = small[:, 1:] & ~small[:, :-1]
    # flat positions from here on; by suffix: is there one to the left, and of which type (the last entry: no suffix)
    before_small, before_larger = (np.zeros(count * n + 1, bool) for _ in range(2))
    before_small[:-1].reshape(count, n)[:, 1:] = small[:, :-1]
    before_larger[:-1].reshape(count, n)[:, 1:] = ~small[:, :-1]
    bucket = np.repeat(np.arange(count) * kinds, n) + s
    sizes = np.bincount(bucket, minlength=count * kinds).reshape(count, kinds)
    tails = np.cumsum(sizes, axis=1) + base[:, None]
    heads = (tails - sizes).ravel()
    tails = tails.ravel()
    is_lms = is_lms.ravel()

    def induce(seeds: np.ndarray) -> np.ndarray:
        """Seeds come row by row, in their order within the row."""
        order = np.full(count * n, count * n)
        key = bucket[seeds]
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[tails[key] - (np.searchsorted(key, key, side="right") - np.arange(len(key)))] = seeds[by]
        columns = order.reshape(count, n).T
        free = heads.copy()
        for at in range(n):  # larger-type suffixes, left to right
            here = columns[at]
            left = here[before_larger[here]] - 1
            key = bucket[left]
            to = free[key]
            order[to] = left
            free[key] = to + 1
        free = tails.copy()
        for at in range(n - 1, -1, -1):  # smaller-type suffixes, right to left
            here = columns[at]
            left = here[before_small[here]] - 1
            key = bucket[left]
            to = free[key] - 1
            order[to] = left
            free[key] = to
        return order

    flat = np.flatnonzero(is_lms)
    lms_row = flat // n
    many = np.bincount(lms_row, minlength=count)
    rough = induce(flat)
    ranked = rough[is_lms[rough]]  # row by row in rough order
    end_of = np.full(count * n, -1)
    last = np.append(lms_row[1:] != lms_row[:-1], True)
    end_of[flat[~last]] = flat[1:][~last[:-1]]
    first = np.append(True, ranked[1:] // n != ranked[:-1] // n)
    here, before = ranked[1:], ranked[:-1]
    long_here, long_before = end_of[here] - here, end_of[before] - before
    open_ = np.flatnonzero(~first[1:] & (end_of[here] >= 0) & (end_of[before] >= 0) & (long_here == long_before))
    same = np.zeros(len(here), bool)
    along = 0
    while len(open_):
        open_ = open_[s[here[open_] + along] == s[before[open_] + along]]
        done = long_here[open_] == along
        same[open_[done]] = True
        open_ = open_[~done]
        along += 1
    fresh = np.append(True, ~same)
    number = np.cumsum(fresh)
    starts = np.flatnonzero(first)
    names = np.zeros(count * n, np.int64)
    names[ranked] = number - np.repeat(number[starts], many)
    if fresh.all():
        sorted_flat = ranked
    else:
        width = int(many.max())
        column = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
        shorter = np.zeros((count, width), np.int64)
        shorter[lms_row, column] = names[flat]
        deeper = induced_rows(_padded(shorter, many))
        kept = deeper < many[:, None]
        table = np.zeros((count, width), np.int64)
        table[lms_row, column] = flat
        sorted_flat = np.take_along_axis(table, np.where(kept, deeper, 0), 1)[kept]
    return induce(sorted_flat).reshape(count, n) - base[:, None]


def permuted_lcp_rows(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``permuted_lcp`` in step for many rows, each closed by a symbol of its own."""
    count, n = rows.shape
    base = np.arange(count) * n
    s = np.append(rows.ravel(), np.full(n, -1))  # what the first suffix of an order is compared with
    order = order + base[:, None]
    before = np.full(count * n, count * n)
    before[order[:, 1:]] = order[:, :-1]
    out = np.zeros(count * n, np.int64)
    here, end, length = base.copy(), base + n, np.zeros(count, np.int64)
    while len(here):
        equal = s[here + length] == s[before[here] + length]
        out[here] = length
        length = np.where(equal, length + 1, np.maximum(length - 1, 0))
        here = here + ~equal
        over = here == end
        if over.any():
            here, end, length = here[~over], end[~over], length[~over]
    return out.reshape(count, n)


def repeated_starts_rows(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """``repeated_starts`` of many short texts, sorted together."""
    sizes = np.array([len(t) + 1 for t in texts])
    rows = np.zeros((len(texts), int(sizes.max())), np.int64)
    for row, text in zip(rows, texts, strict=True):
        row[: len(text)] = text + 1
    rows = _rows_ranked(_padded(rows, sizes))
    order = induced_rows(rows)
    shared = permuted_lcp_rows(rows, order) >= length
    out = shared.copy()
    line = np.arange(len(texts))[:, None]
    after = np.zeros_like(shared)
    after[line, order[:, :-1]] = shared[line, order[:, 1:]]
    out |= after
    return [found[: len(text)] for found, text in zip(out, texts, strict=True)]
