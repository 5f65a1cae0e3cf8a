"""Re-Pair over arrays of ids: frequent neighbours become nonterminals, round by round.

A round counts all neighbouring pairs of a shard, gives the most frequent ones a nonterminal each and
replaces them. Where two chosen pairs overlap, the more frequent one wins; the other is replaced in a later round if it is still
frequent. Pairs never reach over a document's end, so each document is a stretch of symbols of its own."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BITS = 17
_LEFT, _RIGHT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


@dataclass
class Grammar:
    """Symbols below ``vocabulary`` are ids; symbol ``vocabulary + r`` is rule ``r``: two symbols of earlier rules."""

    vocabulary: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray  # ids that rule r expands to

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol expands to."""
        if not len(self.left):
            return np.ones(len(symbols), np.int64)
        return np.where(symbols < self.vocabulary, 1, self.lengths[np.maximum(symbols - self.vocabulary, 0)])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids behind some symbols."""
        symbols = symbols.astype(np.int64)
        while (deep := symbols >= self.vocabulary).any():
            at = np.cumsum(1 + deep) - 1 - deep
            out = np.empty(int(at[-1]) + 1 + int(deep[-1]), np.int64)
            rules = symbols[deep] - self.vocabulary
            out[at] = symbols
            out[at[deep]], out[at[deep] + 1] = self.left[rules], self.right[rules]
            symbols = out
        return symbols

    def cut(self, symbols: np.ndarray, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive) of the expansion, without expanding symbols outside."""
        ends = np.cumsum(self.sizes(symbols))
        a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left")
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a : b + 1])[first - before : last - before] if first < last and len(symbols) else np.empty(0, np.int64)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' expansions in one array, and where each begins: for decoding whole shards."""
        ids = self.expand(np.arange(len(self.left)) + self.vocabulary) if len(self.left) else np.empty(0, np.int64)
        return ids, np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if len(self.left) else np.empty(0, np.int64)


def compress(ids: np.ndarray, sizes: np.ndarray, vocabulary: int, pairs: int = 1536, rounds: int = 10, least: int = 24) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """The grammar of ids, the symbols left, and how many symbols each document has; ``sizes`` are the documents' ids.

    Up to ``pairs`` nonterminals a round, for pairs that occur ``least`` times or more, in at most ``rounds`` rounds."""
    symbols = ids.astype(np.uint32)
    first = np.zeros(len(symbols) + 1, bool)  # first symbols of documents
    first[np.cumsum(sizes)] = True
    first = first[: len(symbols)]
    if len(first):
        first[0] = True
    lefts, rights = [], []
    top = vocabulary
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        slots = ((symbols[:-1] * _LEFT) ^ (symbols[1:] * _RIGHT)) >> np.uint32(32 - _BITS)
        counts = np.bincount(slots, minlength=1 << _BITS)  # at least the occurrences of any pair in the slot
        high = counts[counts >= least]
        floor = int(np.partition(high, -pairs)[-pairs]) if len(high) > pairs else least
        at = np.flatnonzero((counts >= floor)[slots] & ~first[1:])
        keys = (symbols[at].astype(np.int64) << 32) | symbols[at + 1]
        found, n = np.unique(keys, return_counts=True)
        order = np.lexsort((found, -n))[:pairs]
        order = order[n[order] >= least]
        if not len(order):
            break
        chosen = found[order]
        where = ((chosen >> 32).astype(np.uint32) * _LEFT ^ chosen.astype(np.uint32) * _RIGHT) >> np.uint32(32 - _BITS)
        _, alone = np.unique(where, return_index=True)  # of two pairs in one slot the more frequent one
        none = np.int32(len(chosen))
        rank_of, key_of = np.full(1 << _BITS, none, np.int32), np.full(1 << _BITS, -1, np.int64)
        rank_of[where[alone]], key_of[where[alone]] = alone.astype(np.int32), chosen[alone]
        at = at[key_of[slots[at]] == keys]
        ranks = np.full(len(symbols) + 1, none, np.int32)
        ranks[at + 1] = rank_of[slots[at]]
        at = at[(ranks[at + 1] < ranks[at]) & (ranks[at + 1] <= ranks[at + 2])]
        uses = np.bincount(ranks[at + 1], minlength=len(chosen))
        used = uses >= 3
        at = at[used[ranks[at + 1]]]
        number = (np.cumsum(used) - 1 + top).astype(np.uint32)
        symbols[at] = number[ranks[at + 1]]
        lefts.append(chosen[used] >> 32)
        rights.append(chosen[used] & 0xFFFFFFFF)
        top += int(used.sum())
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, first = symbols[keep], first[keep]
    left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (lefts, rights))
    lengths = np.ones(top, np.int64)
    done = vocabulary
    for a, b in zip(lefts, rights, strict=True):  # rules of a round use earlier rounds only
        lengths[done : done + len(a)] = lengths[a] + lengths[b]
        done += len(a)
    grammar = Grammar(vocabulary, left, right, lengths[vocabulary:])
    held = np.zeros(len(sizes), np.int64)
    full = np.flatnonzero(sizes > 0)
    starts = np.flatnonzero(first)
    held[full] = np.diff(np.append(starts, len(symbols)))
    return grammar, symbols.astype(np.int64), held
