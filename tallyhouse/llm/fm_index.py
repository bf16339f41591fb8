"""FM-index over integer symbols: suffix sorting, wavelet matrix, backward search, sampled locate."""

from __future__ import annotations

import numpy as np

#: Every so many text positions one suffix position is kept.
SAMPLE = 8


def suffix_array(text: np.ndarray, top: int) -> np.ndarray:
    """Order of all suffixes of ``text`` (symbols 0..top); the end of text sorts first.

    Prefix doubling: the first sort takes as many symbols as fit into 62 bits, later
    rounds sort only what is still tied.
    """
    n, bits = len(text), max(1, int(top + 1).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key <<= bits
        key[: max(0, n - i)] |= text[i:] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    lead = np.concatenate(([True], key[1:] != key[:-1])) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(lead, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = first
    tied = np.flatnonzero(~(lead & np.append(lead[1:], True))) if n else np.zeros(0, np.int64)
    while len(tied):
        at = order[tied]
        nxt = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)], -1)
        own = rank[at]
        by = np.lexsort((nxt, own))
        at, nxt, own = at[by], nxt[by], own[by]
        order[tied] = at
        group = np.concatenate(([True], own[1:] != own[:-1]))
        part = group | np.concatenate(([True], nxt[1:] != nxt[:-1]))
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(group, place, 0))
        rank[at] = own + np.maximum.accumulate(np.where(part, place, 0)) - start
        tied = tied[~(part & np.append(part[1:], True))]
        depth *= 2
    return order


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros((len(bits) // 64 + 1) * 64, bool)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before ``i``."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for level in reversed(range(max(1, int(top).bit_length()))):
            one = (symbols >> level & 1).astype(bool)
            self.levels.append((level, Bits(one), int(len(symbols) - one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of ``symbol`` before each of ``ends``."""
        at = [np.zeros(len(symbol), np.int64), *ends]
        for level, bits, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            ranks = [bits.rank(x) for x in at]
            at = [np.where(one, zeros + r, x - r) for x, r in zip(at, ranks)]
        return [x - at[0] for x in at[1:]]

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at ``i``, and how often each occurs before."""
        symbol, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for level, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            symbol |= one.astype(np.int64) << level
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return symbol, i - start


class FMIndex:
    """Index of one shard: counts and finds occurrences of symbol strings."""

    def __init__(self, text: np.ndarray, top: int):
        self.n = len(text)
        order = suffix_array(text, top)
        # row 0 is the empty suffix; symbols are raised by one to make room for the end mark 0
        rows = np.concatenate(([self.n], order))
        last = np.where(rows > 0, text[rows - 1] + 1, 0) if self.n else np.zeros(1, np.int64)
        self.bwt = WaveletMatrix(last, top + 1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(last, minlength=top + 2))))[:-1]
        kept = rows % SAMPLE == 0
        self.marked, self.positions = Bits(kept), rows[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns together; ``patterns`` is padded on the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n + 1, np.int64)
        live = np.flatnonzero(lengths > 0)
        low[lengths <= 0] = high[lengths <= 0] = 0
        width = patterns.shape[1]
        for step in range(width):
            going = live[lengths[live] > step]
            if not len(going):
                break
            c = patterns[going, width - 1 - step] + 1
            a, b = self.bwt.rank(c, low[going], high[going])
            low[going], high[going] = self.before[c] + a, self.before[c] + b
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            here = self.marked.get(rows).astype(bool)
            out[todo[here]] = self.positions[self.marked.rank(rows[here])] + steps[todo[here]]
            todo, rows = todo[~here], rows[~here]
            steps[todo] += 1
            symbol, seen = self.bwt.get(rows)
            rows = self.before[symbol] + seen
        return out
